"""Removal of lines that many documents share, by DataFrame functions alone.

Method: each long line is hashed to 128 bits.  Hashes, salted by document so that one very common
line spreads over many tasks, are range-partitioned and sorted by document (largest first) and
position; a streaming window marks where a document first shows a line.  Those marks count each
line's documents and its keeper, and what must go comes back as compressed keep bitmaps per
document (words of 64 lines, absent where all lines stay), never as text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, shuffle_parts, spare

MIN_CHARS, MIN_DOCS, SALTS = 40, 5, 64
STRIPPED = "\t\n\x0b\x0c\r "
WORD = 64


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(STRIPPED))
    # lower() touches letters outside A-Z, but not in texts of one byte a character.
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"),
        F.xxhash64("text").alias("_text"),
        F.col("text").cast("string").alias("text"),
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """Rows (_id, _text, keep): keep maps a word's number to 64 bits, 1 where a line stays.

    Words without dropped lines, and documents without such words, are absent.  Documents are
    told apart by id; those of null id count as one document, smaller than any.  Rows that
    repeat an id with another text have bitmaps of their own, found by the text's hash.
    """
    lines = (
        _named(docs)
        .select("_id", "_text", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("salt"),
            "_id",
            "_text",
            "pos",
        )
    )
    # Settled, so that texts are split and hashed once, and not again for the ranges' sample.
    spread = durable(lines).repartitionByRange(shuffle_parts(docs.sparkSession), "h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("_id"), "_text", "pos")
    # The row before is read whole, so that both uses below need the same columns and share one exchange.
    before = F.lag(F.struct("_id", "_text", "pos")).over(order)
    marked = spread.withColumn("first", before.isNull() | (before["_id"] != F.col("_id")))
    shared = (
        marked.where("first")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("_id").alias("keeper"), F.collect_set("salt").alias("held"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper", F.explode("held").alias("salt"))
    )
    gone = marked.join(shared, ["h1", "h2", "salt"]).where(F.col("_id") < F.col("keeper"))
    words = gone.groupBy("_id", "_text", F.shiftright("pos", 6).alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits")
    )
    return words.groupBy("_id", "_text").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """`docs` with text replaced by the kept lines, and two columns of `counts`: lines, and lines dropped.

    Null texts become empty ones.  All other columns pass through, whatever their names; only
    those named as `counts` are replaced.  Repeated rows are kept, each with its own lines.
    """
    own_id, own_text, kid, ktext, keep, lines, kept = (spare(docs, x) for x in ("own_id", "own_text", "kept_id", "kept_text", "keep", "lines", "kept"))
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"_id": kid, "_text": ktext, "keep": keep})
    whole = docs.withColumns(
        {own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), own_text: F.xxhash64("text")}
    )
    joined = whole.join(bitmaps, (F.col(own_id) == F.col(kid)) & (F.col(own_text) == F.col(ktext)), "left")
    stays = F.expr(f"filter({lines}, (x, i) -> (shiftright(coalesce({keep}[shiftright(i, 6)], -1L), i % 64) & 1L) = 1L)")
    return (
        joined.withColumn(lines, text_lines(F.col("text").cast("string")))
        .withColumn(kept, F.when(F.col(keep).isNull(), F.col(lines)).otherwise(stays))
        .withColumns(
            {
                "text": F.array_join(kept, "\n"),
                counts[0]: F.size(lines).cast("long"),
                counts[1]: (F.size(lines) - F.size(kept)).cast("long"),
            }
        )
        .drop(own_id, own_text, kid, ktext, keep, lines, kept)
    )
