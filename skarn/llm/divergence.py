"""How far each source's use of terms lies from the other sources' and from its language's, by plain relational steps.

Method: matches of the term pattern (what lies between matches of its complement, found many times
faster by one split) are exploded and counted by (lang, source, term); the terms
that enough documents of a language hold are its vocabulary; groups meet the vocabulary of their
language, so that absent terms count as zeros; a self-join on (lang, term) gives the differences
of each two sources, which are summed; windows rank them.

All arithmetic is in whole numbers: a smoothed share p is 1 + floor(UNIT (count + 5) / (N + 5 V))
by decimals of 38 digits, where N is the sum of counts and V the size of the vocabulary.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: What parts terms, which are runs of letters: of ASCII a-z only, beyond ASCII any character.
OTHER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Parts that a language's vocabulary is dealt to, so that one large language fills many tasks.
SALTS = 64
#: Stands for "no term" in each language's vocabulary, so that languages without any have pairs too.
NO_TERM = ""


def _folded(text: Column) -> Column:
    """A text with A-Z lower-cased."""
    # lower() touches letters outside A-Z, but not in texts of one byte a character.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _share(count: str, total: str, size: str) -> Column:
    """The smoothed share in units of 1 / UNIT."""
    return F.expr(f"1 + (cast({count} + {SMOOTH} as decimal(27,0)) * cast({UNIT} as decimal(10,0))) div cast({total} + {SMOOTH} * {size} as decimal(38,0))")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term in a group, and documents (rows) with it."""
    named = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        F.split(_folded(F.coalesce(F.col("text").cast("string"), F.lit(""))), OTHER, -1).alias("terms"),
    )
    # All terms of a text, then its distinct ones.
    twice = named.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    each = twice.select("lang", "source", "once", F.explode("terms").alias("term")).where(F.col("term") != "")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").cast("long").alias("d"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ranked differences of each occurring (lang, source) group.

    Part `pair`: each other source of the language, with the sum over its vocabulary of the
    differences of shares, all of them.  Part `term`: the vocabulary's terms that the group uses
    more than its language does, with the difference, the `top` largest.  Ranks go by value,
    largest first, then by the item's bytes.  Null lang, source and text count as empty ones;
    each row is a document, so repeated rows count as often as they come; a group without terms
    has zeros; a language with an empty vocabulary has pairs of value 0 and no terms; other
    columns play no part; no rows give no rows.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counts = written(term_counts(docs))
    kept = written(counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).select("lang", "term", "total"))
    cells = written(counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("all"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("own", "size", "all"))))
    none = groups.select("lang").distinct().select("lang", F.lit(NO_TERM).alias("term"), F.lit(0).cast("long").alias("total"))
    # Vocabulary and groups meet by language and a part of the vocabulary.
    words = kept.unionByName(none).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    every = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dense = words.join(every, ["lang", "salt"]).join(cells, ["lang", "source", "term"], "left")
    real = F.col("term") != NO_TERM
    dense = written(
        dense.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).select(
            "lang", "source", "term", "n", F.when(real, _share("n", "own", "size")).otherwise(0).alias("p"), F.when(real, _share("total", "all", "size")).otherwise(0).alias("q")
        )
    )
    left = dense.select("lang", "term", "source", "p")
    right = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = left.join(right, ["lang", "term"]).where(F.col("source") < F.col("item"))
    gaps = met.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = gaps.select("lang", both.alias("ends"), "value").select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
