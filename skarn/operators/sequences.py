"""Order-dependent operators: caps on running sizes, latest rows, expiring caches, last errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sums import sums_before
from .traverse import settled


def output_cap(rows: DataFrame, group: str, order: str, cap: int, partial: int = 100) -> DataFrame:
    """Each group's texts in order up to `cap` bytes; the one that crosses it is cut if over `partial` bytes are left.

    A null text has no size and is left out, as are texts after the cap.  `order` tells a group's rows apart.
    """
    sized = rows.select(group, order, F.octet_length("text").cast("long").alias("size")).where("size is not null")
    ranked = sums_before(sized, F.col(group), [order], "size", "before", settled).withColumn("left", F.lit(cap) - F.col("before"))
    fits, cut = F.col("size") <= F.col("left"), F.col("left") > partial
    return ranked.where(fits | cut).select(group, order, F.when(fits, F.col("size")).otherwise(F.col("left")).cast("long").alias("kept_bytes"), (~fits).alias("cut"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The `value` of the row of greatest `order` for each key."""
    return rows.groupBy(key).agg(F.max(F.struct(order, value)).alias("m")).select(key, F.col(f"m.{order}").alias(order), F.col(f"m.{value}").alias(value))


def ttl_hits(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Hits and misses of a cache whose entries expire: a hit is within `seconds` of the last access of its key."""
    last = F.lag("created_at").over(Window.partitionBy(*keys).orderBy("created_at", "id"))
    age = F.unix_timestamp(F.col("created_at").cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    hits = events.withColumn("hit", F.coalesce(age <= seconds, F.lit(False)))
    return hits.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def last_of_type(events: DataFrame, kind: str, n: int) -> DataFrame:
    """Each session's last n events of a type, newest first."""
    order = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    some = events.where(F.col("event_type") == kind).withColumn("place", F.row_number().over(order))
    return some.where(F.col("place") <= n).select("session_id", "place", "id")


def session_guides(events: DataFrame) -> DataFrame:
    """One row a session: its last event, errors not followed by a purchase, and its commonest event type."""
    fixed = events.where("event_type = 'purchase'").groupBy("session_id").agg(F.max("created_at").alias("fixed_at"))
    opened = events.where("event_type = 'error'").join(fixed, "session_id", "left").where(F.col("fixed_at").isNull() | (F.col("created_at") > F.col("fixed_at")))
    errors = opened.groupBy("session_id").agg(F.count("*").alias("open_errors"))
    counts = events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    common = counts.groupBy("session_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("m")).select("session_id", F.col("m.event_type").alias("commonest"))
    last = latest(events.withColumn("k", F.struct("created_at", "id")), "session_id", "k", "event_type").select("session_id", F.col("event_type").alias("last_event"))
    return last.join(common, "session_id").join(errors, "session_id", "left").select("session_id", "last_event", "commonest", F.coalesce("open_errors", F.lit(0)).alias("open_errors"))


def chunk_paragraphs(docs: DataFrame, most: int = 4_096) -> DataFrame:
    """(doc_id, part, text): paragraphs (blank-line separated) packed in order into chunks of at most `most` characters.

    A paragraph starts a new chunk when it, the chunk so far and the blank line between exceed
    `most`; a longer one is a chunk of its own.  Each row is folded by itself, so nothing is shuffled
    and rows that share an id stay apart.
    """
    parts = F.filter(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?s)(?:(?!\n\s*\n).)+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(state, part):
        fits = (state["n"] == 0) | (F.length(state["open"]) + F.length(part) + 2 <= most)
        done = F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        grown = F.when(state["n"] == 0, part).when(fits, F.concat(state["open"], F.lit("\n\n"), part)).otherwise(part)
        return F.struct(done.alias("done"), grown.alias("open"), (state["n"] + 1).alias("n"))

    def chunks(state):
        return F.when(state["n"] == 0, state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))

    return docs.select("doc_id", F.posexplode(F.aggregate(parts, start, add, chunks)).alias("part", "text"))
