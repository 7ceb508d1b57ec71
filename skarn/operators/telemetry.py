"""Aggregates over telemetry, sessions, memory and runs.

Each is one hash aggregation (partial before the shuffle) over a pruned scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_pct(before: Column, after: Column) -> Column:
    """Savings in per cent, 0 where there was nothing to save."""
    return F.when(before > 0, (before - after) / before * 100.0).otherwise(0.0)


def savings(events: DataFrame) -> DataFrame:
    """Add `saved_tokens` and `savings_pct` to events with before_tokens and after_tokens."""
    before, after = F.col("before_tokens"), F.col("after_tokens")
    return events.withColumns({"saved_tokens": before - after, "savings_pct": guarded_pct(before, after)})


def _totals() -> list[Column]:
    return [
        F.count("*").alias("n_events"),
        F.coalesce(F.sum("before_tokens"), F.lit(0)).cast("long").alias("sum_before"),
        F.coalesce(F.sum("after_tokens"), F.lit(0)).cast("long").alias("sum_after"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).cast("long").alias("sum_saved"),
        F.round(F.coalesce(F.avg("savings_pct"), F.lit(0.0)), 1).alias("avg_pct"),
    ]


def compression_summary(events: DataFrame) -> DataFrame:
    """Totals over compression events; zeros when there are none."""
    return savings(events).where(F.col("event_type") == "compress").agg(*_totals())


def breakdown(events: DataFrame, key: str) -> DataFrame:
    """Totals of compression events by tool, intensity or filter."""
    return savings(events).where(F.col("event_type") == "compress").groupBy(key).agg(*_totals())


def disclosure(events: DataFrame) -> DataFrame:
    """Counts by level of detail and the share of full ones, in per cent."""
    full, index = F.count_if(F.col("detail_level") == "full"), F.count_if(F.col("detail_level") == "index")
    return events.agg(
        index.alias("n_index"),
        full.alias("n_full"),
        F.round(F.when(full + index > 0, full / (full + index) * 100.0).otherwise(0.0), 2).alias("upgrade_rate"),
    )


def daily_trend(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Totals by day in the days before `as_of`."""
    recent = F.col("created_at") >= F.expr(f"cast('{as_of}' as timestamp_ntz) - interval {int(days)} days")
    return savings(events).where(recent).groupBy(F.to_date("created_at").alias("day")).agg(*_totals())


def filter_performance(events: DataFrame, name: str) -> DataFrame:
    """Average savings of one filter; 0 where it never ran."""
    return savings(events).where(F.col("tool_name") == name).agg(F.round(F.coalesce(F.avg("savings_pct"), F.lit(0.0)), 2).alias("avg_pct"))


def merged_trends(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two daily series (day, value) summed by day: a full outer merge as union and sum."""
    return one.unionByName(other).groupBy("day").agg(F.sum("value").cast("long").alias("value"))


def busy_sessions(events: DataFrame, more_than: int) -> DataFrame:
    """Sessions of more than so many events, with their error rate."""
    errors = F.count_if(F.col("event_type") == "error")
    return (
        events.groupBy("session_id")
        .agg(F.count("*").alias("n_events"), errors.alias("n_errors"), F.round(errors / F.count("*"), 4).alias("error_rate"))
        .where(F.col("n_events") > more_than)
    )


def event_counts(events: DataFrame, session_id: int) -> DataFrame:
    return events.where(F.col("session_id") == session_id).groupBy("event_type").agg(F.count("*").alias("n"))


def session_totals(events: DataFrame) -> DataFrame:
    """Events, sessions, errors and the share of errors."""
    errors = F.count_if(F.col("event_type") == "error")
    return events.agg(
        F.count("*").alias("n_events"),
        F.count_distinct("session_id").alias("n_sessions"),
        errors.alias("n_errors"),
        F.round(F.when(F.count("*") > 0, errors / F.count("*")).otherwise(0.0), 4).alias("error_rate"),
    )


def redundant_hashes(runs: DataFrame, more_than: int) -> DataFrame:
    """Contents that were ingested more than so many times."""
    return runs.groupBy("file_hash").agg(F.count("*").alias("n_runs")).where(F.col("n_runs") > more_than)


def runs_by_pipeline(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline").agg(F.count("*").alias("n_runs"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"))


def memory_stats(observations: DataFrame) -> DataFrame:
    """Active and archived counts by type, average importance and the age range."""
    return observations.groupBy("type").agg(
        F.count_if(~F.col("archived")).alias("active"),
        F.count_if("archived").alias("archived"),
        F.round(F.avg("importance"), 3).alias("avg_importance"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def importance_histogram(observations: DataFrame) -> DataFrame:
    """Observations in five equal buckets of importance; 1.0 is in the last."""
    bucket = F.least(F.floor(F.col("importance") * 5), F.lit(4)).cast("int")
    return observations.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def reuse_value(observations: DataFrame, tokens: int = 200) -> DataFrame:
    """Share of archived observations and the tokens their reuse saved."""
    return observations.agg(
        F.round(F.count_if("archived") / F.greatest(F.count("*"), F.lit(1)), 4).alias("archive_rate"),
        (F.coalesce(F.sum("access_count"), F.lit(0)) * tokens).cast("long").alias("reuse_tokens"),
    )


def duplicate_keepers(observations: DataFrame) -> DataFrame:
    """Of active observations of equal type and title: the most important (then least id), with all accesses."""
    same = Window.partitionBy("title", "type")
    ranked = observations.where(~F.col("archived")).withColumns(
        {
            "n": F.count("*").over(same),
            "accesses": F.sum("access_count").over(same),
            "place": F.row_number().over(same.orderBy(F.desc("importance"), "id")),
        }
    )
    return ranked.where("n > 1").select("id", "title", "type", "n", "accesses", (F.col("place") > 1).alias("archive"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by kind, in one frame."""
    n = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    e = edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    return n.unionAll(e)


def unified_stats(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column's values, empty ones as unknown, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("what"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("value")) for c in columns])
    return nodes.select(F.explode(pairs).alias("p")).groupBy("p.what", "p.value").agg(F.count("*").alias("n"))


def transitions(events: DataFrame) -> DataFrame:
    """A first-order Markov chain: each step between a session's successive states, counted, with its probability."""
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    steps = events.withColumn("next", F.lead("event_type").over(order)).where(F.col("next").isNotNull())
    counts = steps.groupBy(F.col("event_type").alias("src"), F.col("next").alias("dst")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("src"))
    return counts.withColumn("probability", F.round(share, 6))


def predict_next(chain: DataFrame, k: int = 3) -> DataFrame:
    """The k likeliest next states of each state."""
    order = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return chain.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("src", "place", "dst", "probability")
