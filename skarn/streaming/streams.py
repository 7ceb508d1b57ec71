"""Structured Streaming forms: append logs, trends with watermarks, debounced changes, online chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """Events as their Parquet files arrive in a folder; `ts` becomes a timestamp that watermarks take."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type; a day closes once the watermark passes it."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: repeated deliveries go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def debounced(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Changes (path, ts) of a path without a pause of `gap` as one change: its first and last times."""
    s = F.session_window("ts", gap)
    return changes.withWatermark("ts", late).groupBy(s, "path").agg(F.count("*").alias("n")).select("path", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def online_chain(events: DataFrame) -> DataFrame:
    """Steps (user_id, src, dst) between a user's successive events, with the last one as state.

    A micro-batch's rows of a user are ordered and shifted whole; their number is bounded by what a
    trigger takes (`files` of `event_stream`).
    """
    import pandas as pd

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        src = rows["event_type"].shift()
        if state.exists:
            src.iloc[0] = state.get[0]
        state.update((rows["event_type"].iloc[-1],))
        steps = pd.DataFrame({"user_id": key[0], "src": src, "dst": rows["event_type"]})
        yield steps[steps["src"].notna()]

    schema = "user_id long, src string, dst string"
    return events.groupBy("user_id").applyInPandasWithState(step, schema, "last string", "append", "NoTimeout")


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, into an in-memory table (tests) under a name."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
