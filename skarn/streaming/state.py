"""Keyed state that lives between micro-batches: expiring caches, sessions' recent tools and nodes, and a watcher of files.

Caches and sessions need the session's state store to be RocksDB
(spark.sql.streaming.stateStore.providerClass), as any query with arbitrary state does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .streams import debounced

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOOLS, NODES = 100, 1_000


def micros(times: pd.Series) -> pd.Series:
    """Timestamps as microseconds since 1970."""
    return times.astype("datetime64[us]").astype("int64")


def _rows(**columns: list) -> pd.DataFrame:
    """Rows as plain objects, since the state's serialiser takes no chunked columns."""
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})


class ExpiringEntry(StatefulProcessor):
    """A cache's entry under one key: its value and when it expires, cleared by a timer if nobody asks again."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.assign(us=micros(frame["at"])).sort_values(["us", "seq"], kind="stable")
        held = self.entry.get() if self.entry.exists() else None
        before, outcomes, values = held, [], []
        for op, us, value, code in zip(frame["op"], frame["us"], frame["value"], frame["exit_code"], strict=True):
            if op == "put":
                # Only what succeeded is kept.
                outcomes.append("stored" if code == 0 else "refused")
                values.append(None)
                held = (value, us + self.seconds * 1_000_000) if code == 0 else held
                continue
            if held is not None and us > held[1]:
                held = None
            outcomes.append("miss" if held is None else "hit")
            values.append(None if held is None else held[0])
        if held is None:
            self.entry.clear()
        elif held != before:
            self.entry.update(held)
            self.handle.registerTimer(held[1] // 1_000 + 1)
        yield _rows(key=[key[0]] * len(frame), seq=frame["seq"].tolist(), op=frame["op"].tolist(), outcome=outcomes, value=values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        """Clear the entry, unless a later one took its place; each row tells what went."""
        held = self.entry.get() if self.entry.exists() else None
        gone = held is not None and held[1] // 1_000 + 1 <= expiredTimerInfo.getExpiryTimeInMs()
        if gone:
            self.entry.clear()
        yield _rows(key=[key[0]] * gone, seq=[-1] * gone, op=["timer"] * gone, outcome=["expired"] * gone, value=[held[0]] * gone if gone else [])

    def close(self) -> None:
        pass


def cached(ops: DataFrame, seconds: int, late: str = "10 seconds") -> DataFrame:
    """(key, seq, op, outcome, value) of cache operations (key, seq, at, op, value, exit_code) as they arrive.

    A `get` is a hit until `seconds` after the key's last `put`, and gives its value; a `put` whose
    exit_code isn't 0 is refused.  Operations of a key count in order of (at, seq).  Entries that
    the watermark has passed go, with a row of outcome `expired`.
    """
    schema = "key string, seq long, op string, outcome string, value string"
    timed = ops.withWatermark("at", late).select("key", "seq", "at", "op", "value", "exit_code")
    return timed.groupBy("key").transformWithStateInPandas(ExpiringEntry(seconds), schema, "Append", "EventTime")


def cached_batch(ops: DataFrame, seconds: int) -> DataFrame:
    """(key, seq, outcome) of the same operations over a whole log, by windows."""
    order = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    put = F.last(F.when((F.col("op") == "put") & (F.col("exit_code") == 0), F.unix_micros(F.col("at").cast("timestamp"))), ignorenulls=True).over(order)
    live = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")) - put <= seconds * 1_000_000, F.lit(False))
    put_out = F.when(F.col("exit_code") == 0, "stored").otherwise("refused")
    return ops.select("key", "seq", F.when(F.col("op") == "put", put_out).when(live, "hit").otherwise("miss").alias("outcome"))


class SessionMemory(StatefulProcessor):
    """A session's last tools, in order, and the first nodes and all files that it touched."""

    def __init__(self, tools: int, nodes: int) -> None:
        self.most_tools, self.most_nodes = tools, nodes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tools = handle.getListState("tools", "tool string")
        self.nodes = handle.getMapState("nodes", "node string", "seen boolean")
        self.files = handle.getMapState("files", "file string", "seen boolean")
        self.counts = handle.getValueState("counts", "calls long, nodes long, files long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"], kind="stable")
        calls, nodes, files = self.counts.get() if self.counts.exists() else (0, 0, 0)
        # Only what the list may still hold is written.
        tools = [t[0] for t in self.tools.get()] if self.tools.exists() else []
        tools = [*tools, *frame["tool"]][-self.most_tools :]
        self.tools.put([(t,) for t in tools])
        for node in frame["node"].dropna().drop_duplicates():
            if nodes < self.most_nodes and not self.nodes.containsKey((node,)):
                self.nodes.updateValue((node,), (True,))
                nodes += 1
        for file in frame["file"].dropna().drop_duplicates():
            if not self.files.containsKey((file,)):
                self.files.updateValue((file,), (True,))
                files += 1
        self.counts.update((calls + len(frame), nodes, files))
        yield _rows(session_id=[key[0]], calls=[calls + len(frame)], tools=[" ".join(tools)], n_nodes=[nodes], n_files=[files])

    def close(self) -> None:
        pass


def sessions(calls: DataFrame, tools: int = TOOLS, nodes: int = NODES) -> DataFrame:
    """(session_id, calls, tools, n_nodes, n_files) after each micro-batch of calls (session_id, seq, at, tool, node, file).

    `tools` are the last so many, oldest first; of nodes the first `nodes` distinct ones count, of
    files all.  Calls of a session count in order of (at, seq) within a micro-batch.
    """
    schema = "session_id long, calls long, tools string, n_nodes long, n_files long"
    return calls.select("session_id", "seq", "at", "tool", "node", "file").groupBy("session_id").transformWithStateInPandas(SessionMemory(tools, nodes), schema, "Update", "None")


class FileTables:
    """What was parsed of files, one folder a micro-batch; the newest of each file counts.

    A batch that is written again replaces its own folder, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark, self.at = spark, at

    def apply(self, touched: DataFrame, rows: DataFrame | None, stream: str, batch: int) -> None:
        """Store a batch: files (file_path, at) and their rows (file_path, ...); without rows they are deleted."""
        touched.select("file_path", "at", F.lit(rows is None).alias("deleted")).write.mode("overwrite").parquet(f"{self.at}/touched/batch={stream}-{batch}")
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{self.at}/rows/batch={stream}-{batch}")

    def current(self) -> DataFrame:
        """The rows of all files as they are now."""
        touched = self.spark.read.parquet(f"{self.at}/touched")
        last = touched.groupBy("file_path").agg(F.max(F.struct("at", "deleted", "batch")).alias("m")).where("not m.deleted")
        rows = self.spark.read.parquet(f"{self.at}/rows")
        return rows.join(last.select("file_path", F.col("m.batch").alias("batch")), ["file_path", "batch"]).drop("batch")


def watch(changes: DataFrame, parse: Callable[[DataFrame], DataFrame], tables: FileTables, checkpoint: str, gap: str = "300 milliseconds", late: str = "10 seconds", **trigger) -> list[StreamingQuery]:
    """Keep `tables` in step with changes (path, ts, deleted): two running queries, of calm files and of deletes.

    A file is parsed anew once no change of it came for `gap`, and deleted at once.  `parse` takes
    files (file_path, at) and gives their rows (file_path, ...); a file without rows has none left.
    """

    def calm(batch: DataFrame, n: int) -> None:
        files = batch.groupBy(F.col("path").alias("file_path")).agg(F.max("last").alias("at")).persist()
        tables.apply(files, parse(files), "calm", n)
        files.unpersist()

    def gone(batch: DataFrame, n: int) -> None:
        tables.apply(batch.groupBy(F.col("path").alias("file_path")).agg(F.max("ts").alias("at")), None, "gone", n)

    # A session ends `gap` after its last change.
    changed = debounced(changes.where("not deleted").select("path", "ts"), gap, late).select("path", (F.col("stop") - F.expr(f"interval {gap}")).alias("last"))
    runs = [(changed, calm, "calm"), (changes.where("deleted"), gone, "gone")]
    return [stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"processingTime": "1 second"})).start() for stream, write, name in runs]
