"""State between micro-batches against whole logs: caches, sessions, and a watcher that is stopped and started."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skarn.operators import sequences, sessions
from skarn.streaming import state

from .conftest import SMALL


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(stream, name, checkpoint, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_cache_equals_the_batch_form(rocks, tmp_path):
    """The events as accesses that look up and then store, in six files, so six triggers at least."""
    spark, keys = rocks, ["user_id", "event_type"]
    events = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    key = F.concat_ws(":", *keys).alias("key")
    seq = F.col("event_id") * 2
    code = F.lit(0)
    ops = events.select(key, seq.alias("seq"), "at", F.lit("get").alias("op"), F.lit(None).cast("string").alias("value"), code.alias("exit_code"))
    ops = ops.unionAll(events.select(key, seq + 1, "at", F.lit("put"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 9 == 0, 1).otherwise(0)))
    for part, (lo, hi) in enumerate([(0, 0.2), (0.2, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.1)]):
        place = F.percent_rank().over(Window.orderBy("at"))
        ops.withColumn("p", place).where((F.col("p") >= lo) & (F.col("p") < hi)).drop("p").coalesce(1).write.mode("append" if part else "overwrite").parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    query = run(state.cached(stream, 3_600, "0 seconds"), "cache", str(tmp_path / "cp"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 5
    got = {(r.key, r.seq): r.outcome for r in spark.table("cache").where("op <> 'timer'").collect()}
    want = {(r.key, r.seq): r.outcome for r in state.cached_batch(ops, 3_600).collect()}
    assert got == want and {"hit", "miss", "stored", "refused"} <= set(got.values())
    assert spark.table("cache").where("outcome = 'expired'").count() > 0
    # Where every access is stored, hits and misses are those of the cache's batch form.
    every = events.select(*keys, F.col("event_id").alias("id"), F.col("at").alias("created_at"))
    counts = {r.event_type: (r.hits, r.misses) for r in sequences.ttl_hits(every, keys, 3_600).collect()}
    all_stored = state.cached_batch(ops.withColumn("exit_code", F.lit(0)), 3_600).where("outcome in ('hit', 'miss')")
    mine = all_stored.groupBy(F.substring_index("key", ":", -1).alias("t")).agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"))
    assert {r.t: (r.hits, r.misses) for r in mine.collect()} == counts


def test_sessions_equal_the_batch_form(rocks, tmp_path):
    spark, rng = rocks, random.Random(1)
    rows = [(rng.randrange(3), k, f"t{rng.randrange(9)}", f"n{rng.randrange(40)}" if rng.random() < 0.8 else None, f"f{rng.randrange(5)}" if rng.random() < 0.3 else None) for k in range(200)]
    calls = spark.createDataFrame(rows, "session_id long, seq long, tool string, node string, file string").withColumn("at", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    for k in range(4):
        calls.where((F.col("seq") >= 50 * k) & (F.col("seq") < 50 * k + 50)).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    run(state.sessions(stream, tools=10, nodes=15), "sessions", str(tmp_path / "cp"), "update")
    last = {r.session_id: r for r in spark.table("sessions").orderBy("calls").collect()}
    want = {r.session_id: r.tools for r in sessions.last_tools(calls.select("session_id", F.col("seq").alias("at"), "tool"), 10).collect()}
    assert {s: r.tools for s, r in last.items()} == want
    for s, r in last.items():
        own = [x for x in rows if x[0] == s]
        assert (r.calls, r.n_nodes, r.n_files) == (len(own), min(15, len({x[3] for x in own if x[3]})), len({x[4] for x in own if x[4]}))


def test_watcher(spark, tmp_path):
    """Stopped and started between triggers: calm files are parsed, deletes applied, replays change nothing."""
    content = tmp_path / "content"
    content.mkdir()
    put = lambda name, *words: (content / name).write_text("\n".join(words))

    def parse(files):
        read = spark.read.text(f"{content}/*").withColumn("name", F.element_at(F.split("_metadata.file_path", "/"), -1))
        return read.join(files.select("file_path"), F.col("name") == F.col("file_path")).select("file_path", F.col("value").alias("symbol"))

    base = 1_700_000_000.0

    def say(*rows):
        frame = spark.createDataFrame([(p, base + t, d) for p, t, d in rows], "path string, t double, deleted boolean")
        frame.select("path", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "deleted").coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))

    tables = state.FileTables(spark, str(tmp_path / "tables"))

    def step():
        stream = spark.readStream.schema("path string, ts timestamp, deleted boolean").parquet(str(tmp_path / "changes"))
        for query in state.watch(stream, parse, tables, str(tmp_path / "cp"), late="0 seconds", availableNow=True):
            query.awaitTermination()

    now = lambda: {(r.file_path, r.symbol) for r in tables.current().collect()}
    put("a", "one", "two")
    put("b", "three")
    say(("a", 0, False), ("a", 0.1, False), ("a", 0.2, False), ("b", 0.3, False), ("tick", 5, False))
    step()
    assert now() == {("a", "one"), ("a", "two"), ("b", "three")}
    put("a", "new")
    say(("a", 10, False), ("b", 10.5, True), ("tick", 20, False))
    step()
    assert now() == {("a", "new")}
    step()
    assert now() == {("a", "new")}
    # A batch that is written again replaces itself.
    files = spark.createDataFrame([("a", base + 10)], "file_path string, t double").select("file_path", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("at"))
    for _ in range(2):
        tables.apply(files.withColumn("at", F.col("at") + F.expr("interval 1 hour")), parse(files), "calm", 99)
    assert now() == {("a", "new")}
    put("b", "back")
    say(("b", 4_000, False), ("tick", 4_010, False))
    step()
    assert now() == {("a", "new"), ("b", "back")}
