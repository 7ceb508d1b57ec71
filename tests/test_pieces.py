"""Filters, sources, sinks, walks and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from skarn.functions import filters, text
from skarn.operators import traverse
from skarn.sources import files, sinks
from skarn.streaming import streams

from .conftest import SMALL


def test_rule_names_are_unique_and_many():
    names = [r.name for r in filters.RULES]
    assert len(names) == len(set(names)) == 76


def test_filter_outputs(spark):
    long = "\n".join(f"line {i}" for i in range(300))
    rows = [
        ("FOO=1 cat big.txt", long), ("tsc -p .", "a.ts(1,2): error TS1005: x\nb.ts(3,4): error TS2304: y\nc.ts(1,1): error TS1005: z"),
        ("env", "B_TOKEN=abcdefghijk\nA=1"), ("unknown", "stays"), ("journalctl -f", "2024-01-01T00:00:00 10.0.0.1 up\n2024-01-01T00:00:05 10.0.0.2 up\n2024-01-01T00:00:09 10.0.0.2 up"),
        ("git status", "\n".join(["M  a", " M b"] + [f"?? {k}" for k in range(90)])),
    ]
    got = {r["rule"]: r["filtered"] for r in filters.filter_outputs(spark.createDataFrame(rows, "command string, stdout string"), ["cat", "tsc", "env", "log_dedup", "git_status"]).collect()}
    assert "200 lines omitted" in got["cat"] and got["cat"].endswith("line 299")
    # Three short lines are shorter than their summary (test_summaries has those).
    assert got["tsc"] == rows[1][1]
    assert got["env"] == "A=1\nB_TOKEN=***"
    assert got[None] == "stays"
    assert got["log_dedup"].count("\n") == 0
    assert "? Untracked: 90 files" in got["git_status"]


@pytest.mark.parametrize(
    "level,said,want",
    [
        ("lite", "Sure, I really need to use it in order to win.", "I need to use it to win."),
        ("full", "However, the cat saw a dog.", "cat saw dog."),
        ("ultra", "the database configuration", "DB config"),
        ("ultra", "```\nthe database\n```", "```\nthe database\n```"),
    ],
)
def test_compress(spark, level, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(text.compress(F.col("t"), level)).first()[0] == want


def test_html_to_text(spark):
    page = "<html><style>p{}</style><script>var a='</p>';</script><!-- x --><p>One &amp; <b>two</b></p><div>three&nbsp;four</div></html>"
    assert spark.createDataFrame([(page,)], "h string").select(text.html_to_text(F.col("h"))).first()[0] == "One & two\nthree four"


def test_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("class A(B):\n    def f(self, x):\n        return g(x)\n\ndef g(x):\n    return x\n\ndef test_g():\n    assert g(1)\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text("x = 1")
    (tmp_path / "c.bin").write_bytes(b"ab\x00c")
    found = files.scan(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"a.py", "bad.py", "c.bin"}
    assert [r[0].rsplit("/", 1)[1] for r in found.where(files.is_binary(F.col("content"))).select("path").collect()] == ["c.bin"]
    symbols = files.python_symbols(found)
    assert sorted((r.kind, r.name) for r in symbols.collect()) == [("Class", "A"), ("Function", "f"), ("Function", "g"), ("Test", "test_g")]
    edges = {(r.kind, r.source.split("::")[1], r.target.split("::")[1]) for r in files.symbol_edges(symbols).collect()}
    assert edges == {("CALLS", "A.f", "g"), ("CALLS", "test_g", "g"), ("TESTED_BY", "g", "test_g")}


def test_route(spark):
    rows = spark.createDataFrame([("a.PY", ""), ("x/openapi.yaml", "openapi: 3"), ("b.yaml", "k: v"), ("c.unknown", ""), ("d.png", "")], "p string, h string")
    assert [r[0] for r in rows.select(files.route(F.col("p"), F.col("h"))).collect()] == ["code", "api_spec", "config", "document", "image"]


def test_diff_hunks(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n--- a/y.py\n+++ b/y.py\n@@ -1,2 +7,0 @@\n"
    got = files.diff_hunks(spark.createDataFrame([(diff,)], "text string")).collect()
    assert sorted(map(tuple, got)) == [("x.py", 3, 6), ("x.py", 12, 12), ("y.py", 7, 7)]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("a", 5, 2)], "k string, v int, at int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], "at").select("k", "v").collect())) == [("a", 5), ("b", 2)]
    assert sorted(map(tuple, sinks.replace_by_key(old, new, "k").select("k", "v").collect())) == [("a", 5), ("b", 2)]
    node = spark.createDataFrame([("Function", 'f<"', "a::f'")], "kind string, name string, qualified_name string")
    assert sinks.graphml_nodes(node).first()[0] == '<node id="a::f\'"><data key="name">f&lt;&quot;</data><data key="kind">Function</data></node>'
    assert sinks.cypher_nodes(node).first()[0].startswith("MERGE (n:Function {qualified_name: 'a::f\\''})")


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y")], "source string, target string")
    assert [r.node for r in traverse.shortest_path(edges, "a", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert traverse.shortest_path(edges, "a", "x").count() == 0


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files=10)
    streams.run_available(streams.daily_counts(stream), "daily", str(tmp_path / "c1"), "complete")
    want = events.groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").count()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, want.collect()))
    streams.run_available(streams.first_seen(stream.unionAll(stream), "event_id"), "seen", str(tmp_path / "c2"))
    assert spark.table("seen").count() == events.count()
    streams.run_available(streams.online_chain(stream), "steps", str(tmp_path / "c3"))
    assert spark.table("steps").count() == events.count() - events.select("user_id").distinct().count()


def test_online_chain_across_triggers(spark, tmp_path):
    """One file a trigger: steps between triggers come from the state."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id < 3")
    for k, part in enumerate(events.orderBy("ts", "event_id").toPandas().groupby(lambda i: i // 20)):
        spark.createDataFrame(part[1]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "000")).schema
    stream = streams.event_stream(spark, str(tmp_path / "in" / "*"), schema, files=1)
    streams.run_available(streams.online_chain(stream), "chain", str(tmp_path / "c"))
    rows = sorted((r.user_id, r.ts, r.event_id, r.event_type) for r in events.collect())
    want = sorted((a[0], a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0])
    assert sorted(map(tuple, spark.table("chain").collect())) == want


def test_debounced(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.2"), ("a", "2024-01-01 00:00:01.0"), ("b", "2024-01-01 00:00:00.1"), ("z", "2024-01-02 00:00:00.0")]
    changes = spark.createDataFrame(rows, "path string, t string").select("path", F.col("t").cast("timestamp").alias("ts"))
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.debounced(stream), "calm", str(tmp_path / "c"), "append")
    assert {(r.path, r.n) for r in spark.table("calm").collect()} <= {("a", 2), ("a", 1), ("b", 1), ("z", 1)}
    batch = streams.debounced(changes)
    assert sorted((r.path, r.n) for r in batch.collect()) == [("a", 1), ("a", 2), ("b", 1), ("z", 1)]
