"""What keeps the graph's steps small: tables between steps, and keys that are numbers while rows are dealt out."""

import re

import duckdb
from pyspark.sql import functions as F

from skarn import catalog, catalog_code, catalog_more
from skarn.functions import filters, scalars, text
from skarn.operators import community, depth, graph, reports, traverse
from skarn.plans import adapters

from .conftest import SMALL


def keys_of_plan(df):
    """The keys of each exchange and aggregation, as the plan writes them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [k.split("functions=")[0] for k in re.findall(r"(?:HashAggregate\(keys=|hashpartitioning)([^\n]*)", plan)]


def test_settled_tables_are_compressed_files(spark):
    rows = spark.range(1_000).select(F.lit("a name that comes again").alias("node"), F.lit(None).cast("string").alias("parent"))
    kept = traverse.settled(rows)
    assert kept.count() == 1_000 and kept.dtypes == rows.dtypes
    assert kept.inputFiles() and all(f.endswith(".parquet") for f in kept.inputFiles())
    assert traverse.settled(rows.where("false")).count() == 0


def test_edges_are_made_distinct_as_numbers(spark):
    keys = keys_of_plan(adapters.derived_edges(spark, SMALL))
    assert keys and not [k for k in keys if "concat" in k or "kind" in k]


def test_betweenness_deals_out_numbers(spark, monkeypatch):
    dealt = []
    settled = traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df: dealt.append(df) or settled(df))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("a", "a")], "source string, target string")
    pivots = spark.createDataFrame([("a",), ("lone",), (None,)], "node string")
    got = {r.node: r.score for r in traverse.betweenness(edges, pivots).collect()}
    assert got == {"b": 3.0, "c": 0.5, "d": 0.5}
    levels = [df for df in dealt if "pivot" in df.columns]
    assert levels and all(t in ("bigint", "double", "int") for df in levels for _, t in df.dtypes)


def test_a_count_rule_splits_its_output_once(spark):
    made = str(filters.count(5, **filters.TESTS)(F.col("stdout")))
    assert made.count("split(") == 1
    assert str(filters.match_rule(F.col("command"))).count("regexp_replace(") == 1


def test_label_rounds_deal_out_numbers(spark, monkeypatch):
    kept = []
    settled = traverse.settled
    monkeypatch.setattr(community, "settled", lambda df: kept.append(df) or settled(df))
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "c", "d", "lone", None)], "qualified_name string")
    edges = spark.createDataFrame([("CALLS", "b", "a"), ("CALLS", "c", "d"), ("CALLS", "d", "c"), ("CALLS", "d", "outside"), ("CALLS", "a", "a"), ("CALLS", "a", None)], "kind string, source string, target string")
    got = {(r.node, r.community) for r in community.propagate(nodes, edges, 1).collect()}
    assert got == {("c", "d"), ("outside", "d")}  # communities of one are left out
    assert [df.dtypes for df in kept if "label" in df.columns] == [[("node", "bigint"), ("label", "bigint")]] * 2


def test_large_tables_are_dealt_to_tasks_by_their_size(spark, monkeypatch):
    want = sorted(map(tuple, adapters.derived_edges(spark, SMALL).collect()))
    monkeypatch.setattr(adapters, "tasks_for", lambda *_: 9)
    many = adapters.derived_edges(spark, SMALL)
    assert sorted(map(tuple, many.collect())) == want
    assert many._jdf.queryExecution().executedPlan().toString().count(", 9), REPARTITION_BY_NUM") >= 1


def test_a_task_for_each_few_megabytes(spark, tmp_path):
    spark.range(2_000_000).selectExpr("xxhash64(id) as x").write.parquet(str(tmp_path / "t.parquet"))
    assert adapters.tasks_for(spark, SMALL, ["nation"]) == 1
    assert adapters.tasks_for(spark, str(tmp_path), ["t"]) == 4


def test_a_body_is_split_and_its_indent_found_once(spark):
    assert str(scalars.body_hash(F.col("text"))).count("split(") == 1
    rows = spark.createDataFrame([("    a\n      b\n\n    c\n",), ("a\n  b\n\nc",), ("\ta\n\n\tb",), ("a\n\nb",)], "text string")
    got = [r.h for r in rows.select(scalars.body_hash(F.col("text")).alias("h")).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]


def test_odd_texts_and_sizes_are_hashed_as_the_sql_says(spark, tmp_path):
    texts = [None, "", "a", "a\n", "a\n\n", "\n", "\n\n", "  ", " \n\t\n ", "  a\n    b\n\n  c\n", "     \n  x", "a\n  ", "a\n\r", "a\r\nb\r\n", "a\n\u2028", "\n a\n ", "\ta\n  b"]
    sizes = [None, -1, 0, 1023, 1024, 3328, 1_048_575, 1_048_576, 1_101_005, 77_194_200_000]
    rows = [(k, t, len(t or "")) for k, t in enumerate(texts)] + [(1, "x", n) for n in sizes] + [(None, "x", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(catalog.oracle_sql()["content_hashes"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["content_hashes"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


def test_a_text_is_read_once_to_be_compressed_and_documents_are_dealt_out(spark, monkeypatch):
    assert str(text.compress(F.col("said"), "ultra")).count("said") == 1
    monkeypatch.setattr(adapters, "tasks_for", lambda *_: 9)
    assert ", 9), REPARTITION_BY_NUM" in catalog_code._responses(spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_steps_run_where_a_word_of_theirs_is(spark):
    said = ["is able in order to go", "IN ORDER TO go", "However\tso that the database, is", "a  word, in order to", "", None]
    for level in ("lite", "full", "ultra"):
        plain = F.col("t")
        for step in text.replacements(level):
            plain = text.without_words(plain, step) if isinstance(step, list) else F.regexp_replace(plain, *step)
        rows = spark.createDataFrame([(t,) for t in said], "t string").coalesce(1).select(plain.alias("plain"), text.replaced(F.col("t"), level).alias("got")).collect()
        assert [r.got for r in rows] == [r.plain for r in rows]


def test_flows_keep_only_the_calls_that_lead_on(spark, monkeypatch):
    kept = []
    settled = traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    entries = spark.createDataFrame([("a",), ("b",), ("self",), ("lone",)], "entry string")
    calls = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("y", "z"), ("z", "y"), ("z", "a"), ("self", "self"), ("far", "x"), ("a", None)], "source string, target string")
    got = {tuple(r) for r in traverse.traced(entries, calls).collect()}
    assert got == {("a", "a", 0), ("a", "x", 1), ("a", "y", 1), ("a", None, 1), ("a", "z", 2), ("b", "b", 0), ("b", "y", 1), ("b", "z", 2), ("b", "a", 3), ("b", "x", 4), ("b", None, 4)}
    steps = [df for df in kept if df.columns == ["node", "next"]]
    assert sorted(r.node for df in steps for r in df.collect()) == ["a", "a", "a", "y", "z", "z"]  # not those of b, self and far
    assert traverse.traced(entries, calls, 0).isEmpty()


def test_walks_keep_no_table_of_all_steps(spark, monkeypatch):
    kept = []
    settled = traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "c"), ("far", "out"), ("c", None)], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    reached = lambda **how: {tuple(r) for r in traverse.reach(edges, seeds, 3, **how).collect() if r.node}
    assert reached() == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert reached(directed=True) == {("a", 0), ("b", 1), ("c", 2)}
    assert kept and not [df for df in kept if "next" in df.columns]


def test_trees_keep_no_table_of_all_steps(spark, monkeypatch):
    kept = []
    settled = traverse.settled
    monkeypatch.setattr(depth, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "c"), ("far", "out"), ("c", None)], "source string, target string")
    assert {tuple(r) for r in depth.shortest_tree(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {("a", None, 0), ("b", "a", 1), ("c", "b", 2)}
    assert kept and not [df for df in kept if "next" in df.columns]


def test_a_shortest_path_is_walked_from_both_ends(spark, monkeypatch):
    kept = []
    settled = traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    pairs = [("a", "m"), ("a", "k"), ("m", "p"), ("k", "p"), ("k", "q"), ("q", "z"), ("p", "z"), ("z", "end"), ("a", None)] + [("z", "h")] + [("h", f"leaf{k}") for k in range(50)] + [("one", "two")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    path = lambda a, b: [r.node for r in traverse.shortest_path(edges, a, b).orderBy("step").collect()]
    assert path("a", "end") == ["a", "k", "p", "z", "end"]
    assert path("end", "a") == ["end", "z", "p", "k", "a"]
    assert path("a", "k") == ["a", "k"] and path("a", "a") == ["a"] and path("a", "one") == path("a", "nowhere") == []
    kept.clear()
    traverse.shortest_path(edges, "end", "a")
    assert not [r.node for df in kept for r in df.collect() if r.node.startswith("leaf")]


def test_risks_copy_no_stored_table(spark, monkeypatch):
    kept = []
    settled = traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df: kept.append(df.columns) or settled(df))
    assert not catalog_more._risks(spark, SMALL).isEmpty()
    assert kept and not [c for c in kept if "kind" in c]


def test_spans_of_lines_meet_changed_ranges_once(spark, monkeypatch):
    met = []
    binned = graph.binned
    monkeypatch.setattr(graph, "binned", lambda df, *ends: met.append(df) or binned(df, *ends))
    rows = [(f"f{k}", "a.py", 10, 70 if k % 2 else 20) for k in range(40)] + [("back", "a.py", 9, 3), ("b", "b.py", 10, 70), ("f0", "a.py", 10, 20), ("none", None, 10, 70)]
    nodes = spark.createDataFrame(rows, "qualified_name string, file_path string, line_start int, line_end int")
    ranges = spark.createDataFrame([("a.py", 60, 66), ("a.py", 21, 30), (None, 1, 99)], "file_path string, start int, stop int")
    got = [r.qualified_name for r in graph.range_overlap(nodes, ranges).collect()]
    assert sorted(got) == sorted(f"f{k}" for k in range(1, 40, 2))
    assert met[0].count() == 4


def test_a_report_of_changes_follows_the_flows_through_them_alone(spark, monkeypatch):
    kept = []
    settled = traverse.settled
    monkeypatch.setattr(traverse, "settled", lambda df: kept.append(settled(df)) or kept[-1])
    rows = [(n, "Function", n, "a.py", n == "t", k % 2) for k, n in enumerate(["a", "b", "c", "x", "y", "t"])]
    nodes = spark.createDataFrame(rows, "qualified_name string, kind string, name string, file_path string, is_test boolean, community_id int")
    edges = spark.createDataFrame([("CALLS", "a", "x"), ("CALLS", "x", "y"), ("CALLS", "b", "x"), ("CALLS", "c", "t"), ("TESTED_BY", "y", "t")], "kind string, source string, target string")
    through = traverse.flows(nodes, edges, through=spark.createDataFrame([("y",)], "node string"))
    assert {r.entry for r in through.collect()} == {"a", "b"}
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.125)], "entry string, criticality double")
    of = spark.createDataFrame([("y",), ("x",)], "qualified_name string")
    risks = lambda members, some: {tuple(r) for r in reports.risk(nodes, edges, members.join(scores, "entry"), reports.tests_near(edges), some).collect()}
    every = risks(traverse.flows(nodes, edges), None)
    assert len(every) == 6 and risks(through, of) == {r for r in every if r[0] in ("x", "y")}


def test_edges_are_not_sorted_to_meet_nodes(spark):
    nodes = spark.createDataFrame([("a", "Class", "x.py", False, 1), ("b", "Function", "y.md", True, 2), ("c", "Function", "x.py", False, None)], "qualified_name string, kind string, file_path string, is_test boolean, community_id int")
    edges = spark.createDataFrame([("CALLS", "a", "b"), ("CALLS", "a", "c"), ("CONTAINS", "c", "a"), ("CALLS", "a", "out")], "kind string, source string, target string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored, files = graph.surprising(nodes, edges, 5), graph.roll_up(nodes, edges)
        assert [tuple(r) for r in scored.collect()] == [("CALLS", "a", "b", 0.8), ("CALLS", "a", "c", 0.15)]
        assert [tuple(r) for r in files.collect()] == [("x.py", "y.md", 1)]
        for df in (scored, files):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_made_distinct_as_numbers_once(spark, monkeypatch):
    kept = []
    settled = catalog_code.settled
    monkeypatch.setattr(catalog_code, "settled", lambda df: kept.append(df) or settled(df))
    project = catalog_code._project(spark, SMALL)
    assert [k for df in kept for k in keys_of_plan(df) if "l_partkey" in k] and not [k for df in kept for k in keys_of_plan(df) if "concat" in k or "as string" in k]
    assert not [f for f in project["imports"].inputFiles() if "lineitem" in f]
