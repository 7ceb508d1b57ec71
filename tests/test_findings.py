"""Operators whose registered queries have few or no rows on the given tables, on small fixtures."""

from skarn.operators import graph, reports

NODES = "qualified_name string, kind string, file_path string, community_id int"


def graph_of(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "kind string, source string, target string")


def test_isolated_nodes(spark):
    n, e = graph_of(spark, [("a", "Function", "f", 1), ("b", "Function", "f", 1), ("c", "Class", "g", 1), ("d", "Function", "g", 1), ("f", "File", "f", 1)], [("CALLS", "a", "b"), ("CALLS", "b", "c"), ("CALLS", "b", "gone")])
    assert {(r.qualified_name, r.degree) for r in graph.isolated(n, e).collect()} == {("a", 1), ("c", 1), ("d", 0)}


def test_single_file_communities(spark):
    rows = [(f"a{k}", "Function", "one", 1) for k in range(6)] + [(f"b{k}", "Function", f"f{k % 2}", 2) for k in range(6)] + [("c", "Function", "x", 3), ("d", "Function", "x", None)]
    got = graph.single_file_communities(graph_of(spark, rows, [("CALLS", "a0", "a1")])[0]).collect()
    assert [(r.community_id, r.n, r.files) for r in got] == [(1, 6, 1)]


def test_move_suggestions(spark):
    rows = [("helper", "Function", "f", 1), ("own", "Function", "f", 1), ("mixed", "Function", "f", 1), ("x", "Function", "g", 2), ("y", "Function", "g", 2), ("z", "Function", "h", 3), ("lost", "Function", "h", None)]
    edges = [("CALLS", "x", "helper"), ("CALLS", "y", "helper"), ("CALLS", "helper", "own"), ("CALLS", "x", "mixed"), ("CALLS", "z", "mixed"), ("CALLS", "x", "lost"), ("TESTED_BY", "own", "z")]
    got = [tuple(r) for r in graph.move_suggestions(*graph_of(spark, rows, edges)).collect()]
    assert got == [("helper", 1, 2)]


TOTALS = {"n_long_sessions": 0, "error_rate": 0.0, "n_events": 100, "n_compressed": 50, "n_calls": 100, "n_memory": 20, "importance": 0.5, "n_repeated": 0}


def waste(spark, filters=(), **changed):
    totals = spark.createDataFrame([tuple((TOTALS | changed).values())], "n_long_sessions long, error_rate double, n_events long, n_compressed long, n_calls long, n_memory long, importance double, n_repeated long")
    used = spark.createDataFrame(list(filters), "filter string, n long, avg_pct double")
    every = spark.createDataFrame([(x,) for x in ("a", "b", "c")], "filter string")
    return {tuple(r) for r in reports.waste(totals, used, every).collect()}


def test_each_detector_of_waste(spark):
    used = [("a", 9, 50.0)]
    assert waste(spark, used) == set()
    assert waste(spark, [("a", 5, 4.9), ("b", 4, 1.0)]) == {("empty_filter", "low", "a", 0)}
    assert waste(spark) == {("idle_filters", "low", "3 filters", 0)}
    assert waste(spark, used, n_long_sessions=2) == {("session_bloat", "medium", "", 100_000)}
    assert waste(spark, used, error_rate=0.5) == {("error_churn", "medium", "", 10_000)}
    assert waste(spark, used, n_compressed=9) == {("compression_off", "medium", "", 80_000)}
    assert waste(spark, used, importance=0.2) == {("memory_neglect", "medium", "", 0)}
    assert waste(spark, used, n_repeated=3) == {("repeated_ingestion", "low", "", 6_000)}
