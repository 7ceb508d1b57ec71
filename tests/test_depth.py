"""Depth-first places against a recursive walk."""

import random

from skarn.operators import depth


def test_preorder_equals_a_recursive_walk(spark):
    rng = random.Random(3)
    parent = {f"r{k}": None for k in range(4)}
    for k in range(300):
        parent[f"n{k:03d}"] = rng.choice(list(parent)) if k > 120 else "r2"  # one parent of very many
    level = {}
    for node in parent:
        level[node] = 0 if parent[node] is None else level[parent[node]] + 1
    kids = {}
    for node, up in sorted(parent.items()):
        kids.setdefault(up, []).append(node)
    want, at = {}, 0

    def walk(node):
        nonlocal at
        own, at = at, at + 1
        for child in kids.get(node, []):
            walk(child)
        want[node] = own, at - own

    for root in kids[None]:
        walk(root)
    forest = spark.createDataFrame([(n, p, level[n]) for n, p in parent.items()], "node string, parent string, depth int").repartition(5)
    assert {r.node: (r.place, r["size"]) for r in depth.preorder(forest).collect()} == want
    assert depth.preorder(forest.limit(0)).count() == 0


def test_walk_within_a_budget(spark):
    nodes = spark.createDataFrame([("a::red", "Red"), ("b", "x"), ("c", "y"), ("d", "z")], "qualified_name string, name string")
    edges = spark.createDataFrame([("a::red", "b"), ("a::red", "d"), ("b", "c"), ("c", "a::red"), ("d", "c")], "source string, target string")
    walk = lambda budget, deep=3: [tuple(r) for r in depth.walk_from(nodes, edges, ["red"], deep, budget).orderBy("place").collect()]
    assert walk(1_000) == [(0, "a::red", 0, 11), (1, "b", 1, 21), (2, "c", 2, 31), (3, "d", 1, 41)]
    assert walk(35) == [(0, "a::red", 0, 11), (1, "b", 1, 21), (2, "c", 2, 31)]
    assert [r[1] for r in walk(1_000, 1)] == ["a::red", "b", "d"]
    assert depth.walk_from(nodes, edges, ["nothing"], 3, 100).count() == 0


def test_sums_of_a_group_over_all_partitions(spark):
    from pyspark.sql import functions as F

    from skarn.operators import sequences
    from skarn.operators.sums import sums_before
    from skarn.operators.traverse import settled

    rows = [("hot", k, k % 7 + 1) for k in range(900)] + [("b", k, 2) for k in range(5)] + [(None, 1, 3), (None, 2, 4)]
    frame = spark.createDataFrame(rows, "g string, k int, n int").repartition(6)
    got = {(r.g, r.k): r.s for r in sums_before(frame, F.col("g"), ["k"], "n", "s", settled).collect()}
    assert got == {(g, k): sum(n for h, j, n in rows if h == g and j < k) for g, k, _ in rows}
    texts = spark.createDataFrame([("a", 1, "x" * 60), ("a", 2, "y" * 100), ("a", 3, None), ("a", 4, "z"), ("b", 1, "w" * 200)], "g string, k int, text string")
    kept = {(r.g, r.k): (r.kept_bytes, r.cut) for r in sequences.output_cap(texts, "g", "k", 150, 20).collect()}
    assert kept == {("a", 1): (60, False), ("a", 2): (90, True), ("b", 1): (150, True)}
