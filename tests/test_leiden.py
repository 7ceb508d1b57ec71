"""Leiden communities: planted groups, modularity against a single-machine method, connection, splits and write-back."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skarn.operators import community, leiden, traverse

WEIGHT = {k: round(v * 1000) for k, v in community.WEIGHTS.items()}


def graph(spark, edges, names=None):
    ends = sorted({x for _, a, b in edges for x in (a, b)} | set(names or []))
    nodes = spark.createDataFrame([(x, "py" if x[-1] in "02468" else "") for x in ends], "qualified_name string, language string")
    return nodes, spark.createDataFrame(edges, "kind string, source string, target string")


def pairs(edges):
    out = {}
    for kind, a, b in edges:
        if a != b:
            key = min(a, b), max(a, b)
            out[key] = max(out.get(key, 0), WEIGHT.get(kind, 500))
    return out


def quality(of, edges, resolution):
    """Modularity by definition."""
    weights = pairs(edges)
    total, spread = sum(weights.values()), {}
    for (a, b), w in weights.items():
        for x in (a, b):
            spread[of[x]] = spread.get(of[x], 0) + w
    return sum(w for (a, b), w in weights.items() if of[a] == of[b]) / total - resolution * sum(s * s for s in spread.values()) / (2 * total) ** 2


def local_moves(edges, resolution, seed=0):
    """Single-machine local moving from single nodes, node after node, until nothing moves."""
    weights, near, rng = pairs(edges), {}, random.Random(seed)
    for (a, b), w in weights.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    k = {x: sum(n.values()) for x, n in near.items()}
    total, of, held = 2 * sum(weights.values()), {x: x for x in near}, dict(k)
    moved = True
    while moved:
        moved, order = False, sorted(near)
        rng.shuffle(order)
        for x in order:
            to = {of[x]: 0}
            for y, w in near[x].items():
                to[of[y]] = to.get(of[y], 0) + w
            held[of[x]] -= k[x]
            best = max(to, key=lambda c: (to[c] - resolution * k[x] * held.get(c, 0) / total, c == of[x]))
            held[best] = held.get(best, 0) + k[x]
            moved |= best != of[x]
            of[x] = best
    return of


def connected(of, edges):
    near = {}
    for a, b in pairs(edges):
        if of[a] == of[b]:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    for c in set(of.values()):
        members = {x for x in of if of[x] == c}
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near.get(x, [])
        if seen != members:
            return False
    return True


@pytest.fixture(scope="module")
def planted():
    rng, edges = random.Random(7), []
    for c in range(6):
        names = [f"g{c}n{k:02d}" for k in range(15)]
        edges += [("CALLS", a, b) for a in names for b in names if a < b and rng.random() < 0.5]
    every = sorted({x for _, a, b in edges for x in (a, b)})
    edges += [(rng.choice(["IMPORTS_FROM", "CONTAINS", "OTHER"]), *rng.sample(every, 2)) for _ in range(40)]
    return [*edges, *edges[:30], ("CALLS", every[0], every[0]), ("CALLS", "outside", every[1])]


def test_planted_groups(spark, planted):
    nodes, edges = graph(spark, [e for e in planted if "outside" not in e], ["alone"])
    edges = spark.createDataFrame(planted, "kind string, source string, target string")
    got = leiden.leiden(nodes, edges, 1.0)
    of = {r.node: r.community for r in got.collect()}
    assert set(of) == {r.qualified_name for r in nodes.collect()} and of["alone"] == "alone"
    inner = [e for e in planted if "outside" not in e]
    assert all(of[x] == min(y for y in of if of[y] == of[x]) for x in of)
    assert connected(of, inner)
    for c in range(6):
        assert len({of[x] for x in of if x.startswith(f"g{c}")}) == 1
    mine = quality(of, inner, 1.0)
    assert mine >= max(quality(local_moves(inner, 1.0, s), inner, 1.0) for s in range(5)) - 1e-9
    assert abs(leiden.modularity(got, nodes, edges, 1.0) - mine) < 1e-9
    labels = {r.node: r.community for r in community.propagate(nodes, edges, 5, 1).collect()}
    assert mine >= quality(labels, inner, 1.0)
    again = {r.node: r.community for r in leiden.leiden(nodes.repartition(7), edges.repartition(5), 1.0).collect()}
    assert again == of


def test_large_communities_are_divided(spark):
    """At a low resolution two groups are one community; at a higher one they are two."""
    edges = [("CALLS", f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(8) for j in range(i)] + [("CALLS", f"a{k}", f"b{k}") for k in range(8)]
    nodes, frame = graph(spark, edges)
    whole = {r.node: (r.community, r.parent) for r in leiden.leiden(nodes, frame, 0.2, again=0.2).collect()}
    assert set(whole.values()) == {("a0", None)}
    split = {r.node: (r.community, r.parent) for r in leiden.leiden(nodes, frame, 0.2, again=1.0).collect()}
    assert set(split.values()) == {("a0", "a0"), ("b0", "a0")}


def test_figures_and_write_back(spark):
    edges = [("CALLS", f"{g}{i}", f"{g}{j}") for g in "abc" for i in range(4 if g == "a" else 3) for j in range(i)] + [("CALLS", "a0", "b0"), ("CALLS", "a0", "gone")]
    nodes, frame = graph(spark, [e for e in edges if "gone" not in e], ["lone1"])
    frame = spark.createDataFrame(edges, "kind string, source string, target string")
    members = leiden.leiden(nodes, frame, 1.0)
    got = {r.community: r for r in leiden.communities(members, nodes, frame).collect()}
    assert {c: (r["size"], r.internal, r.external, r.cohesion, r.language) for c, r in got.items()} == {
        "a0": (4, 6, 2, 0.75, "py"), "b0": (3, 3, 1, 0.75, "py"), "c0": (3, 3, 0, 1.0, "py"),
    }
    table = nodes.withColumn("community_id", F.lit(99))
    written = {r.qualified_name: r.community_id for r in leiden.assign(table, members).collect()}
    assert [written[x] for x in ("a0", "a3", "b0", "c2", "lone1")] == [1, 1, 2, 3, None]


def test_no_edges_and_no_nodes(spark):
    nodes = spark.createDataFrame([("x", "py"), ("y", "py"), ("x", "py"), (None, "py")], "qualified_name string, language string")
    none = spark.createDataFrame([], "kind string, source string, target string")
    assert sorted(map(tuple, leiden.leiden(nodes, none, 1.0).collect())) == [("x", "x", None), ("y", "y", None)]
    assert leiden.leiden(nodes.limit(0), none, 1.0).count() == 0


def test_rounds_add_up_votes_where_a_nodes_edges_are(spark, monkeypatch):
    class Lazy:
        keep = staticmethod(lambda df: df)

    monkeypatch.setattr(leiden, "ROWS", 1_000)
    state = traverse.settled(spark.range(90).selectExpr("id", "89L as k", "id div 2 as c"))
    edges = traverse.settled(state.select(F.col("id").alias("a")).crossJoin(state.select(F.col("id").alias("b"))).where("a <> b").withColumn("w", F.lit(1).cast("long")))
    after = leiden._Graph(state.select("id", "k"), edges, 90 * 89, 1.0, Lazy()).round(state, 0)
    assert {(r.id, r.was, r.inner) for r in after.collect()} == {(n, n // 2, 1) for n in range(90)}
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and not re.search(r"hashpartitioning\(a#\d+L, [kc]#", plan)
