"""Look-ups, joins and metrics on the property graph (nodes, edges)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .traverse import ENTRY_DECORATORS, ENTRY_NAMES, TEST_FILE, settled


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from each of its ends: (node, peer, kind, direction)."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("peer"), "kind", F.lit("out").alias("direction"))
    return out.unionAll(edges.select(F.col("target"), F.col("source"), "kind", F.lit("in")))


def relations(edges: DataFrame, pattern: str) -> DataFrame:
    """(node, peer, role) of callers_of, callees_of, imports_of, tests_for, contains or references."""
    of = {
        "callers_of": ("CALLS", "target", "source"), "callees_of": ("CALLS", "source", "target"), "imports_of": ("DEPENDS_ON", "source", "target"),
        "tests_for": ("TESTED_BY", "source", "target"), "contains": ("CONTAINS", "source", "target"),
    }
    if pattern == "references":
        return both_ways(edges.where(F.col("kind") != "CONTAINS")).select("node", "peer", F.col("direction").alias("role"))
    kind, node, peer = of[pattern]
    return edges.where(F.col("kind") == kind).select(F.col(node).alias("node"), F.col(peer).alias("peer"), F.lit(pattern).alias("role"))


def neighbors(nodes: DataFrame, edges: DataFrame, of: str, kinds: list[str] | None = None) -> DataFrame:
    """Out- and in-neighbours of one node, with the peers' columns."""
    near = both_ways(edges).where(F.col("node") == of)
    if kinds:
        near = near.where(F.col("kind").isin(kinds))
    peers = nodes.select(F.col("qualified_name").alias("peer"), F.col("kind").alias("peer_kind"), "file_path")
    return near.join(peers, "peer", "left").select("direction", "kind", "peer", "peer_kind", "file_path")


def large_nodes(nodes: DataFrame, least: int, most: int) -> DataFrame:
    """Nodes of so many lines, both bounds included."""
    size = F.col("line_end") - F.col("line_start") + 1
    return nodes.where(size.between(least, most)).select("qualified_name", "kind", size.alias("n_lines"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose two ends are members (qualified_name): two left semi joins."""
    m = members.select("qualified_name").distinct()
    return edges.join(m.withColumnRenamed("qualified_name", "source"), "source", "left_semi").join(
        m.withColumnRenamed("qualified_name", "target"), "target", "left_semi"
    )


def callers_outside_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct targets of calls whose source is no file node, known or not."""
    kinds = nodes.select(F.col("qualified_name").alias("source"), F.col("kind").alias("source_kind"))
    calls = edges.where(F.col("kind") == "CALLS").join(kinds, "source", "left")
    return calls.where(F.col("source_kind").isNull() | (F.col("source_kind") != "File")).select("target").distinct()


def resolve_by_name(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls (call_id, name) of a name that one node alone has, resolved to it."""
    unique = nodes.groupBy("name").agg(F.min("qualified_name").alias("target"), F.count("*").alias("n")).where("n = 1")
    return calls.join(unique, "name").select("call_id", "name", "target")


#: Lines of a file that meet in one key of a range join.
BIN = 64


def binned(rows: DataFrame, first: str, last: str) -> DataFrame:
    """`rows` once for each run of BIN lines that theirs touch, so that no file's rows all meet."""
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / BIN), F.floor(F.greatest(F.col(first), F.col(last)) / BIN))))


def range_overlap(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes that any changed range (file_path, start, stop) of their file touches."""
    span = ["file_path", "line_start", "line_end"]
    some = nodes.where(F.col("line_end") >= F.col("line_start")).select("qualified_name", *span)
    # Spans repeat far more than nodes do: each meets the ranges once.
    met = binned(some.select(*span).distinct(), "line_start", "line_end").join(binned(ranges, "start", "stop"), ["file_path", "_bin"])
    hit = met.where((F.col("line_start") <= F.col("stop")) & (F.col("line_end") >= F.col("start"))).select(*span).distinct()
    return some.join(hit, span, "left_semi").distinct()


def enclosing(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (file_path, line), the innermost node around it: the smallest span, then least name."""
    some = binned(nodes.where((F.col("kind") != "File") & (F.col("line_end") >= F.col("line_start"))), "line_start", "line_end")
    at = points.withColumn("_bin", F.floor(F.col("line") / BIN))
    around = at.join(some, ["file_path", "_bin"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    span = F.struct((F.col("line_end") - F.col("line_start")).alias("span"), F.col("qualified_name"))
    return around.groupBy("file_path", "line").agg(F.min(span).alias("m")).select("file_path", "line", F.col("m.qualified_name").alias("qualified_name"))


def version_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): removed, added, modified or same, from two versions (path, hash)."""
    b, a = before.withColumnRenamed("hash", "old"), after.withColumnRenamed("hash", "new")
    change = (
        F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "modified").otherwise("same")
    )
    return b.join(a, "path", "full_outer").select("path", change.alias("change"))


def degrees(edges: DataFrame) -> DataFrame:
    """In-, out- and total degree over all edges, in one aggregation."""
    ends = both_ways(edges)
    out = F.count_if(F.col("direction") == "out")
    return ends.groupBy("node").agg(out.alias("out_degree"), (F.count("*") - out).alias("in_degree"), F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The n nodes of most edges that are no files."""
    some = nodes.where(F.col("kind") != "File").select(F.col("qualified_name").alias("node"), "name", "kind")
    return degrees(edges).join(some, "node").orderBy(F.desc("degree"), "node").limit(n)


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int, scope: str = "all") -> DataFrame:
    """Highest degrees in the simple digraph that a file type induces."""
    members = nodes if scope == "all" else nodes.where(F.col("file_type") == scope)
    simple = induced(edges, members).select("source", "target").distinct().withColumn("kind", F.lit("any"))
    return degrees(simple).select("node", "degree").orderBy(F.desc("degree"), "node").limit(n)


def isolated(nodes: DataFrame, edges: DataFrame, most: int = 1) -> DataFrame:
    """Nodes with at most so many edges, that are no files."""
    d = degrees(edges).select(F.col("node").alias("qualified_name"), "degree")
    joined = nodes.where(F.col("kind") != "File").join(d, "qualified_name", "left")
    return joined.select("qualified_name", F.coalesce("degree", F.lit(0)).alias("degree")).where(F.col("degree") <= most)


def untested_hotspots(nodes: DataFrame, edges: DataFrame, least: int, n: int) -> DataFrame:
    """Production nodes of at least so many edges without a test."""
    tested = edges.where(F.col("kind") == "TESTED_BY").select(F.col("source").alias("node")).distinct()
    some = nodes.where(~F.col("is_test") & (F.col("kind") != "File")).select(F.col("qualified_name").alias("node"))
    d = degrees(edges).where(F.col("degree") >= least).select("node", "degree")
    return d.join(some, "node", "left_semi").join(tested, "node", "left_anti").orderBy(F.desc("degree"), "node").limit(n)


def single_file_communities(nodes: DataFrame, least: int = 3) -> DataFrame:
    """Communities of at least so many members that are all in one file."""
    per = nodes.where(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))
    return per.where((F.col("files") == 1) & (F.col("n") >= least))


def cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal / (internal + external) edges of each community, in one pass over the edges."""
    c = nodes.where(F.col("community_id").isNotNull()).select("qualified_name", "community_id")
    ends = edges.join(c.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("a")), "source", "left").join(
        c.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("b")), "target", "left"
    )
    inside = F.col("a") == F.col("b")
    sides = F.when(inside, F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("i")))).otherwise(
        F.array(F.struct(F.col("a").alias("c"), F.lit(0).alias("i")), F.struct(F.col("b").alias("c"), F.lit(0).alias("i")))
    )
    per = ends.select(F.explode(sides).alias("s")).where("s.c is not null").groupBy(F.col("s.c").alias("community_id"))
    return per.agg(F.sum("s.i").alias("internal"), (F.count("*") - F.sum("s.i")).alias("external"), F.round(F.sum("s.i") / F.count("*"), 6).alias("cohesion"))


def cross_community(nodes: DataFrame, edges: DataFrame, more_than: int) -> DataFrame:
    """Unordered pairs of communities with more than so many edges between, tests aside."""
    c = nodes.where(F.col("community_id").isNotNull()).select("qualified_name", "community_id")
    e = edges.where(F.col("kind") != "TESTED_BY").join(c.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("a")), "source")
    e = e.join(c.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("b")), "target").where("a <> b")
    pairs = e.groupBy(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).agg(F.count("*").alias("n_edges"))
    return pairs.where(F.col("n_edges") > more_than)


def surprising(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Edges scored for crossing communities and file types, and for joining the periphery to hubs.

    0.3 for other communities, 0.2 for other file extensions, 0.2 from a node of at most two edges
    to one of max(3 x the upper median, 10), 0.15 for a call across the test boundary, 0.15 for a
    calling class.  Rounded to 2 places; edges of score 0 are left out.
    """
    d = settled(degrees(edges).select("node", "degree"))
    # The upper median from counts by degree: few rows, however many nodes.
    by = d.groupBy("degree").agg(F.count("*").alias("n"))
    rank = F.sum("n").over(Window.orderBy("degree"))
    total = F.sum("n").over(Window.partitionBy())
    median = by.withColumns({"upto": rank, "all": total}).where("upto > floor(all / 2)").agg(F.min("degree").alias("median"))
    ext = F.when(F.col("file_path").contains("."), F.substring_index("file_path", ".", -1)).otherwise("")
    info = nodes.select("qualified_name", "community_id", ext.alias("ext"), "is_test", (F.col("kind") == "Class").alias("is_class"))
    bar = F.greatest(F.col("median") * 3, F.lit(10))
    near = d.join(F.broadcast(median)).select(F.col("node").alias("qualified_name"), (F.col("degree") <= 2).alias("far"), (F.col("degree") >= bar).alias("hub"))
    info = settled(info.join(near, "qualified_name", "left"))
    a = info.select([F.col("qualified_name").alias("source")] + [F.col(c).alias("a_" + c) for c in ("community_id", "ext", "is_test", "is_class", "far", "hub")])
    b = info.select([F.col("qualified_name").alias("target")] + [F.col(c).alias("b_" + c) for c in ("community_id", "ext", "is_test", "far", "hub")])
    e = edges.join(a.hint("shuffle_hash"), "source").join(b.hint("shuffle_hash"), "target")
    edge_hub = (F.col("a_far") & F.col("b_hub")) | (F.col("b_far") & F.col("a_hub"))
    rules = [
        (F.col("a_community_id") != F.col("b_community_id"), 0.3), (F.col("a_ext") != F.col("b_ext"), 0.2), (edge_hub, 0.2),
        ((F.col("kind") == "CALLS") & (F.col("a_is_test") != F.col("b_is_test")), 0.15), ((F.col("kind") == "CALLS") & (F.col("a_is_class")), 0.15),
    ]
    score = sum((F.when(rule, weight).otherwise(0.0) for rule, weight in rules), F.lit(0.0))
    return e.select("kind", "source", "target", F.round(score, 2).alias("score")).where("score > 0").orderBy(F.desc("score"), "source", "target", "kind").limit(n)


def move_suggestions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions whose callers all sit in exactly one other community."""
    c = nodes.where(F.col("community_id").isNotNull()).select("qualified_name", "community_id")
    calls = edges.where(F.col("kind") == "CALLS").join(c.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("caller")), "source")
    per = calls.groupBy("target").agg(F.min("caller").alias("low"), F.max("caller").alias("high")).where("low = high")
    mine = c.select(F.col("qualified_name").alias("target"), "community_id")
    return per.join(mine, "target").where("low <> community_id").select("target", F.col("community_id").alias("from_community"), F.col("low").alias("to_community"))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and classes that nothing calls, depends on, inherits or tests.

    Tests, entry points by decorator or name, names between double underscores, and constructors
    don't count.
    """
    used = edges.where(F.col("kind").isin("CALLS", "DEPENDS_ON", "IMPORTS_FROM", "INHERITS", "REFERENCES")).select(F.col("target").alias("qualified_name"))
    tested = edges.where(F.col("kind") == "TESTED_BY").select(F.col("source").alias("qualified_name"))
    some = nodes.where(F.col("kind").isin("Function", "Class") & ~F.col("is_test") & ~F.col("file_path").rlike(TEST_FILE))
    some = some.where(~F.col("name").rlike("|".join([*ENTRY_NAMES, "^__.*__$", "^constructor$"])))
    if "decorators" in nodes.columns:
        marks = F.coalesce(F.col("decorators"), F.lit(""))
        some = some.where((marks == "") | ~marks.rlike("|".join(f"(?:{p})" for p in ENTRY_DECORATORS)))
    return some.select("qualified_name", "kind", "file_path").join(used.unionAll(tested).distinct(), "qualified_name", "left_anti")


def roll_up(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph of files: edges counted between ordered pairs of files."""
    f = nodes.select("qualified_name", "file_path")
    e = edges.join(f.select(F.col("qualified_name").alias("source"), F.col("file_path").alias("from_file")).hint("shuffle_hash"), "source")
    e = e.join(f.select(F.col("qualified_name").alias("target"), F.col("file_path").alias("to_file")).hint("shuffle_hash"), "target")
    return e.where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count("*").alias("n_edges"))


def differing_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes of different file types, counted."""
    f = nodes.select("qualified_name", "file_type")
    e = edges.join(f.select(F.col("qualified_name").alias("source"), F.col("file_type").alias("from_type")), "source")
    e = e.join(f.select(F.col("qualified_name").alias("target"), F.col("file_type").alias("to_type")), "target")
    return e.where("from_type <> to_type").groupBy("kind", "from_type", "to_type").agg(F.count("*").alias("n"))


def criticality(members: DataFrame) -> DataFrame:
    """Flows scored from members (flow_id, file_path, external, secure, tested, depth).

    0.30 files + 0.20 external calls + 0.25 security + 0.15 test gap + 0.10 depth, each from 0 to 1.
    Counted in whole ten-thousandths, so that halves round alike everywhere.
    """
    n = F.count("*")
    whole = 750 * F.least(F.count_distinct("file_path") - 1, F.lit(4)) + 400 * F.least(F.sum("external"), F.lit(5)) + 100 * F.least(F.max("depth"), F.lit(10))
    shares = 2500 * F.count_if("secure") + 1500 * (n - F.count_if("tested"))
    sums = members.groupBy("flow_id").agg(whole.cast("long").alias("whole"), shares.alias("shares"), n.alias("n"))
    score = F.expr("(2 * (whole * n + shares) + n) div (2 * n)")
    return sums.select("flow_id", (F.least(score, F.lit(10_000)) / 10_000).alias("criticality"))
