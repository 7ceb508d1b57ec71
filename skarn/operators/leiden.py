"""Leiden communities: modularity moves, refinement inside communities, aggregation, repeated.

Everything is joins and sums over tables of edges (a, b, w, both ways) and nodes (id, k, c): k is a
node's strength, c its community.  Weights are whole numbers, so sums don't depend on partitions.

* A round of moves takes each node's weight to the communities around it and their strengths, and
  moves the nodes whose modularity it raises most.  Nodes that move at once may undo each other's
  gain, so only half of them, drawn anew each time, may move in a round; rounds go on until two
  together no longer raise modularity.
* Refinement starts from single nodes inside each community.  Nodes that are still alone and drawn
  as movers join the part around them that gains most, among parts whose nodes stay: parts only
  grow by neighbours, so each is connected.
* Parts become the nodes of the next, smaller table, in the communities found so far.

What is returned is split into connected pieces, which never lowers modularity, so no community is
disconnected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .community import WEIGHTS
from .scratch import Scratch
from .search import placed

#: Weights are held as whole numbers of this share; moves must raise modularity by so much a pair of rounds.
UNIT, LEAST_GAIN = 1_000, 1e-4
#: Edges of a task.
ROWS = 100_000


def weighted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w): undirected edges between given nodes (id, node), each pair once; of parallel edges the heaviest kind counts."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("kind")], F.lit(0.5))
    ends = edges.select("source", "target", F.round(weight * UNIT).cast("long").alias("w"))
    named = lambda end, name: nodes.select(F.col("node").alias(end), F.col("id").alias(name))
    pairs = ends.join(named("source", "x"), "source").join(named("target", "y"), "target").where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("w").alias("w"))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.unionAll(pairs.select(F.col("b"), F.col("a"), "w"))


def _coin(column: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(turn // 2)), F.lit(2)) == turn % 2


class _Graph:
    """One level: nodes (id, k), edges both ways, and what all levels share."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, total: int, resolution: float, scratch: Scratch) -> None:
        self.edges, self.total, self.scratch = edges, total, scratch
        #: Expected weight between strengths x and y is x * y * rate.
        self.rate = resolution / total
        weight, n = edges.agg(F.sum("w"), F.count("*")).first()
        self.within = total - (weight or 0)
        # Dealt out by node once and held, so that rounds add up a node's votes where its edges are.  A node's
        # row to itself, of no weight, makes staying one of its options and tells its own community.
        own = nodes.select(F.col("id").alias("a"), "k", F.col("id").alias("b"), F.lit(0).cast("long").alias("w"))
        near = edges.join(nodes.select(F.col("id").alias("a"), "k"), "a").select("a", "k", "b", "w")
        self.near = near.unionAll(own).repartition(n // ROWS + 1, "a").persist(StorageLevel.MEMORY_AND_DISK)
        self.near.count()  # so that plans know how it is dealt out

    def round(self, state: DataFrame, turn: int) -> DataFrame:
        """(id, k, c, was, inner): `state` after the moves of one half of the nodes, and each node's community and weight into it before."""
        strengths = state.groupBy("c").agg(F.sum("k").alias("s"), F.count("*").alias("n"))
        votes = self.near.join(state.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "k", "c")
        options = votes.agg(F.sum("w").alias("w"), F.max(F.col("a") == F.col("b")).alias("at_home")).join(strengths, "c")
        at_home = F.col("at_home")
        gain = F.col("w") - F.lit(self.rate) * F.col("k") * (F.col("s") - F.when(at_home, F.col("k")).otherwise(0))
        home = lambda x, name: F.max(F.when(at_home, x)).alias(name)
        best = options.groupBy("a", "k").agg(
            F.max(F.struct(gain.alias("gain"), (-F.col("c")).alias("c"), "n")).alias("best"), home(gain, "stay"), home(F.col("n"), "n"), home(F.col("c"), "own"), home(F.col("w"), "inner")
        )
        # Of two nodes that are alone the later joins the earlier, lest they change places.
        swaps = (F.col("n") == 1) & (F.col("best.n") == 1) & (-F.col("best.c") > F.col("own"))
        moves = _coin("a", turn) & (F.col("best.gain") > F.col("stay") + 1e-9) & ~swaps
        return self.scratch.keep(best.select(F.col("a").alias("id"), "k", F.when(moves, -F.col("best.c")).otherwise(F.col("own")).alias("c"), F.col("own").alias("was"), "inner"))

    def modularity(self, after: DataFrame) -> float:
        """Of the communities before a round, from what it made."""
        each = after.groupBy("was").agg(F.sum("k").cast("double").alias("s"), F.sum("inner").alias("inner"))
        inner, spread = each.agg(F.sum("inner"), F.sum(F.col("s") * F.col("s"))).first()
        return ((inner or 0) + self.within - (spread or 0.0) * self.rate) / self.total

    def moved(self, state: DataFrame, turn: int) -> tuple[DataFrame, int]:
        """The best state of rounds that raise modularity, and the next turn."""
        turn += turn % 2  # the two halves of one draw
        best, first = state, self.round(state, turn)
        value = self.modularity(first)
        while True:
            after = self.round(first, turn + 1)
            turn += 2
            first = self.round(after, turn)  # of the next pair; it tells what this one came to
            now = self.modularity(first)
            if now > value:
                best = after.select("id", "k", "c")
            if now < value + LEAST_GAIN:
                return best, turn
            value = now

    def refined(self, state: DataFrame, turn: int) -> tuple[DataFrame, int]:
        """(id, part): connected parts of the communities of `state`, and the next turn."""
        end = lambda name: state.select(F.col("id").alias(name), F.col("c").alias("c_" + name))
        met = self.near.where("a <> b").join(end("a"), "a").join(end("b"), "b")
        inside = met.where("c_a = c_b").select("a", "k", "b", "w").persist(StorageLevel.MEMORY_AND_DISK)
        inside.count()
        parts = self.scratch.keep(state.select("id", "k", F.col("id").alias("part")))
        still = 0
        while still < 2:
            sizes = parts.groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("s"))
            now = parts.select("id", "k", "part").join(sizes, "part").withColumn("mover", (F.col("n") == 1) & _coin("id", turn))
            near = inside.where(_coin("a", turn)).join(now.where("not mover").select(F.col("id").alias("b"), "part", "s"), "b")
            near = near.join(now.where("mover").select(F.col("id").alias("a")), "a", "left_semi")
            options = near.groupBy("a", "k", "part", "s").agg(F.sum("w").alias("w"))
            gain = F.col("w") - F.lit(self.rate) * F.col("k") * F.col("s")
            best = options.withColumn("gain", gain).where("gain > 0").groupBy("a").agg(F.max(F.struct("gain", (-F.col("part")).alias("part"))).alias("m"))
            joins = best.select(F.col("a").alias("id"), (-F.col("m.part")).alias("to"))
            parts = self.scratch.keep(parts.select("id", "k", "part").join(joins, "id", "left").select("id", "k", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")))
            still = still + 1 if parts.where("moved").isEmpty() else 0
            turn += 1
        inside.unpersist()
        return parts.select("id", "part"), turn

    def merged(self, state: DataFrame, parts: DataFrame, resolution: float) -> tuple[_Graph, DataFrame]:
        """The graph whose nodes are the parts, and their state."""
        keep = self.scratch.keep
        above = keep(state.join(parts, "id").groupBy("part").agg(F.sum("k").alias("k"), F.max("c").alias("c")).select(F.col("part").alias("id"), "k", "c"))
        end = lambda name: parts.select(F.col("id").alias(name), F.col("part").alias("p_" + name))
        edges = self.edges.join(end("a"), "a").join(end("b"), "b").where("p_a <> p_b").groupBy(F.col("p_a").alias("a"), F.col("p_b").alias("b")).agg(F.sum("w").alias("w"))
        return _Graph(above.select("id", "k"), keep(edges), self.total, resolution, self.scratch), above


def _pieces(edges: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, c): each connected piece of a community under its least node, by least labels and jumps."""
    end = lambda name: state.select(F.col("id").alias(name), F.col("c").alias("c_" + name))
    inside = scratch.keep(edges.join(end("a"), "a").join(end("b"), "b").where("c_a = c_b").select("a", "b"))
    now = scratch.keep(state.select("id", F.col("id").alias("low")))
    while True:
        around = inside.join(now.select(F.col("id").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("near"))
        lower = scratch.keep(now.join(around.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("low").alias("was"), F.least("low", "near").alias("low")))
        jumps = lower.select(F.col("id").alias("low"), F.col("low").alias("over"))
        after = scratch.keep(lower.join(jumps, "low").select("id", "was", F.least("low", "over").alias("low")))
        if after.where("low <> was").isEmpty():
            return after.select("id", F.col("low").alias("c"))
        now = after.select("id", "low")


def _leiden(ids: DataFrame, pairs: DataFrame, resolution: float, iterations: int, scratch: Scratch) -> DataFrame:
    """(id, c) of all `ids` over undirected pairs (a, b, w)."""
    edges = scratch.keep(_both(pairs))
    total = edges.agg(F.sum("w")).first()[0]
    if not total:
        return scratch.keep(ids.select("id", F.col("id").alias("c")))
    strengths = edges.groupBy("a").agg(F.sum("w").alias("k"))
    lone = F.coalesce("k", F.lit(0).cast("long"))
    state = scratch.keep(ids.select("id").join(strengths.withColumnRenamed("a", "id"), "id", "left").select("id", lone.alias("k"), F.col("id").alias("c")))
    ground = _Graph(state.select("id", "k"), edges, total, resolution, scratch)
    turn = 0
    for settled in range(iterations):  # after the first, nothing is left to do where no node moves
        level, chain, at = ground, state.select("id", F.col("id").alias("top")), state
        while True:
            before = at
            at, turn = level.moved(at, turn)
            if at is before and (level is not ground or settled):
                break
            parts, turn = level.refined(at, turn)
            merged, above = level.merged(at, parts, resolution)
            if level is not ground:
                level.near.unpersist()
            chain = scratch.keep(chain.join(parts.withColumnRenamed("id", "top"), "top").select("id", F.col("part").alias("top")))
            level, at = merged, above
        if level is not ground:
            level.near.unpersist()
        found = chain.join(at.select(F.col("id").alias("top"), "c"), "top").select("id", "c")
        state = scratch.keep(state.select("id", "k").join(found, "id"))
    ground.near.unpersist()
    return _pieces(edges, state, scratch)


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float, iterations: int = 2, share: float = 0.25, least_split: int = 10, again: float = 0.5) -> DataFrame:
    """(node, community, parent): the community of each node, named by its least node.

    Nodes are (qualified_name); edges (kind, source, target) count once a pair, without direction,
    by their kinds' weights; those that end outside the nodes, and loops, don't count.  Communities
    of more than `share` of all nodes, and of `least_split` nodes at least, are divided once more
    at resolution `again`, on their own edges; what results has the larger one as its parent.  Nodes without
    edges are communities of their own; repeated nodes count once; no nodes give no rows.
    """
    scratch = Scratch(nodes.sparkSession)
    distinct = nodes.select(F.col("qualified_name").alias("node")).where("node is not null").distinct()
    # The place by name: ids, and so ties, don't depend on partitions.
    ids = scratch.keep(placed(distinct.withColumn("score", F.lit(0)), "node", "score").select("node", F.col("place").alias("id")))
    pairs = scratch.keep(weighted(ids, edges))
    found = _leiden(ids, pairs, resolution, iterations, scratch)
    n = found.count()
    large = [r["c"] for r in found.groupBy("c").agg(F.count("*").alias("n")).where((F.col("n") > share * n) & (F.col("n") >= least_split)).orderBy("c").collect()]  # fewer than 1 / share
    whole = found.withColumn("parent", F.lit(None).cast("long"))
    for c in large:
        own = scratch.keep(found.where(F.col("c") == c).select("id"))
        inner = pairs.join(own.withColumnRenamed("id", "a"), "a", "left_semi").join(own.withColumnRenamed("id", "b"), "b", "left_semi")
        divided = _leiden(own, inner.select("a", "b", "w"), again, iterations, scratch)
        if divided.select("c").distinct().count() > 1:
            whole = whole.where(F.col("c") != c).unionByName(divided.withColumn("parent", F.lit(c)))
    named = lambda name: ids.select(F.col("id").alias(name), F.col("node").alias("n_" + name))
    lows = whole.groupBy("c").agg(F.min("id").alias("low"))
    out = whole.join(lows, "c").join(ids, "id").join(named("low"), "low").join(named("parent"), "parent", "left")
    return scratch.result(out.select("node", F.col("n_low").alias("community"), F.col("n_parent").alias("parent")))


def communities(members: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(community, parent, size, internal, external, cohesion, language): figures of the communities of `least` nodes or more.

    Edges of all kinds count, with direction and repeats; language is the commonest one that isn't
    empty, ties to the least.
    """
    known = members.join(nodes.select(F.col("qualified_name").alias("node"), "language").dropDuplicates(["node"]), "node")
    sizes = known.groupBy("community").agg(F.count("*").alias("size"), F.max("parent").alias("parent")).where(F.col("size") >= least)
    spoken = known.where("language <> ''").groupBy("community", "language").agg(F.count("*").alias("n"))
    first = spoken.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("m")).select("community", F.col("m.language").alias("language"))
    end = lambda name: members.select(F.col("node").alias(name), F.col("community").alias("c_" + name))
    met = edges.select("source", "target").join(end("source"), "source", "left").join(end("target"), "target", "left")
    same = F.col("c_source").eqNullSafe(F.col("c_target"))
    one = F.when(same, F.array("c_source")).otherwise(F.array("c_source", "c_target"))
    sides = met.select(same.cast("long").alias("inner"), F.explode(one).alias("community")).where("community is not null")
    counts = sides.groupBy("community").agg(F.sum("inner").alias("internal"), F.sum(1 - F.col("inner")).alias("external"))
    zero = F.lit(0).cast("long")
    out = sizes.join(counts, "community", "left").join(first, "community", "left").withColumns({c: F.coalesce(c, zero) for c in ("internal", "external")})
    cohesion = F.coalesce(F.round(F.col("internal") / F.nullif(F.col("internal") + F.col("external"), zero), 4), F.lit(0.0))
    return out.select("community", "parent", "size", "internal", "external", cohesion.alias("cohesion"), F.coalesce("language", F.lit("")).alias("language"))


def assign(nodes: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """`nodes` with community_id replaced: communities of `least` nodes or more numbered from 1 by size, largest first; others null."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbers = placed(sizes, "community", "n").select("community", (F.col("place") + 1).cast("int").alias("community_id"))
    known = members.join(numbers, "community").select(F.col("node").alias("qualified_name"), "community_id")
    return nodes.drop("community_id").join(known, "qualified_name", "left").select(*nodes.columns)


def modularity(members: DataFrame, nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    """Weighted modularity of (node, community) over the undirected edges between nodes."""
    ids = nodes.select(F.col("qualified_name").alias("node"), F.col("qualified_name").alias("id")).distinct()
    pairs = weighted(ids, edges)
    end = lambda name: members.select(F.col("node").alias(name), F.col("community").alias("c_" + name))
    met = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left")
    inner = met.agg(F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("w")).otherwise(0)).alias("inner"), F.sum("w").alias("total")).first()
    ends = met.select(F.coalesce("c_a", "a").alias("c"), "w").unionAll(met.select(F.coalesce("c_b", "b"), "w"))
    spread = ends.groupBy("c").agg(F.sum("w").cast("double").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return inner["inner"] / inner["total"] - resolution * spread / (2 * inner["total"]) ** 2
