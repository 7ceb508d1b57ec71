"""Depth-first order of forests from subtree sizes and sums over earlier siblings, without a walk.

A node's place is its parent's, one, and the sizes of the subtrees of its earlier siblings.  Sizes are
summed from the deepest level up, places from the roots down: one join a level.  Siblings are summed in
range-sorted partitions, with what earlier partitions hold of the same parent added, so that a parent of
very many children doesn't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .sums import sums_before
from .traverse import settled, steps_from


def shortest_tree(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, parent, depth): nodes within `depth` directed steps of the starts (node), each under the least of its nearest parents."""
    frontier = settled(starts.select("node").distinct().select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))
    seen = frontier
    for level in range(1, depth + 1):
        found = steps_from(edges, frontier, directed=True).groupBy(F.col("next").alias("node")).agg(F.min("node").alias("parent"))
        frontier = settled(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def preorder(forest: DataFrame) -> DataFrame:
    """(node, parent, depth, size, place): places from 0 in depth-first order, roots and siblings by name.

    `forest` has (node, parent, depth): a root has a null parent and depth 0, each other node is one
    deeper than its parent.
    """
    scratch = Scratch(forest.sparkSession)
    rows = scratch.keep(forest.select("node", "parent", "depth"))
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return scratch.result(rows.select("node", "parent", "depth", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("place")))
    sized = None
    for level in range(deepest, -1, -1):
        own = rows.where(F.col("depth") == level)
        if sized is None:
            below = own.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("sum"))
            below = own.join(sums, "node", "left").select("node", "parent", "depth", (F.coalesce("sum", F.lit(0)) + 1).alias("size"))
        below = scratch.keep(below)
        sized = below if sized is None else sized.unionByName(below)
    family = F.struct(F.col("parent").isNotNull().alias("has"), F.coalesce("parent", F.lit("")).alias("name"))
    ranked = scratch.keep(sums_before(sized, family, ["node"], "size", "before", scratch.keep))
    above = scratch.keep(ranked.where("depth = 0").select("node", "parent", "depth", "size", F.col("before").alias("place")))
    out = above
    for level in range(1, deepest + 1):
        parents = above.select(F.col("node").alias("parent"), F.col("place").alias("start"))
        above = scratch.keep(ranked.where(F.col("depth") == level).join(parents, "parent").select("node", "parent", "depth", "size", (F.col("start") + 1 + F.col("before")).alias("place")))
        out = out.unionByName(above)
    return scratch.result(out)


def walk_from(nodes: DataFrame, edges: DataFrame, words: list[str], depth: int, budget: int) -> DataFrame:
    """(place, node, depth, spent): a depth-first walk from the best hit for some words, while tokens last.

    The start is the first of the nodes whose names have every word.  Each node hangs under its
    nearest parent, the least of several.  A node costs a quarter of its name's length and ten
    tokens; the walk ends before the first node that the budget no longer covers, so no more than
    a tenth of the budget in nodes is ordered in one task.
    """
    from .search import keyword

    start = keyword(nodes, words, 1).select(F.col("qualified_name").alias("node"))
    ordered = preorder(shortest_tree(edges, start, depth))
    cost = (F.floor(F.length("node") / 4) + 10).cast("long")
    some = ordered.where(F.col("place") <= budget // 10).withColumn("cost", cost)
    spent = some.withColumn("spent", F.sum("cost").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    return spent.where(F.col("spent") <= budget).select("place", "node", "depth", "spent")
