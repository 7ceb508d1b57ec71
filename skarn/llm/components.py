"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable


def _minima(pairs: DataFrame) -> DataFrame:
    """The least of each u and its v.

    The second key, one for each u, deals the sums otherwise than a join on u does: the join then
    has exchanges of its own on both sides, and a hub's rows can be split.
    """
    sums = pairs.groupBy("u", (F.col("u") + 1).alias("_next")).agg(F.min("v").alias("low"))
    return sums.select("u", F.least("low", "u").alias("m"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each component, for the nodes of edges (u, v).

    A hub's neighbours are never gathered: each step takes a minimum per node, which combines
    before the shuffle, and joins it back.  Each round is checkpointed.  Loops and repeated
    edges do no harm; nodes without edges are not returned; null ends are left out.
    """
    now = durable(edges.select("u", "v").where("u <> v").distinct())
    last = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = durable(large.distinct())
        lows = _minima(down)
        small = down.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = durable(small.unionAll(lows.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("node"), F.col("u").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
