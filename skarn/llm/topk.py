"""Exact top-k inner products by sorted lists with bounds, without random access.

Method: no-random-access aggregation.  Each dimension of a block of candidates is a list sorted
by value; a query reads a list from the top where its weight is positive and from the bottom
where it is negative.  Lists are read in lockstep, to depths that double.  At a depth, what was
read gives each candidate a lower bound (unread values at the list's far end) and an upper bound
(unread values where reading stopped); candidates whose upper bound is below the k-th lower bound
are out.  Only candidates that some open query still needs are read on, and a query closes when so
few are left that their final scores can be resolved.  Final scores are exact integers.  As a list
is read to the same depth for all open queries of a block, one matrix product gives their bounds.

Candidates are dealt to blocks of bounded size, each sorted once; the queries (a stated set
against all rows) pass by each block in batches, so no group grows with the data.  Each block
returns its own k best, which are ranked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shuffle_parts

K, SCALE = 5, 256
#: Candidates of a block, at most about; rows of a task's block at least, where there are so many; queries of a batch.
CANDIDATES, LEAST, QUERIES = 8_192, 2_048, 512
#: A query closes once so few candidates are left.
RESOLVE = 64


def blocks(vectors: DataFrame, every: int, keep: str, least: int = LEAST) -> DataFrame:
    """Rows (c, role, uid, vec_id, embedding): candidates once, in their block, then queries in each block.

    `keep` is the SQL condition of vectors that take part.  Rows are told apart by their place
    in the input, so repeated ids and vectors are rows of their own.
    """
    spark = vectors.sparkSession
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.monotonically_increasing_id().alias("uid"),
    ).where(keep)
    n = base.count()
    cs = max(1, -(-n // CANDIDATES), min(-(-n // least), shuffle_parts(spark)))
    own = F.struct(F.pmod(F.xxhash64("uid"), F.lit(cs)).alias("c"), F.lit(0).alias("role"))
    ask = F.transform(F.sequence(F.lit(0), F.lit(cs - 1)), lambda i: F.struct(i.cast("long").alias("c"), F.lit(1).alias("role")))
    roles = F.when(F.expr(f"coalesce(vec_id % {every} = 0, false)"), F.concat(F.array(own), ask)).otherwise(F.array(own))
    dealt = base.withColumn("at", F.explode(roles)).select("at.*", "uid", "vec_id", "embedding")
    return dealt.repartition(max(cs, shuffle_parts(spark)), "c").sortWithinPartitions("c", "role", F.asc_nulls_last("vec_id"), "uid")


#: Vectors without nulls and non-finite components.
FINITE = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def search(dealt: DataFrame, prepare: Callable, k: int, score: str) -> DataFrame:
    """Pass the queries by each block and rank the union of what is found.

    `prepare(candidates)` gives a function of (queries, own) that yields (query row, candidate
    rows, scores); `own` is each query's place among the candidates or -1.  Vectors meet those
    of as many components.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ready = None, [], {}
        for batch in batches:
            for (c, role), part in batch.groupby(["c", "role"], sort=False):
                if c != at:
                    at, held, ready = c, [], {}
                if role == 0:
                    held.append(part)
                    continue
                if held:
                    whole = pd.concat(held)
                    for dim, same in whole.groupby(whole["embedding"].map(len)):
                        x = np.stack(same["embedding"].to_list()).reshape(len(same), dim)
                        ready[dim] = prepare(x), {u: i for i, u in enumerate(same["uid"])}, same["vec_id"].to_numpy()
                    held = []
                for lo in range(0, len(part), QUERIES):
                    yield found(part.iloc[lo : lo + QUERIES], ready)

    def found(asks: pd.DataFrame, ready: dict) -> pd.DataFrame:
        out = []
        for dim, same in asks.groupby(asks["embedding"].map(len)):
            if dim in ready:
                find, place, ids = ready[dim]
                own = np.array([place.get(u, -1) for u in same["uid"]])
                x = np.stack(same["embedding"].to_list()).reshape(len(same), dim)
                for i, rows, values in find(x, own):
                    out += [(same["uid"].iloc[i], same["vec_id"].iloc[i], v, s) for v, s in zip(ids[rows], values, strict=True)]
        got = pd.DataFrame(out, columns=["uid", "query_id", "vec_id", "score"])
        return got.astype({"query_id": "Int64", "vec_id": "Int64"})

    best = dealt.mapInPandas(run, f"uid long, query_id long, vec_id long, score {score}")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """The k highest, in order; of equal scores the earlier rows."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        rows = np.sort(np.r_[over, ties[: k - len(over)]])
    else:
        rows = np.arange(len(scores))
    return rows[::-1][np.argsort(scores[rows][::-1], kind="stable")][::-1]


def no_random_access(candidates: np.ndarray, k: int) -> Callable:
    """Sort the lists of a block; the function returned yields the exact best k of each query.

    Vectors are integers held as doubles.  Where sums may leave the exact range of doubles, the
    bounds are widened by what rounding may change and final scores are sums of Python integers.
    """
    n, dim = candidates.shape
    order = np.argsort(candidates, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    ordered = np.take_along_axis(candidates, order, 0)
    low, high = ordered[0], ordered[-1]

    def resolve(q: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (candidates[rows] @ q).astype(np.int64)
        sums = [sum(int(a) * int(b) for a, b in zip(q, candidates[r], strict=True)) for r in rows]
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)

    def find(queries: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        size = max(np.abs(queries).max(initial=1), 1) * max(np.abs(candidates).max(initial=1), 1) * max(1, dim)
        exact = size < 2.0**52
        slack = 0.0 if exact else size * 2.0**-48
        up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
        alive, opened, rows = np.ones((n, len(queries)), bool), np.arange(len(queries)), np.arange(n)
        mine = np.flatnonzero(own >= 0)
        alive[own[mine], mine] = False
        depth = max(1, n // 8)
        while depth < n and len(opened):
            x, u, d = candidates[rows], up[:, opened], down[:, opened]
            top, bottom = rank[rows] >= n - depth, rank[rows] < depth
            at_top, at_bottom = ordered[n - depth], ordered[depth - 1]
            lower = np.where(top, x - low, 0) @ u + np.where(bottom, x - high, 0) @ d + (low @ u + high @ d)
            upper = np.where(top, x - at_top, 0) @ u + np.where(bottom, x - at_bottom, 0) @ d + (at_top @ u + at_bottom @ d)
            still = alive[np.ix_(rows, opened)]
            if len(rows) > k:
                lower = np.where(still, lower, -np.inf)
                still &= upper + slack >= np.partition(lower, len(rows) - k, axis=0)[len(rows) - k] - slack
            alive[np.ix_(rows, opened)] = still
            more = still.sum(0) > RESOLVE
            opened, rows = opened[more], rows[still[:, more].any(1)]
            depth *= 2
        for i, q in enumerate(queries):
            left = np.flatnonzero(alive[:, i])
            scores = resolve(q, left, exact)
            best = best_rows(scores, k)
            yield i, left[best], scores[best]

    return find


def top_k(vectors: DataFrame, every: int = 50, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    Components x become floor(scale * x).  Queries are rows whose vec_id is divisible by `every`;
    candidates all other rows of as many components, including equal ones; ties go to the smaller
    vec_id, null last.  Null vectors and those with null or non-finite components take no part.
    Sums beyond 64 bits are held to the nearest 64-bit number.
    """
    finite = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(FINITE)
    whole = finite.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    return search(blocks(whole, every, FINITE), lambda x: no_random_access(x, k), k, "long").withColumn("rank", F.col("rank").cast("int"))
