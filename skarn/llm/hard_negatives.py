"""Hard negatives by one-dimensional distance keys.

Method: a component is added to each vector so that all have the greatest norm M; then the largest
inner product with a query q (whose added component is zero) is the least distance, as
d^2 = |q|^2 + M^2 - 2 q.x.  Each vector belongs to its nearest pivot, and the table is sorted by
(pivot, distance to it) and cut into blocks of bounded size.  By the triangle inequality a vector
at distance d from q has a key within d of q's own distance to that pivot, so a search scans
intervals of keys around it, each twice as wide as the one before, and only the parts that are new:
annuli around the pivots.  It ends once what is not yet scanned is farther than the k-th vector
found, or than the bound it came with.

An anchor's positives are searched in the block nearest to it first; what is found there bounds
the search of the others, and blocks whose keys lie beyond the bound are never asked.  Negatives
must lie between two distances, that of the positive and that of the least score allowed, so their
annuli are bounded on both sides from the start, for blocks as well as for keys.

Pivots are fitted on a bounded sample (SAMPLE rows of least hash); every row is indexed, and all
results are exact: scores are whole numbers, and bounds are widened by what rounding may change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, shuffle_parts
from ._scoring import least_hashes
from .topk import CANDIDATES, FINITE, LEAST, SCALE

SAMPLE, PIVOTS, ROUNDS = 4_096, 64, 6
#: A search begins with this share of the distances' range; bounds are widened by this share of the norms.
FIRST, SLACK = 1 / 64, 1e-6
#: Inner products below are exact in doubles; pivots are not used where they may not be.
EXACT = 2.0**52
ROWS = "uid long, vid long, missing boolean, label long, embedding array<double>, pivot int, dist double"


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with a component that makes each squared norm `most`."""
    return np.c_[x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows and pivots."""
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(x: np.ndarray, n: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """Centres of a sample's rows."""
    rng = np.random.default_rng(seed)
    pivots = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        near = distances(x, pivots).argmin(1)
        for p in np.unique(near):
            pivots[p] = x[near == p].mean(0)
    return pivots


class Block:
    """A block of the table: vectors of one size, by pivot and distance, and by label, pivot and distance."""

    def __init__(self, frame: pd.DataFrame, dim: int, pivots: np.ndarray | None, most: float) -> None:
        self.x = np.stack(frame["embedding"].to_list()).reshape(len(frame), dim)
        self.uid, self.vid, self.missing = (frame[c].to_numpy() for c in ("uid", "vid", "missing"))
        self.label, self.pivot, self.dist = (frame[c].to_numpy() for c in ("label", "pivot", "dist"))
        self.pivots, self.most = pivots, most
        self.whole = self._cut(np.lexsort((self.dist, self.pivot)), [self.pivot])
        self.by_label: dict[int, list] = {}
        for rows in self._cut(np.lexsort((self.dist, self.pivot, self.label)), [self.label, self.pivot]):
            self.by_label.setdefault(int(self.label[rows[0]]), []).append(rows)

    @staticmethod
    def _cut(order: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
        edge = np.zeros(len(order) - 1, bool)
        for key in keys:
            edge |= key[order][1:] != key[order][:-1]
        return np.split(order, np.flatnonzero(edge) + 1)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products as 64-bit numbers, held to their range."""
        size = np.abs(q).max(initial=1) * np.abs(self.x[rows]).max(initial=1) * max(1, len(q))
        if size < EXACT:
            return (self.x[rows] @ q).astype(np.int64)
        sums = [sum(int(a) * int(b) for a, b in zip(q, self.x[r], strict=True)) for r in rows]
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)

    def annuli(self, q: np.ndarray, segments: list[np.ndarray], inner: float) -> Iterator[tuple[float, np.ndarray]]:
        """(distance within which all rows have been seen, rows that are new), with ever wider intervals of keys.

        Rows that are certainly nearer than `inner` are passed over.
        """
        if self.pivots is None:
            yield np.inf, np.concatenate(segments)
            return
        slack = SLACK * np.sqrt((q**2).sum() + self.most)
        own = distances(np.r_[q, 0.0][None], self.pivots)[0]
        at = [own[self.pivot[rows[0]]] for rows in segments]
        keys = [self.dist[rows] for rows in segments]
        least = [int(np.searchsorted(k, inner - slack - a)) for k, a in zip(keys, at, strict=True)]
        done = [(None, None)] * len(segments)
        reach = FIRST * max(max(abs(k[0] - a), abs(k[-1] - a)) for k, a in zip(keys, at, strict=True)) + slack
        while True:
            new, left = [], False
            for i, (rows, k, a) in enumerate(zip(segments, keys, at, strict=True)):
                lo = max(least[i], int(np.searchsorted(k, a - reach)))
                hi = max(lo, int(np.searchsorted(k, a + reach, side="right")))
                if done[i][0] is None:
                    new.append(rows[lo:hi])
                else:
                    was_lo, was_hi = done[i]
                    new += [rows[lo:was_lo], rows[was_hi:hi]]
                done[i] = lo, hi
                left |= lo > least[i] or hi < len(rows)
            yield reach - slack if left else np.inf, np.concatenate(new)
            if not left:
                return
            reach *= 2

    def distance(self, q: np.ndarray, score: float) -> float:
        return float(np.sqrt(max((q**2).sum() + self.most - 2 * score, 0)))

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places of the k highest scores in order; ties go to the smaller id, null last."""
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at = np.flatnonzero(scores >= least)
        else:
            at = np.arange(len(scores))
        r = rows[at]
        return at[np.lexsort((self.uid[r], self.vid[r], self.missing[r], -1 - scores[at]))[:k]]

    def same_label(self, q: np.ndarray, label: int, uid: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows of a label, but for the row `uid`, and their scores; those beyond `bound` may be absent."""
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if label not in self.by_label:
            return rows, scores
        for seen, new in self.annuli(q, self.by_label[label], 0.0):
            new = new[self.uid[new] != uid]
            rows, scores = np.r_[rows, new], np.r_[scores, self.scores(q, new)]
            best = self.first(rows, scores, k)
            rows, scores = rows[best], scores[best]
            if seen >= bound or len(rows) == k and self.distance(q, scores[-1]) <= seen:
                break
        return rows, scores

    def other_labels(self, q: np.ndarray, label: int, wants: list[int], k: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each positive's score in `wants` (its place, rows, scores): the k best rows of other labels within low to high per cent of it."""
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        outer = [self.distance(q, low * w / 100) for w in wants]
        open_, found = set(range(len(wants))), {}
        for seen, new in self.annuli(q, self.whole, min(self.distance(q, high * w / 100) for w in wants)):
            new = new[self.label[new] != label]
            rows, scores = np.r_[rows, new], np.r_[scores, self.scores(q, new)]
            exact = scores if np.abs(scores).max(initial=0) < 2**52 else scores.astype(object)
            for i in sorted(open_):
                at = np.flatnonzero((exact * 100 >= low * wants[i]) & (exact * 100 <= high * wants[i]))
                at = at[self.first(rows[at], scores[at], k)]
                if seen == np.inf or seen > outer[i] or len(at) == k and self.distance(q, scores[at[-1]]) <= seen:
                    found[i] = rows[at], scores[at]
                    open_.discard(i)
            if not open_:
                break
        for i, (at, values) in found.items():
            yield i, at, values


class Miner:
    """Passes anchors by blocks of the table."""

    def __init__(self, pivots: np.ndarray | None, most: float, k: int, low: int = 0, high: int = 0) -> None:
        self.pivots, self.most, self.k, self.low, self.high = pivots, most, k, low, high

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ready = None, [], {}
        for batch in batches:
            for (block, role), part in batch.groupby(["block", "role"], sort=False):
                if block != at:
                    at, held, ready = block, [], {}
                if role == 0:
                    held.append(part)
                    continue
                if held:
                    whole = pd.concat(held)
                    for dim, same in whole.groupby(whole["embedding"].map(len)):
                        ready[dim] = Block(same, dim, self.pivots if (same["pivot"] >= 0).all() else None, self.most)
                    held = []
                yield self.found(part, ready)

    def found(self, asks: pd.DataFrame, ready: dict) -> pd.DataFrame:
        out = []
        for uid, label, q, bound, wants in zip(*(asks[c] for c in ("uid", "label", "embedding", "dist", "wants")), strict=True):
            block, q = ready.get(len(q)), np.asarray(q, float)
            if block is None:
                continue
            some = [(0, *block.same_label(q, label, uid, self.k, bound))] if wants is None else block.other_labels(q, label, [int(w) for w in wants], self.k, self.low, self.high)
            for i, rows, scores in some:
                out += [(uid, i, block.uid[r], block.vid[r], block.missing[r], s) for r, s in zip(rows, scores, strict=True)]
        return pd.DataFrame(out, columns=["uid", "place", "other", "vid", "missing", "score"]).astype({"missing": bool})


FOUND = "uid long, place int, other long, vid long, missing boolean, score long"


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "missing", "vid", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _id() -> Column:
    return F.when(~F.col("missing"), F.col("vid"))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x become floor(scale * x); scores are inner products.  Anchors are rows whose
    vec_id is divisible by `every`; their positives the `positives` best other rows of the same
    label; a positive's negatives the `negatives` best rows of other labels whose scores are `low`
    to `high` per cent of its own.  Ties go to the smaller vec_id, null last.  A positive without
    such rows gives no row, nor does an anchor without positives.  Rows with a null label or
    vector, or null or non-finite components, take no part; vectors meet those of as many
    components; repeated rows are rows of their own; other columns play no part.  Sums beyond 64
    bits are held to the nearest 64-bit number.
    """
    spark = vectors.sparkSession
    base = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(2**63 - 1)).alias("vid"),
        F.col("vec_id").isNull().alias("missing"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(f"label is not null and {FINITE}")
    base = base.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    base = base.withColumn("square", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    n = base.count()
    sample = [r[0] for r in least_hashes(base.select("vid", "embedding"), "vid", SAMPLE, n).select("embedding").collect()]
    sizes = [len(v) for v in sample]
    dim = max(set(sizes), key=sizes.count) if sizes else 0
    most = base.where(F.size("embedding") == dim).agg(F.max("square")).first()[0] or 0.0
    pivots = fit_pivots(augmented(np.array([v for v in sample if len(v) == dim]), most)) if dim and most < EXACT else None

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pivot, dist = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            fit = np.flatnonzero(batch["embedding"].map(len).to_numpy() == dim)
            if pivots is not None and len(fit):
                far = distances(augmented(np.stack(batch["embedding"].iloc[fit].to_list()), most), pivots)
                pivot[fit] = far.argmin(1)
                dist[fit] = far.min(1)
            yield batch.assign(pivot=pivot, dist=dist)

    placed = durable(base.drop("square").mapInPandas(place, ROWS))
    parts = max(1, -(-n // CANDIDATES), min(-(-n // LEAST), shuffle_parts(spark)))
    # Equal keys are told apart by the row, so that many copies of one vector fill many blocks.
    table = placed.repartitionByRange(parts, "pivot", "dist", "uid").withColumn("block", F.spark_partition_id())
    table = durable(table)
    extent = durable(table.groupBy("block", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")))
    anchors = placed.where(f"not missing and vid % {every} = 0").select("uid", "vid", "label", "embedding")

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"uid": [], "pivot": [], "far": [], "turn": []}
            for uid, q in zip(batch["uid"], batch["embedding"], strict=True):
                far = distances(np.r_[q, 0.0][None], pivots)[0] if pivots is not None and len(q) == dim else np.zeros(0)
                out["uid"].append(np.full(len(far) + 1, uid))
                out["pivot"].append(np.arange(-1, len(far)))
                out["far"].append(np.r_[0.0, far])
                turn = np.zeros(len(far) + 1, np.int64)
                turn[1 + np.argsort(far, kind="stable")] = np.arange(len(far))
                out["turn"].append(turn)
            yield pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    ways = durable(
        anchors.select("uid", "embedding").mapInPandas(reach, "uid long, pivot int, far double, turn int").join(anchors.select("uid", square.alias("square")), "uid")
    )
    # Each anchor's ways into the blocks: by each pivot that a block has rows of; its rows lie no nearer than `gap`.
    gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("far"), F.col("far") - F.col("hi"))
    into = ways.join(extent, "pivot").withColumn("gap", F.when(F.col("pivot") >= 0, gap).otherwise(0.0))
    slack = F.lit(SLACK) * F.sqrt(F.col("square") + F.lit(most))
    far_of = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.lit(most) - 2 * score))

    def scan(asks: DataFrame, miner: Miner) -> DataFrame:
        """Pass the anchors of (block, uid, dist, wants) by their blocks; dist bounds the search."""
        there = table.join(asks.select("block").distinct(), "block", "left_semi")
        none = F.lit(None).cast("array<long>").alias("wants")
        rows = there.select("block", F.lit(0).alias("role"), "uid", "vid", "missing", "label", "embedding", "pivot", "dist", none)
        named = asks.join(anchors, "uid").select("block", F.lit(1).alias("role"), "uid", "vid", F.lit(False).alias("missing"), "label", "embedding", F.lit(-1).alias("pivot"), "dist", "wants")
        dealt = rows.unionByName(named).repartition(max(parts, shuffle_parts(spark)), "block").sortWithinPartitions("block", "role", "pivot", "dist", "uid")
        return dealt.mapInPandas(miner, FOUND)

    search = Miner(pivots, most, positives)
    no_wants = F.lit(None).cast("array<long>").alias("wants")
    first = F.min(F.struct(F.col("pivot") < 0, "gap", "block")).alias("at")
    home = durable(into.where("turn = 0").groupBy("uid").agg(first).select("uid", "at.block"))
    near = durable(scan(home.select("block", "uid", F.lit(float("inf")).alias("dist"), no_wants), search))
    bounds = near.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == positives)
    rest = into.join(bounds.select("uid", F.col("score").cast("double").alias("score")), "uid", "left").join(home.withColumnRenamed("block", "home"), "uid", "left")
    bound = F.coalesce(far_of(F.col("score")) + slack, F.lit(float("inf")))
    rest = rest.where(~F.col("block").eqNullSafe(F.col("home"))).withColumn("bound", bound).where(F.col("gap") <= F.col("bound"))
    rest = rest.groupBy("block", "uid").agg(F.min("bound").alias("dist")).select("block", "uid", "dist", no_wants)
    mates = durable(_first(near.unionByName(scan(rest, search)), positives).select("uid", F.col("rank").alias("turn"), _id().alias("positive_id"), F.col("score").alias("positive_score")))
    # Only scores of zero or more have others between their shares.
    wants = mates.where("positive_score >= 0").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_score"))).alias("w"))
    wants = wants.select("uid", F.transform("w", lambda x: x["positive_score"]).alias("wants"))
    asked = into.join(wants, "uid")
    outer = far_of(F.array_min("wants").cast("double") * (low / 100)) + slack
    inner = far_of(F.array_max("wants").cast("double") * (high / 100)) - slack
    asked = asked.where((F.col("pivot") < 0) | (F.col("gap") <= outer) & (F.col("far") + F.col("hi") >= inner))
    asked = asked.groupBy("block", "uid").agg(F.first("wants").alias("wants")).select("block", "uid", F.lit(0.0).alias("dist"), "wants")
    found = _first(scan(asked, Miner(pivots, most, negatives, low, high)), negatives)
    named = found.select("uid", (F.col("place") + 1).alias("turn"), F.col("rank").cast("int").alias("rank"), _id().alias("negative_id"), F.col("score").alias("negative_score"))
    whole = named.join(mates, ["uid", "turn"]).join(anchors.select("uid", F.col("vid").alias("anchor_id")), "uid")
    return whole.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
