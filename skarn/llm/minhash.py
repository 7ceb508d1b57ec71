"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Similarity is the probability Jaccard index of five-word shingles weighted by their counts: the
chance that two texts agree in a register of a ProbMinHash signature.  For texts without repeated
shingles it is the Jaccard index.

Method: each shingle is a Poisson process whose rate is its weight; an arrival picks a register,
and a register keeps the shingle that reached it first.  Arrivals are generated only up to a time
by which all registers are reached (later ones for the few texts where some are not), so work
stays near the text's length.  Bands of registers bucket texts.

A bucket's pivot is its member with the most company in all its buckets (the original of many
edits, rather than one of the edits).  Each text checks the pivot that it shares most bands with,
exactly; as pivots are above their members in that order, these links make trees, whose roots are
found by doubling.  What the trees leave is settled in blocks: of a bucket whose members are still
in several components, each pair of blocks is a group of its own (the largest component never
meets itself), and a pair belongs to the first bucket that it shares.  There signature agreement
drops hopeless pairs (of those at the threshold 1.7 in a million, see HOPELESS) and exact
similarity decides, likeliest first, so that no other pair of a bucket in two components is left
unchecked.  The classes thus don't depend on pivots, blocks or partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Slots, char_blocks, durable, mix64, small_batches, spare, written
from .components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Candidates whose signatures agree in a smaller share are dropped: five standard deviations below.
#: A pair of similarity 0.8 falls under it with probability 0.0000017, one of 0.85 with 0.00000000015, beside the
#: 0.00005 with which all bands miss the former.
HOPELESS = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / REGISTERS)
BLOCK_CHARS, BLOCK_ROWS, CACHE_WORDS = 500_000, 500, 100_000
#: Members of a bucket in a block; of a bucket that check their pivot in one group; pairs compared at a time.
MEMBERS, TOGETHER, PAIRS = 128, 128, 50_000
PAD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Weighted shingles of texts as sorted 64-bit hashes."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.slots, self.hashes = size, Slots(), np.zeros(0, np.uint64)

    def words(self, text: str) -> np.ndarray:
        parts = text.lower().split()
        return np.fromiter(map(self.slots.__getitem__, parts), np.int64, len(parts))

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, hash, weight) of each distinct shingle; a text of fewer words has one."""
        import xxhash

        if len(self.slots) > CACHE_WORDS:
            self.slots, self.hashes = Slots(), np.zeros(0, np.uint64)
        coded = [self.words(t) for t in texts]
        fresh, self.slots.fresh = self.slots.fresh, []
        new = np.fromiter((xxhash.xxh64_intdigest(w) for w in fresh), np.uint64, len(fresh))
        self.hashes = np.concatenate([self.hashes, new])
        sizes = np.array([len(x) for x in coded], np.int64)
        padded = np.where(sizes > 0, np.maximum(sizes, self.size), 0)
        starts = np.cumsum(padded) - padded
        h = np.full(int(padded.sum()), PAD, np.uint64)
        if len(h) == 0:
            return np.zeros(0, np.int64), h, np.zeros(0)
        within = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        h[within] = self.hashes[np.concatenate(coded)]
        n = len(h) - self.size + 1
        with np.errstate(over="ignore"):
            s = np.zeros(n, np.uint64)
            for k in range(self.size):
                s = mix64(s * np.uint64(0x100000001B3) + h[k : k + n] + np.uint64(k + 1))
        owner = np.repeat(np.arange(len(texts)), padded)
        whole = owner[:n] == owner[self.size - 1 :]
        s, owner = s[whole], owner[:n][whole]
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        edge = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
        return owner[edge], s[edge], np.diff(np.r_[edge, len(s)]).astype(float)


def _arrive(state: np.ndarray, now: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next state and time of Poisson processes that are named by their state."""
    with np.errstate(over="ignore"):
        state = state + np.uint64(0x9E3779B97F4A7C15)
    uniform = (mix64(state) >> np.uint64(11)).astype(float) / 2.0**53
    return state, now - np.log1p(-uniform) / rate


def signatures(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures: the item that first reaches each register of n texts (0: no items)."""
    times = np.full(n * registers, np.inf)
    winners = np.zeros(n * registers, np.uint64)
    totals = np.bincount(owner, weights, n)
    limit = registers * (math.log(registers) + 4) / np.maximum(totals, 1e-300)
    state, now = _arrive(items, np.zeros(len(items)), weights)
    at = np.arange(len(items))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        ready = now <= limit[owner[at]]
        held.append((state[~ready], now[~ready], at[~ready]))
        state, now, at = state[ready], now[ready], at[ready]
        if len(at):
            slot = owner[at] * registers + (mix64(mix64(state)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(times, slot, now)
            won = now == times[slot]
            winners[slot[won]] = items[at[won]]
            state, now = _arrive(state, now, weights[at])
            continue
        unfilled = np.isinf(times.reshape(n, registers)).any(1)
        limit = np.where(unfilled, limit * 2, limit)
        state, now, at = (np.concatenate(x) for x in zip(*held, strict=True))
        go_on, held = unfilled[owner[at]], []
        state, now, at = state[go_on], now[go_on], at[go_on]
    return winners.reshape(n, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, each (sorted hashes, weights)."""
    items = np.union1d(a[0], b[0])
    x, y = np.zeros(len(items)), np.zeros(len(items))
    x[np.searchsorted(items, a[0])], y[np.searchsorted(items, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    both = (x > 0) & (y > 0)
    at = last[both]
    return float((1 / (below[at] / x[both] + above[at] / y[both])).sum())


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler = Shingler()
    with np.errstate(over="ignore"):
        salt = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64))
    for batch in batches:
        texts = batch["text"].fillna("").tolist()
        for lo, hi in char_blocks(map(len, texts), BLOCK_CHARS, BLOCK_ROWS):
            owner, items, weights = shingler.shingles(texts[lo:hi])
            won = signatures(owner, items, weights, hi - lo)
            some = np.bincount(owner, minlength=hi - lo) > 0
            mixed = mix64(won ^ salt)
            with np.errstate(over="ignore"):
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix64(bands * np.uint64(0x100000001B3) + mixed[:, k::ROWS])
            bits = (mixed & np.uint64(255)).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].iloc[lo:hi].astype("Int64"),
                    "key": batch["key"].iloc[lo:hi],
                    "bands": [x if s else x[:0] for x, s in zip(bands.view(np.int64), some, strict=True)],
                    "bits": [x.tobytes() for x in bits],
                }
            )


GROUP = "h long, i long, j long, side int, nid long, label long, bands array<long>, bits binary"
GROUP_COLUMNS = [column.split()[0] for column in GROUP.split(", ")]


def _to_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links (u, p) of texts that are similar to their pivot, the row without a u before them."""
    shingler, pivot = Shingler(), None
    for batch in batches:
        texts, below = batch["text"].tolist(), batch["u"].notna().to_numpy()
        same = np.zeros(len(batch), bool)
        for lo, hi in char_blocks(map(len, texts), BLOCK_CHARS, BLOCK_ROWS):
            owner, items, weights = shingler.shingles(texts[lo:hi])
            ends = np.searchsorted(owner, np.arange(hi - lo + 1))
            for k, (x, y) in enumerate(zip(ends, ends[1:], strict=False), lo):
                own = items[x:y], weights[x:y]
                if below[k]:
                    same[k] = similarity(own, pivot) >= THRESHOLD
                else:
                    pivot = own[0].copy(), own[1].copy()
        yield batch.loc[same, ["u", "p"]].astype(np.int64)


def _open_pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, agreement) of the pairs that their bucket has to settle, for rows sorted by h, i, j and side."""
    h, i, j, side, label = (frame[c].to_numpy() for c in ("h", "i", "j", "side", "label"))
    none = np.zeros(0, np.int64)
    found, ready, size = [(none, none, np.zeros(0))], [], 0
    if not len(frame):
        return found[0]
    bands = np.stack(frame["bands"].to_list())
    bits = np.frombuffer(b"".join(frame["bits"]), np.uint8).reshape(len(frame), -1)

    def settle() -> None:
        a, b = (np.concatenate(x) for x in zip(*ready, strict=True))
        other = label[a] != label[b]
        a, b = a[other], b[other]
        agree = (bits[a] == bits[b]).mean(1)
        a, b, agree = a[agree >= HOPELESS], b[agree >= HOPELESS], agree[agree >= HOPELESS]
        mine = bands[a, (bands[a] == bands[b]).argmax(1)] == h[a]
        found.append((a[mine], b[mine], agree[mine]))

    edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
    lefts = np.add.reduceat(side == 0, edge[:-1])
    for lo, hi, left in zip(edge[:-1].tolist(), edge[1:].tolist(), lefts.tolist(), strict=True):
        if i[lo] == j[lo]:
            a, b = np.triu_indices(left, 1)
        else:
            a, b = np.repeat(np.arange(left), hi - lo - left), np.tile(np.arange(left, hi - lo), left)
        ready.append((a + lo, b + lo))
        size += len(a)
        if size >= PAIRS:
            settle()
            ready, size = [], 0
    if ready:
        settle()
    a, b, agree = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, agree


def _hopeful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of sorted groups that are in a pair which their group has to settle."""

    def some(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, _ = _open_pairs(frame)
        return frame.iloc[np.unique(np.concatenate([a, b]))]

    rest = None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = frame[["h", "i", "j"]].iloc[-1] if len(frame) else None
        whole = int(((frame["h"] != last["h"]) | (frame["i"] != last["i"]) | (frame["j"] != last["j"])).sum()) if len(frame) else 0
        yield some(frame.iloc[:whole])
        rest = frame.iloc[whole:].reset_index(drop=True)
    if rest is not None:
        yield some(rest)


def _settle(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of a group's components by similar pairs, likeliest first, without those that earlier links imply."""
    frame = frame.sort_values(["side", "nid"], kind="stable")
    shingler, kept = Shingler(), {}
    texts, label = frame["text"].to_list(), frame["label"].to_list()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def weighted(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in kept:
            kept[k] = shingler.shingles([texts[k]])[1:]
        return kept[k]

    links = []
    a, b, agree = _open_pairs(frame)
    for k in np.argsort(-agree, kind="stable"):
        x, y = root(label[a[k]]), root(label[b[k]])
        if x != y and similarity(weighted(a[k]), weighted(b[k])) >= THRESHOLD:
            parent[x] = y
            links.append(sorted((label[a[k]], label[b[k]])))
    return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)


def _alone(*columns: str) -> list:
    """Grouping columns and one that follows from them.

    Sums by these are dealt otherwise than a join on the columns needs, so that the join has
    exchanges of its own on both sides and the rows of a hot key can be split.
    """
    return [*columns, F.hash(*columns).alias("_dealt")]


def _open_groups(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of buckets in several components, once for each pair of blocks (h, i, j) they are in."""
    now = durable(members.join(labels, "nid", "left").select("h", "nid", F.coalesce("label", "nid").alias("label")))
    sizes = now.groupBy("h", "label").agg(F.count("*").alias("n"))
    stats = sizes.groupBy(*_alone("h")).agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    blocks_of = lambda n: F.ceil(n / F.lit(float(MEMBERS))).cast("long")
    stats = stats.select("h", F.col("top.label").alias("main"), blocks_of(F.col("top.n")).alias("sm"), blocks_of(F.col("n") - F.col("top.n")).alias("so"))
    is_main = F.col("label") == F.col("main")
    b = F.pmod(F.xxhash64("nid"), F.when(is_main, F.col("sm")).otherwise(F.col("so")))
    at = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_main = F.transform(upto(F.col("so")), lambda x: at(x, -1 - b, F.lit(1)))
    others = F.transform(upto(F.col("so")), lambda x: at(F.least(b, x), F.greatest(b, x), b > x))
    mains = F.transform(upto(F.col("sm")), lambda x: at(b, -1 - x, F.lit(0)))
    rows = now.join(stats, "h").withColumn("at", F.explode(F.when(is_main, as_main).otherwise(F.concat(others, mains))))
    return rows.select("h", "at.*", "nid", "label").join(nodes.select("nid", "bands", "bits"), "nid").select(*GROUP_COLUMNS)


def _pivots(members: DataFrame) -> DataFrame:
    """(u, p, n): for each text below a pivot the one it shares most bands with, and a size for blocks."""
    company = members.groupBy(*_alone("nid")).agg(F.sum("n").alias("w")).drop("_dealt")
    weighed = members.join(company, "nid")
    tops = weighed.groupBy(*_alone("h")).agg(F.max(F.struct("w", "nid")).alias("top"))
    tops = tops.select("h", F.col("top.nid").alias("p"), F.col("top.w").alias("w"))
    met = members.join(tops, "h").where("nid <> p").select(F.col("nid").alias("u"), "p", "w", "n")
    shared = met.groupBy("u", "p").agg(F.count("*").alias("bands"), F.max("w").alias("w"), F.max("n").alias("n"))
    best = shared.groupBy("u").agg(F.max(F.struct("bands", "w", "p", "n")).alias("b"))
    return best.select("u", "b.p", F.ceil(F.col("b.n") / F.lit(float(TOGETHER))).cast("long").alias("n"))


def _roots(parents: DataFrame) -> DataFrame:
    """(nid, label) of the texts in trees of links (u, p): label is the tree's root."""
    now = durable(parents.select("u", "p"))
    while True:
        above = now.select(F.col("u").alias("p"), F.col("p").alias("over"))
        step = now.join(above, "p", "left").select("u", F.coalesce("over", "p").alias("p"), F.col("over").isNotNull().alias("moved"))
        step = durable(step)
        now = step.select("u", "p")
        if not step.agg(F.max("moved")).first()[0]:
            return now.select(F.col("u").alias("nid"), F.col("p").alias("label"))


def text_key(text):
    """128 bits that name a text; null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes; see `_near_duplicates`, which runs with small Arrow batches."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, key, keeper): one row per row of `docs`.

    class_id is the least doc_id of the row's component of similar texts; keeper tells the rows
    that hold the component's chosen text under that id.  Equal texts are always one class,
    whatever their ids; texts without words are similar only to equal ones.  Null texts count as
    empty.  Null ids come last: a class of null ids alone has a null class_id.  Repeated rows are
    returned as often as they come; other columns of `docs` play no part; no rows give no rows.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key(F.col("text").cast("string")).alias("key")
    )
    sketched = written(named.mapInPandas(_sketch, "doc_id long, key binary, bands array<long>, bits binary"))
    last_id = F.lit(2**63 - 1)
    first = F.min(F.struct(F.coalesce("doc_id", last_id).alias("rep"), "bands", "bits"))
    nodes = durable(
        sketched.groupBy("key").agg(first.alias("x")).select("key", "x.*", F.monotonically_increasing_id().alias("nid"))
    )
    rows = nodes.select("nid", F.explode("bands").alias("h"))
    company = rows.groupBy(*_alone("h")).agg(F.count("*").alias("n")).where("n > 1").drop("_dealt")
    members = durable(rows.join(company, "h").select("h", "nid", "n"))
    chosen = nodes.join(members.select("nid").distinct(), "nid").select("nid", "key", "rep")
    texts = written(
        named.withColumn("rep", F.coalesce("doc_id", last_id))
        .join(chosen, ["rep", "key"])
        .select("nid", "text")
        .dropDuplicates(["nid"])
    )
    best = durable(_pivots(members).withColumn("part", F.pmod(F.xxhash64("u"), F.col("n"))))
    below = best.join(texts.withColumnRenamed("nid", "u"), "u").select("u", "p", "part", "text")
    above = best.select("p", "part").distinct().join(texts.withColumnRenamed("nid", "p"), "p")
    groups = below.unionByName(above.select(F.lit(None).cast("long").alias("u"), "p", "part", "text"))
    groups = groups.repartition("p", "part").sortWithinPartitions("p", "part", F.col("u").asc_nulls_first())
    labels = _roots(groups.mapInPandas(_to_pivot, "u long, p long"))
    crowd = _open_groups(members, labels, nodes).repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "side", "nid")
    crowd = written(crowd.mapInPandas(_hopeful, GROUP))
    links = durable(crowd.join(texts, "nid").groupBy("h", "i", "j").applyInPandas(_settle, "u long, v long"))
    labelled = nodes.select("key", "rep", "nid").join(labels, "nid", "left").select("key", "rep", F.coalesce("label", "nid").alias("label"))
    if not links.isEmpty():
        merged = connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("whole"))
        labelled = labelled.join(merged, "label", "left").select("key", "rep", F.coalesce("whole", "label").alias("label"))
    labelled = durable(labelled)
    heads = labelled.groupBy(*_alone("label")).agg(F.min(F.struct("rep", "key")).alias("head"))
    classes = labelled.join(heads, "label").select("key", "head")
    return sketched.select("doc_id", "key").join(classes, "key").select(
        "doc_id",
        F.when(F.col("head.rep") != last_id, F.col("head.rep")).alias("class_id"),
        "key",
        ((F.col("head.key") == F.col("key")) & (F.col("head.rep") == F.coalesce("doc_id", last_id))).alias("keeper"),
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of `docs`: the keeper, once if it is repeated."""
    doc, key, own_id, own_key = (spare(docs, x) for x in ("kept_id", "kept_key", "own_id", "own_key"))
    keepers = near_duplicates(docs).where("keeper").select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct()
    keyed = docs.withColumns({own_key: text_key(F.col("text").cast("string")), own_id: F.col("doc_id").cast("long")})
    mine = keyed.join(keepers, (F.col(own_key) == F.col(key)) & F.col(own_id).eqNullSafe(F.col(doc)))
    return mine.dropDuplicates([own_key, own_id]).select(*docs.columns)
