"""SimHash near-duplicates by bit-sliced comparison of fingerprints.

A fingerprint's bit is the majority over the hashes of a text's word shingles; fingerprints that
differ in at most RADIUS bits are linked, and texts that links join are one component.

Method: of 64 bits in four quarters, two that differ in at most two bits agree in two quarters at
least, so distinct fingerprints meet under six keys, one for each two quarters.  A key that more
than CROWD fingerprints share is split by the same rule again: the other 32 bits in four bytes, of
which two agree.  A group then has 16 free bits, so 65,536 distinct fingerprints at most, whatever
the corpus.  Within groups fingerprints are stored as bit planes, 64 of them to a word: one exclusive-or
compares a fingerprint's bit with 64 others, carry-save counters of two bits add up the distances
of all 64 at once, and words in which every distance exceeds the radius are abandoned on the way.
No pair of fingerprints within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import char_blocks, durable, small_batches
from .components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCK_CHARS, BLOCK_ROWS, PIECE = 1_000_000, 1_000, 1 << 20
#: Hashes whose bits are added at a time, in single bytes.
LANES = 128
#: Fingerprints under one key beyond which it is split again; rows and (row, word) pairs compared at a time.
CROWD, ROWS, PAIRS = 512, 8_192, 1 << 14
#: Planes are taken in this order, so that those that a group's key fixes don't come together.
ORDER = [k * 37 % 64 for k in range(64)]
FULL = np.uint64(2**64 - 1)


def _pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """A text's words in lists, each after the first with the last SHINGLE - 1 words of the one before."""
    held: list[bytes] = []
    rest = b""
    for at in range(0, len(data), size):
        part = rest + data[at : at + size]
        words = part.split()
        whole = at + size >= len(data) or not words or part[-1:].isspace()
        rest = b"" if whole else words.pop()
        yield [*held, *words]
        held = [*held, *words][-(SHINGLE - 1) :]


def shingle_hashes(data: bytes) -> np.ndarray:
    """XXH64 of the shingles of a text's bytes with A-Z lower-cased; of fewer words one of all."""
    import xxhash

    found, words = [], []
    for words in _pieces(data.lower()):
        if len(words) >= SHINGLE:
            joined = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
            found.append(np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1))
    if not found and words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each list of hashes: the bits set in over half of them; zero for none."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    rows = -(-sizes // LANES)
    padded = np.zeros((int(rows.sum()), LANES), np.uint64)
    starts = np.cumsum(rows) - rows
    flat = padded.reshape(-1)
    for h, at in zip(hashes, (starts * LANES).tolist(), strict=True):
        flat[at : at + len(h)] = h
    sums = np.zeros((len(padded), 64), np.uint8)
    for lo in range(0, len(padded), 256):
        bits = np.unpackbits(padded[lo : lo + 256].view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little")
        bits.sum(axis=1, dtype=np.uint8, out=sums[lo : lo + 256])
    total = np.zeros((len(hashes), 64), np.int64)
    some = np.flatnonzero(rows)
    if len(some):
        total[some] = np.add.reduceat(sums, starts[some], axis=0, dtype=np.int64)
    return np.packbits(2 * total > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["data"].tolist()
        for lo, hi in char_blocks(map(len, texts), BLOCK_CHARS, BLOCK_ROWS):
            prints = majorities([shingle_hashes(x) for x in texts[lo:hi]])
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[lo:hi].astype("Int64"), "fp": prints.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row, fp the 64 bits as a signed number; null texts count as empty."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    with small_batches(docs.sparkSession):
        return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).mapInPandas(_fingerprints, "doc_id long, fp long"))


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """Plane k (of 64) holds bit k of 64 fingerprints a word; `prints` come in whole words."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    words = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(words).view("<u8")[:, :, 0].astype(np.uint64)


def within_radius(asked: np.ndarray, planes: np.ndarray, row: np.ndarray, word: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, lane) of the fingerprints in words that differ from an asked one in at most two bits.

    Pair i compares asked[row[i]] with the `lanes` of words word[i].  Counters of two bits a lane hold
    distances up to three; more stick in `over`.
    """
    at = np.arange(len(row))
    ones, twos, over = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64), ~lanes
    for step in range(0, 64, 2):
        mine = asked[row]
        # All ones where the asked bit is set: x has the lanes that differ in this plane.
        x, y = (planes[k][word] ^ (np.uint64(0) - ((mine >> np.uint64(k)) & np.uint64(1))) for k in ORDER[step : step + 2])
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        over |= twos & carry
        twos |= carry
        over |= ones & twos
        if step % 4 == 2:
            open_ = over != FULL
            if not open_.all():
                at, row, word, ones, twos, over = (v[open_] for v in (at, row, word, ones, twos, over))
        if not len(at):
            break
    near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(near)
    return at[pair], lane


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after rows a and b are linked."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        for end in (a, b):
            np.minimum.at(labels, labels[end], low)
            np.minimum.at(labels, end, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def link_groups(prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row that it is joined to by links in its group) of the rows that have one; groups follow one another."""
    words = -(-sizes // 64)
    first_word, first_row = np.cumsum(words) - words, np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(prints)) - first_row[group]
    padded = np.zeros(int(words.sum()) * 64, np.uint64)
    place = first_word[group] * 64 + within
    padded[place] = prints
    taken = np.zeros(len(padded), np.uint8)
    taken[place] = 1
    valid = np.packbits(taken.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)
    rows_at = np.zeros(len(padded), np.int64)
    rows_at[place] = np.arange(len(prints))
    planes = bit_planes(padded)
    # Each row meets the later lanes of its own word and the group's words after it.
    own = place // 64
    meets = first_word[group] + words[group] - own
    labels = np.arange(len(prints))
    ends = np.cumsum(meets)
    lo = 0
    while lo < len(prints):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        row = np.repeat(np.arange(lo, hi), meets[lo:hi])
        word = own[row] + np.arange(len(row)) - np.repeat(np.cumsum(meets[lo:hi]) - meets[lo:hi], meets[lo:hi])
        later = np.where(word == own[row], (FULL << (place[row] % 64).astype(np.uint64)) << np.uint64(1), FULL)
        pair, lane = within_radius(prints, planes, row, word, valid[word] & later)
        if len(pair):
            labels = _joined(labels, row[pair], rows_at[word[pair] * 64 + lane])
        lo = hi
    moved = np.flatnonzero(labels != np.arange(len(prints)))
    return moved, labels[moved]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) that join what is linked within the groups of sorted rows."""

    def links(frame: pd.DataFrame, keys: np.ndarray) -> pd.DataFrame:
        prints = frame["fp"].to_numpy().view(np.uint64)
        edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
        row, low = link_groups(prints, np.diff(edge))
        return pd.DataFrame({"u": prints[row].view(np.int64), "v": prints[low].view(np.int64)})

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < ROWS:
            continue
        frame = pd.concat(held, ignore_index=True)
        keys = frame[["t", "key", "sub"]].to_numpy()
        whole = int((keys != keys[-1]).any(1).sum())
        if whole:
            yield links(frame.iloc[:whole], keys[:whole])
        held, size = [frame.iloc[whole:]], 0 if whole else size
    if held and sum(map(len, held)):
        frame = pd.concat(held, ignore_index=True)
        yield links(frame, frame[["t", "key", "sub"]].to_numpy())


PAIRS_OF_FOUR = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def _quarters(bits: Column, width: int) -> list[Column]:
    """For each two of the four parts of a number of 4 x width bits: those two, and the other two, as numbers."""
    part = [F.shiftrightunsigned(bits, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for k in range(4)]
    joined = lambda i, j: F.shiftleft(part[i], width).bitwiseOR(part[j])
    rest = {(i, j): [k for k in range(4) if k not in (i, j)] for i, j in PAIRS_OF_FOUR}
    return [F.struct(F.lit(t).alias("t"), joined(i, j).alias("key"), joined(*rest[i, j]).alias("rest")) for t, (i, j) in enumerate(PAIRS_OF_FOUR)]


def linked_prints(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) among distinct fingerprints `fp`, enough to join all that are within the radius."""
    spark = prints.sparkSession
    keyed = prints.select("fp", F.explode(F.array(*_quarters(F.col("fp"), 16))).alias("x")).select("fp", "x.*")
    # Dealt otherwise than the join below, which so has exchanges of its own and can split a hot key.
    sizes = keyed.groupBy("t", "key", F.hash("t", "key").alias("_dealt")).agg(F.count("*").alias("n")).where("n > 1").drop("_dealt")
    shared = keyed.join(sizes, ["t", "key"])
    whole = F.array(F.lit(-1).cast("long"))
    split = F.array(*[F.shiftleft(x["t"].cast("long"), 16).bitwiseOR(x["key"]) for x in _quarters(F.col("rest"), 8)])
    groups = shared.select("t", "key", F.explode(F.when(F.col("n") > crowd, split).otherwise(whole)).alias("sub"), "fp")
    dealt = groups.repartition("t", "key", "sub").sortWithinPartitions("t", "key", "sub", "fp")
    with small_batches(spark, rows=ROWS):
        return durable(dealt.mapInPandas(_linked, "u long, v long").distinct())


def simhash_components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of `docs`.

    component_id is the least doc_id that links reach, its own included; equal fingerprints are
    linked.  Null texts count as empty; texts without words have fingerprint zero and are linked
    as any other.  Rows of null id are rows of their own, and an id that is null counts last: a
    component of null ids alone has a null component_id.  Repeated rows are returned as often as
    they come; texts of any length are read whole, in pieces; other columns play no part; no
    rows give no rows.
    """
    made = fingerprints(docs)
    prints = durable(made.groupBy("fp", F.hash("fp").alias("_dealt")).agg(F.min("doc_id").alias("low")).drop("_dealt"))
    links = linked_prints(prints.select("fp"), crowd)
    named = prints.withColumn("label", F.col("fp"))
    if not links.isEmpty():
        found = connected_components(links).select(F.col("node").alias("fp"), F.col("label").alias("joined"))
        named = prints.join(found, "fp", "left").select("fp", "low", F.coalesce("joined", "fp").alias("label"))
    named = durable(named)
    lows = named.groupBy("label", F.hash("label").alias("_dealt")).agg(F.min("low").alias("component_id")).drop("_dealt")
    whole = named.join(lows, "label").select("fp", "component_id")
    return made.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
