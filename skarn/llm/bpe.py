"""Byte-level BPE encoding and decoding from a file of ranks.

Method: the words of a text (matches of the file's pattern) are reduced to distinct words, a fold
of ranked merges over each word's bytes gives its ids, and ids decode to concatenated binary
pieces of the inverted rank map.  `merge_words_native` is the fold as Spark higher-order
functions over a literal rank map; the README has the figures for which the main path runs the
same fold in Python workers instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import char_blocks

#: Distinct parts and words that a worker keeps; it starts anew beyond that, to save memory.
CACHE_ENTRIES = 400_000
BLOCK_CHARS, BLOCK_ROWS = 2_000_000, 2_000
LONG_WORD = 96
#: Other white space on both sides of a space, or alone between two.
MEETING = re.compile(r"[^\S ] [^\S ]| [^\S ]+(?: |$)")
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The rank of each piece, from lines of base64 and a number."""
    return {base64.b64decode(k): int(v) for k, v in (line.split() for line in data.splitlines() if line.strip())}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _fold_long(word, ranks)
    none = 1 << 62
    parts = [word[i : i + 1] for i in range(len(word))]
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while costs and (least := min(costs)) < none:
        i = costs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap, for words whose length would make rescans slow."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[i], end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class RankMap:
    """Ranks of merged pairs of ids, for whole arrays: an open-addressed table."""

    NONE = np.int64(1 << 40)

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {
            ranks[piece[:k]] << 20 | ranks[piece[k:]]: rank
            for piece, rank in ranks.items()
            for k in range(1, len(piece))
            if piece[:k] in ranks and piece[k:] in ranks
        }
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.NONE, np.int64)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of rivals for a slot, one stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has none or an end is -1."""
        out = np.full(left.shape, self.NONE)
        where = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[where] << 20 | right.ravel()[where]
        at = self._slot(keys)
        while len(where):
            seen = self.keys[at]
            hit = seen == keys
            out.ravel()[where[hit]] = self.values[at[hit]]
            on = ~hit & (seen >= 0)
            where, keys, at = where[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


def fold_many(words: list[bytes], ranks: dict[bytes, int], pairs: RankMap) -> list[list[int]]:
    """`fold_merges` of many words at once: each round merges every word's pair of lowest rank."""
    out: list[list[int]] = [[] for _ in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = fold_merges(words[i], ranks)
    least = 0
    for width in (6, 9, 13, 20, 36, LONG_WORD):
        of = np.flatnonzero((sizes > least) & (sizes <= width))
        least = width
        for lo in range(0, len(of), 20_000):
            rows = of[lo : lo + 20_000]
            n = sizes[rows]
            column = np.arange(width)
            ids = np.full((len(rows), width), -1, np.int64)
            ids[column < n[:, None]] = pairs.bytes[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
            cost = np.full(ids.shape, RankMap.NONE)
            cost[:, :-1] = pairs.of(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(rows))
            while len(live):
                at = cost[live].argmin(1)
                rank = cost[live, at]
                go = rank < RankMap.NONE
                live, at, rank = live[go], at[go], rank[go]
                if not len(live):
                    break
                shift = np.minimum(column + (column > at[:, None]), width - 1)
                now, price = np.take_along_axis(ids[live], shift, 1), np.take_along_axis(cost[live], shift, 1)
                now[:, -1], price[:, -1] = -1, RankMap.NONE
                k = np.arange(len(live))
                now[k, at] = rank
                after = np.where(at + 1 < width, now[k, np.minimum(at + 1, width - 1)], -1)
                before = np.where(at > 0, now[k, np.maximum(at - 1, 0)], -1)
                price[k, at] = pairs.of(rank, after)
                some = np.flatnonzero(at > 0)
                price[some, at[some] - 1] = pairs.of(before[some], rank[some])
                ids[live], cost[live] = now, price
            for i, row in zip(rows, ids.tolist(), strict=True):
                out[i] = row[: row.index(-1)] if row[-1] < 0 else row
    return out


class Codec:
    """Encodes whole texts and decodes the ids, by distinct words.

    A text is taken apart at single spaces first: the pattern joins nothing across one but the
    space to what follows.  Where white space meets such a space the pattern runs over the whole
    text.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.words_of = ranks, regex.compile(pattern).findall
        self.pairs = RankMap(ranks)
        self.pieces = {v: k for k, v in ranks.items()}
        self.words: dict[str, list[int]] = {}
        self.parts: dict[str, tuple[str, bytes]] = {}

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, after encoding those that are new."""
        found = [self.words_of(t) for t in texts]
        new = [w for w in dict.fromkeys(w for ws in found for w in ws) if w not in self.words]
        self.words.update(zip(new, fold_many([w.encode() for w in new], self.ranks, self.pairs), strict=True))
        return found

    def encode(self, text: str) -> list[int]:
        return [i for w in self.learn([text])[0] for i in self.words[w]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _show(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Of each text, the ids in decimal and the bytes they decode to."""
        ids = [[i for w in ws for i in self.words[w]] for ws in self.learn(texts)]
        return [(" ".join(map(str, x)), self.decode(x)) for x in ids]

    @staticmethod
    def parted(text: str) -> list[str] | None:
        """The text at its single spaces, or None where white space meets one of them."""
        if text[:1] == " " or text[-1:] == " " or "  " in text or MEETING.search(text):
            return None
        return text.split(" ")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text, the number of ids, and hex SHA-256 of the ids as text and of the decoded bytes."""
        if len(self.words) + len(self.parts) > CACHE_ENTRIES:
            self.words, self.parts = {}, {}
        parted = [self.parted(t) for t in texts]
        new = list({x for p in parted if p for x in p[1:]} - self.parts.keys())
        self.parts.update(zip(new, self._show([" " + x for x in new]), strict=True))
        firsts = self._show([p[0] if p else t for t, p in zip(texts, parted, strict=True)])
        out = []
        for first, parts in zip(firsts, parted, strict=True):
            shown = [first, *map(self.parts.__getitem__, parts[1:])] if parts else [first]
            ids = " ".join([x for x, _ in shown])
            decoded = hashlib.sha256(b"".join([x for _, x in shown])).hexdigest()
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), decoded))
        return out


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded bytes, over whole texts.

    Null texts are empty ones, of no ids.  Extra columns are ignored.  The rank file (one
    tokenizer's, of fixed size) is sent to each executor once.
    """
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(parse_ranks(sent.value), pattern)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in char_blocks(map(len, texts), BLOCK_CHARS, BLOCK_ROWS):
                rows = [(i, *x) for i, x in zip(batch["doc_id"].iloc[a:b], codec.digests(texts[a:b]), strict=True)]
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, DIGESTS)


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(parse_ranks(sent.value), pattern)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, ids array<int>")


def merge_words_native(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of each word of an array of binary words, by higher-order functions alone.

    Each word is an array of one-byte pieces; a fold over its length merges the leftmost pair of
    the lowest rank in a literal rank map.
    """
    table = F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (bytearray(k), v)])

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda x, i: F.struct(F.element_at(table, F.concat(x, F.get(parts, i + 1))).alias("rank"), i.alias("at")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))
        at = best["at"]
        merged = F.concat(
            F.slice(parts, F.lit(1), at),
            F.array(F.concat(F.get(parts, at), F.get(parts, at + 1))),
            F.slice(parts, at + 3, F.size(parts)),
        )
        return F.when(at.isNull(), parts).otherwise(merged)

    def fold(word: Column) -> Column:
        size = F.octet_length(word)
        start = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
        return F.transform(F.aggregate(F.sequence(F.lit(1), size), start, step), lambda p: F.element_at(table, p))

    return F.transform(words, fold)
