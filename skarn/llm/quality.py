"""Quality scores from histogram gradient-boosted trees over document statistics.

Each document becomes a row of statistics (shares of character classes, word and line lengths,
repetition, compressibility).  Trees are grown level by level on histograms of binned statistics
for logistic loss, and kept as complete binary trees in flat arrays, which numpy walks for all
rows and trees at once.  Fitting uses at most SAMPLE labelled rows (those of least hash of
doc_id), of which only the statistics reach the driver; scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ._common import Slots, char_blocks, id_bucket, memory_returned
from ._scoring import BLOCK_CHARS, BLOCK_ROWS, labelled_sample, scored

SAMPLE, TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 20_000, 60, 4, 64, 0.2, 2.0, 20
CACHE_WORDS = 100_000

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" ",
    "line": b"\n\r",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "sign": b"#$%&*+<=>@\\^_`{}~[]()/\"'-",
    "wide": bytes(range(128, 256)),
}
NAMES = [*CLASSES, "log_size", "word_length", "word_spread", "same_as_last", "distinct_words", "odd_words", "lines_per_word", "distinct_lines", "packed"]


class Statistics:
    """Rows of statistics of whole texts; an empty text is a row of zeros."""

    def __init__(self) -> None:
        self.table = np.full(256, len(CLASSES), np.int64)
        for k, members in enumerate(CLASSES.values()):
            self.table[list(members)] = k
        self.slots, self.lengths, self.odd = Slots(), np.zeros(0), np.zeros(0)

    def rows(self, texts: list[str]) -> np.ndarray:
        if len(self.slots) > CACHE_WORDS:
            self.slots, self.lengths, self.odd = Slots(), np.zeros(0), np.zeros(0)
        out = np.zeros((len(texts), len(NAMES)))
        for i, text in enumerate(texts):
            data = text.encode()
            if not data:
                continue
            codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            out[i, : len(CLASSES)] = np.bincount(self.table, codes, len(CLASSES) + 1)[:-1] / len(data)
            words = text.split()
            at = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
            if fresh := self.slots.fresh:
                self.slots.fresh = []
                self.lengths = np.append(self.lengths, [len(w) for w in fresh])
                self.odd = np.append(self.odd, [not (w[:-1] or w).isalpha() or w[1:] != w[1:].lower() for w in fresh])
            lines = text.split("\n")
            n, sizes = max(1, len(words)), self.lengths[at]
            out[i, len(CLASSES) :] = (
                np.log1p(len(data)),
                sizes.mean() if len(at) else 0,
                sizes.std() if len(at) else 0,
                (at[1:] == at[:-1]).sum() / n,
                len(np.unique(at)) / n,
                self.odd[at].sum() / n,
                len(lines) / n,
                len(set(lines)) / len(lines),
                len(zlib.compress(data, 1)) / len(data),
            )
        return out


@dataclass
class Forest:
    """Complete binary trees: node k of a tree has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[trees, node]
            node = 2 * node + 1 + (x[rows, f] > self.threshold[trees, node])
        return self.start + self.value[trees, node - (2**DEPTH - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost trees for logistic loss.  With no rows or one label, the score is the label's share."""
    n, inner = len(x), 2**DEPTH - 1
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    forest = Forest(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)), float(np.log(share / (1 - share))))
    if not n or not 0 < y.sum() < n:
        return forest
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    width = x.shape[1] * BINS
    flat = bins + np.arange(x.shape[1]) * BINS
    margin = np.full(n, forest.start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            key = ((node - first)[:, None] * width + flat).ravel()
            sums = [
                np.bincount(key, np.repeat(v, x.shape[1]), many * width).reshape(many, -1, BINS).cumsum(2)
                for v in (grad, hess, np.ones(n))
            ]
            (g, h, c), (gt, ht, ct) = sums, [s[:, :, -1:] for s in sums]
            gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((c >= LEAST) & (ct - c >= LEAST), gain, -1)
            best = gain.reshape(many, -1).argmax(1)
            for k, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[k, f, cut] > 1e-6 and cut < len(cuts[f]):
                    forest.feature[t, first + k], forest.threshold[t, first + k] = f, cuts[f][cut]
            f = forest.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > forest.threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        forest.value[t] = -RATE * g / (h + RIDGE)
        margin += forest.value[t][leaf]
    return forest


def fit_on_sample(docs: DataFrame, labels: DataFrame, modulus: int, held: int, most: int = SAMPLE) -> Forest:
    """Fit on labelled rows whose id's crc32 modulo `modulus` is not `held`; see SAMPLE."""
    with memory_returned():
        return _fit_on_sample(docs, labels, modulus, held, most)


def _fit_on_sample(docs: DataFrame, labels: DataFrame, modulus: int, held: int, most: int) -> Forest:
    train = labels.where(id_bucket("doc_id", modulus) != held)
    rows, _ = labelled_sample(docs, train, "quality", most)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        statistics = Statistics()
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in char_blocks(map(len, texts), BLOCK_CHARS, BLOCK_ROWS):
                found = statistics.rows(texts[a:b])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b], "y": batch["y"].iloc[a:b], "x": list(found)})

    found = rows.mapInPandas(measure, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(NAMES)))
    return fit(x, found["y"].to_numpy(float))


def score_documents(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """`docs` with a score for each whole text in a column of that name; null texts count as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        statistics, model = Statistics(), sent.value
        return lambda texts: model.score(statistics.rows(texts))

    return scored(docs, make, name)
