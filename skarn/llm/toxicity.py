"""Toxicity scores from a subsequence string kernel, Nystroem landmarks and a linear SVM.

Strings are words (runs of spaced-out single letters count as one word, and signs inside a word
are passed over).  The kernel of two words is the gap-weighted count of the length-P
subsequences they share, with spans of at most SPAN, decaying by DECAY for each position
spanned, normalised to 1 for equal words: words with gaps and inserted letters keep most of the
similarity.  Nystroem landmarks (words of the training sample) map each word to
K_mm^(-1/2) k(word, landmarks)^POWER, a sentence to the sum over its words, and a linear SVM with
squared hinge loss is trained on labelled sentences: all sentences of clean documents, and of
toxic ones those that the model itself finds most telling (multiple-instance rounds).  As the SVM
is linear, a word contributes one number; a document's score is a calibrated logistic function of
its sentences' margins.

Fitting uses at most SAMPLE labelled rows (the least hashes of doc_id, half of each label) of
together at most SAMPLE_CHARS characters, and at most CLEAN_SENTENCES sentences of each label in a
round; words over MAX_WORD characters are no landmarks.  These bound the fit alone: scoring reads
every whole text and every word of it.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ._common import Growing, Slots, id_bucket, mix64
from ._scoring import labelled_sample, scored

P, SPAN, DECAY, POWER = 4, 6, 0.85, 2
#: Word margins below this are left out of a document's sum.
FAINT = 1.0
#: Each word is divided by its norm to this power; at 1, long words with an insult in front would fade.
SCALED = 0.6
COST, ODD_COST = 0.2, 30
BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
LANDMARKS, SAMPLE, SAMPLE_CHARS, CLEAN_SENTENCES = 96, 4_000, 6_000_000, 80_000
MAX_WORD, CACHE_WORDS = 40, 250_000
SENTENCE_END, PIECE_CHARS = re.compile(r"(?<=[.!?])\s+|\n+"), 1_000
SIGNS = re.compile(r"[\W_]+")
SPACED = re.compile(r"(?<!\S)(?:[^\W_][\W_]{0,2}\s){2,}[^\W_](?=[\W_]{0,2}(?:\s|$))")
SHAPES = [(0, *c) for c in combinations(range(1, SPAN), P - 1)]


def words_of(text: str) -> list[str]:
    """White-space-separated words in lower case; runs of single letters are joined."""
    lowered = text.lower()
    if SPACED.search(lowered):
        lowered = SPACED.sub(lambda m: SIGNS.sub("", m[0]), lowered)
    return lowered.split()


def anchored(word: str) -> str:
    """The word's letters between marks for its start and end."""
    return "^" + SIGNS.sub("", word) + "$"


def openings(names: set[str]) -> set[str]:
    """Words between marks, and their openings of five to eight characters."""
    found = {w for w in map(anchored, names) if 4 < len(w) <= MAX_WORD}
    return found | {w[:n] for w in found for n in range(5, min(9, len(w)))}


def copy_marks(ids: np.ndarray) -> tuple:
    """Four min-hashes of three-word runs: copies share most of them."""
    x = np.pad(ids, (0, max(0, 3 - len(ids))), constant_values=-1).astype(np.uint64)
    with np.errstate(over="ignore"):
        runs = mix64(mix64(mix64(x[:-2]) + x[1:-1]) + x[2:])
    return tuple(int(mix64(runs ^ np.uint64(salt)).min()) for salt in (11, 22, 33, 44))


def word_pairs(ids: np.ndarray, vocab: list[str]) -> list[tuple[str, str]]:
    """Distinct (last word, word) of a document; the first word follows an empty one."""
    pairs = np.unique(np.r_[-1, ids[:-1]].astype(np.int64) * len(vocab) + ids) if len(ids) else []
    return [("" if p < 0 else vocab[p // len(vocab)], vocab[p % len(vocab)]) for p in pairs]


def choose_landmarks(docs: list[list[tuple[str, str]]], marks: list[tuple], halves: list[int], labels: np.ndarray, most: int) -> tuple[list[str], int]:
    """Words and openings of words: three in four those that tell the classes apart, then as many
    common words.

    `docs` has each document's distinct (last word, word).  A toxic document counts for a word only
    behind a last word that has not counted yet, so a passage that many share counts once.  What
    tells the classes apart in one half of the documents must hold in the other.  Of openings
    of one another with much the same counts, only one is taken, the longest of those that gain
    most.  Also returns how many tell the classes apart.
    """
    total = np.zeros(4)
    copies: set[tuple] = set()
    groups: list[int] = []
    for mark, y, half in zip(marks, labels, halves, strict=True):
        pairs = set(combinations(enumerate(mark), 2))  # one of each group of copies counts
        groups.append(-1 if copies & pairs else 2 * int(y) + half)
        if groups[-1] >= 0:
            copies |= pairs
            total[groups[-1]] += 1
    toxic: Counter = Counter()
    for names, k in zip(docs, groups, strict=True):
        if k >= 2:
            toxic.update(openings({w for _, w in names}))
    chance = math.log(len(toxic) + 1)  # what the best of so many would gain by chance
    slots = {w: i for i, w in enumerate(sorted(w for w, n in toxic.items() if n >= 3))}
    counts = np.zeros((len(slots), 4))
    contexts: set[tuple[int, str]] = set()
    for names, k in zip(docs, groups, strict=True):
        if k >= 2:
            by_word: dict[str, set[str]] = {}
            for last, word in names:
                by_word.setdefault(word, set()).add(last)
            new: set[int] = set()
            for word, before in by_word.items():
                for slot in (slots[w] for w in openings({word}) if w in slots):
                    fresh = {(slot, b) for b in before} - contexts
                    contexts |= fresh
                    if fresh:
                        new.add(slot)
            counts[list(new), k] += 1
        elif k >= 0:
            counts[[slots[w] for w in openings({w for _, w in names}) if w in slots], k] += 1
    names = list(slots)
    share = (counts + 0.5) / (total + 1)
    ratio = share[:, 2:] / share[:, :2]
    gain = counts[:, 2:] * np.log(ratio)
    told = (ratio > 8) & (gain > chance + 3)
    told = told & ((ratio > 8) & (counts[:, 2:] > 4))[:, ::-1]
    sure = (ratio > 4).all(1) & (gain.sum(1) > 3 * chance)
    gain = np.where(told.any(1) & (gain.sum(1) > 2.5 * chance) | sure, gain.sum(1), 0)
    chosen: list[str] = []
    for i in sorted(np.flatnonzero(gain > 0), key=lambda i: (-gain[i], -len(names[i]), names[i])):
        w = names[i]
        if not any((w.startswith(c) or c.startswith(w)) for c in chosen):
            chosen.append(w)
            if len(chosen) == most * 3 // 4:
                break
    n, taken = len(chosen), set(chosen)
    common = sorted((i for i, w in enumerate(names) if w.endswith("$") and w not in taken), key=lambda i: (-counts[i].sum(), names[i]))
    return chosen + [names[i] for i in common[: min(most - n, max(8, n))]], n


def variants(word: str) -> list[str]:
    """The word with one sign or letter put in at each inner place, and with one letter doubled."""
    inner = range(2, len(word) - 1)
    return [word[:k] + "xeoq"[k % 4] + word[k:] for k in inner] + [word[:k] + word[k - 1] + word[k:] for k in inner]


class Kernel:
    """Explicit subsequence features of many words at once."""

    def features(self, bare: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, feature, value) by string and feature; the values of each string make a unit vector."""
        sizes = np.fromiter(map(len, bare), np.int64, len(bare))
        codes = np.frombuffer("".join(bare).encode("utf-32-le"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(bare)), sizes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        keys = []
        with np.errstate(over="ignore"):
            for span in range(P, SPAN + 1):
                at = np.flatnonzero(room >= span)
                of = owner[at].astype(np.uint64) * np.uint64(BUCKETS)
                for shape in (x for x in SHAPES if x[-1] == span - 1):
                    h = codes[at]
                    for k in shape[1:]:
                        h = h * np.uint64(0x9E3779B1) + codes[at + k]
                    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
                    keys.append(((of + h) << np.uint64(2)) | np.uint64(span - P))
        key = np.sort(np.concatenate(keys).view(np.int64))
        if not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        one = DECAY ** np.arange(P, SPAN + 1)
        start = np.flatnonzero(np.r_[True, (key[1:] >> 2) != (key[:-1] >> 2)])
        value = np.add.reduceat(one[key & 3], start)
        key = key[start] >> 2
        row = key // BUCKETS
        norm = np.sqrt(np.bincount(row, value * value, len(bare)))
        return row, key % BUCKETS, value / norm[row] ** SCALED

    def table(self, landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The landmarks' features, as the row of each feature (0: in no landmark) and the rows."""
        row, feat, value = self.features(landmarks)
        used, at = np.unique(feat, return_inverse=True)
        rows = np.zeros((len(used) + 1, len(landmarks)), np.float32)
        rows[at + 1, row] = value
        place = np.zeros(BUCKETS, np.int32)
        place[used] = np.arange(1, len(used) + 1)
        return place, rows

    def against(self, bare: list[str], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Kernel of each string and each landmark of a table, to the POWER."""
        place, landmarks = table
        out = np.zeros((len(bare), landmarks.shape[1]), np.float32)
        for lo in range(0, len(bare), 2_000):
            row, feat, value = self.features(bare[lo : lo + 2_000])
            at = place[feat]
            some = at > 0
            row, feat, value = row[some], at[some], value[some]
            if len(row):
                start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                out[lo + row[start]] = np.add.reduceat(landmarks[feat] * value[:, None].astype(np.float32), start)
        return out**POWER


@dataclass
class Model:
    landmarks: list[str]
    word_weights: np.ndarray
    calibration: np.ndarray


class Scorer:
    """Applies a model to texts; remembers the numbers of distinct words."""

    def __init__(self, model: Model) -> None:
        self.model, self.kernel = model, Kernel()
        self.table = self.kernel.table(model.landmarks)
        self.reset()

    def reset(self) -> None:
        self.slots, self.margin, self.ends = Slots(), Growing(np.float32), Growing(bool)

    def inputs(self, texts: list[str]) -> np.ndarray:
        """Per text, what the calibration sees."""
        if len(self.slots) > CACHE_WORDS:
            self.reset()
        words = [words_of(t) for t in texts]
        at = np.fromiter((self.slots[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        if fresh := self.slots.fresh:
            self.slots.fresh = []
            self.margin.extend(self.kernel.against([anchored(w) for w in fresh], self.table) @ self.model.word_weights)
            self.ends.extend(np.array([w[-1] in ".!?" for w in fresh]))
        sizes = np.array([len(w) for w in words])
        return document_inputs(self.margin.data[at], self.ends.data[at], sizes)

    def score(self, texts: list[str]) -> np.ndarray:
        x = self.inputs(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.model.calibration[:-1] + self.model.calibration[-1], -30, 30)))


def document_inputs(margins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """From word margins: the best sentence, and the sum and density of telling words against length."""
    n = len(sizes)
    out = np.zeros((n, 5))
    if len(margins):
        owner = np.repeat(np.arange(n), sizes)
        start = np.flatnonzero(np.r_[True, ends[:-1] | (owner[1:] != owner[:-1])])
        sums = np.add.reduceat(margins.astype(float), start)
        best = np.full(n, -np.inf)
        np.maximum.at(best, owner[start], sums)
        full = sizes > 0
        telling = np.bincount(owner, np.clip(margins - FAINT, 0, FAINT), n)
        most = np.full(n, -np.inf)
        np.maximum.at(most, owner, margins)
        out[full, 0] = np.clip(best[full], 0, 2 * FAINT)
        out[full, 1] = np.clip(most[full], 0, 2 * FAINT)
        out[full, 2] = np.log1p(telling[full])
        out[full, 3] = np.sqrt(telling[full] / sizes[full])
        out[full, 4] = np.log(sizes[full])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for logistic regression; the last number is the intercept."""
    a = np.c_[x, np.ones(len(x))]
    w, c = np.zeros(a.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (c * (p - y)) + ridge * w
        hess = (a * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for a linear SVM; y is -1 or 1, the last number is the bias."""
    w = np.zeros(x.shape[1] + 1) if w is None else w
    keep = np.ones(len(w))
    keep[-1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x @ w[:-1] + w[-1])
        grad, hess = keep * w, np.diag(keep)
        for lo in range(0, len(x), 4_096):  # in parts, to bound memory
            on = lo + np.flatnonzero(slack[lo : lo + 4_096] > 0)
            a = np.c_[x[on], np.ones(len(on))].astype(float)
            grad = grad - 2 * a.T @ (cost[on] * y[on] * slack[on])
            hess = hess + 2 * (a * cost[on][:, None]).T @ a
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(texts: list[str], labels: np.ndarray, share: float | None = None, landmarks: int = LANDMARKS) -> Model:
    """Train on whole texts with 0/1 labels, of which a share (theirs, unless given) are 1 elsewhere.  Without both labels the score is the label's share."""
    labels = np.asarray(labels, int)
    if not 0 < labels.sum() < len(labels):
        share = np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3)
        return Model(["^$"], np.zeros(1), np.r_[np.zeros(5), np.log(share / (1 - share))])
    kernel, slots = Kernel(), Slots()
    coded = [np.fromiter((slots[w] for w in words_of(t)), np.int32, -1) for t in texts]
    vocab = list(slots)
    halves = [zlib.crc32(t.encode()) % 2 for t in texts]
    chosen, telling = choose_landmarks([word_pairs(x, vocab) for x in coded], [copy_marks(x) for x in coded], halves, labels, landmarks)
    table = kernel.table(chosen)
    gram = kernel.against(chosen, table).astype(float)
    spectrum, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors * np.where(spectrum > 1e-3 * spectrum.max(), np.maximum(spectrum, 1e-12) ** -0.5, 0)
    # Sentences as sums of their words' Nystroem features.
    mapped = np.concatenate([kernel.against([anchored(w) for w in vocab[k : k + 20_000]], table) @ root.astype(np.float32) for k in range(0, len(vocab), 20_000)])
    ends = np.array([w[-1] in ".!?" for w in vocab], bool)
    sentences, of = [], []
    for k, x in enumerate(coded):
        if len(x):
            start = np.flatnonzero(np.r_[True, ends[x[:-1]]])
            sentences.append(np.add.reduceat(mapped[x], start))
            of.append(np.full(len(start), k))
    sentences, of = np.concatenate(sentences), np.concatenate(of)
    bad = labels[of] == 1
    clean_rows = np.flatnonzero(~bad)
    if len(clean_rows) > CLEAN_SENTENCES:
        clean_rows = clean_rows[np.argsort(mix64(clean_rows.astype(np.uint64)))[:CLEAN_SENTENCES]]
    chosen_bad, w = np.flatnonzero(bad), None
    if len(chosen_bad) > CLEAN_SENTENCES:
        chosen_bad = chosen_bad[np.argsort(mix64(chosen_bad.astype(np.uint64)))[:CLEAN_SENTENCES]]
    # Telling words with something put in are sentences of their own, in the last rounds.
    odd = [v for c in chosen[:telling] if len(c) > 6 and c.endswith("$") for v in variants(c)]
    odd_rows = (kernel.against(odd, table) @ root).astype(np.float32) if odd else mapped[:0]
    for turn in range(6):
        rows = np.r_[clean_rows, chosen_bad]
        more = odd_rows if turn > 2 else odd_rows[:0]
        y = np.r_[np.where(labels[of[rows]] == 1, 1.0, -1.0), np.ones(len(more))]
        cost = np.where(y > 0, 0.5 * len(y) / max(1, (y > 0).sum()), 0.5 * len(y) / max(1, (y < 0).sum())) * COST
        cost[len(rows) :] *= ODD_COST
        w = squared_hinge(np.concatenate([sentences[rows], more]), y, cost, w)
        margin = sentences @ w[:-1] + w[-1]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, of, margin)
        chosen_bad = np.flatnonzero(bad & ((margin >= best[of]) | (margin > 0)))
    word_weights = (root @ w[:-1]).astype(np.float32)
    at, sizes = np.concatenate(coded), np.array([len(x) for x in coded])
    x = document_inputs((mapped @ w[:-1])[at], ends[at], sizes)
    share = labels.mean() if share is None else share
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    return Model(chosen, word_weights, logistic(x, labels, weight=weight))


def drawn(text: str, most: int) -> str:
    """A text of at most `most` characters: of a longer one the sentences of least hash that fit, in their order."""
    if len(text) <= most:
        return text
    parts = [p[k : k + PIECE_CHARS] for p in SENTENCE_END.split(text) for k in range(0, len(p), PIECE_CHARS)]
    kept, left = [], most
    for k in sorted(range(len(parts)), key=lambda k: (zlib.crc32(parts[k].encode("utf-8", "replace")), k)):
        if len(parts[k]) + 1 <= left:
            kept.append(k)
            left -= len(parts[k]) + 1
    return " ".join(parts[k] for k in sorted(kept))


def within_chars(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of each label, rows of together at most most / 2 characters, in the order of their ids' hashes.

    A row that does not fit is passed over, and one document has a tenth of the budget at most,
    in sentences drawn from it.
    """
    budget = most // 2
    rows = rows.assign(text=[drawn(t, max(1, budget // 10)) for t in rows["text"].fillna("")])
    with np.errstate(over="ignore"):
        place = mix64(rows["doc_id"].to_numpy(np.int64).view(np.uint64))
    rows = rows.assign(_place=place).sort_values(["_place", "text"], kind="stable").drop(columns="_place")
    left: dict[int, int] = {}
    fits = []
    for y, size in zip(rows["y"], map(len, rows["text"]), strict=True):
        fits.append(size <= left.setdefault(y, budget))
        left[y] -= size * fits[-1]
    return rows[np.array(fits, bool)]


def fit_on_sample(docs: DataFrame, labels: DataFrame, modulus: int, held: int, most: int = SAMPLE) -> Model:
    """Fit on labelled rows whose id's crc32 modulo `modulus` is not `held`; see SAMPLE.

    One task holds the sample and fits; the driver gets the model alone.
    """
    train = labels.where(id_bucket("doc_id", modulus) != held)
    rows, share = labelled_sample(docs, train, "toxic", most, balanced=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            found = within_chars(pd.concat(parts, ignore_index=True), SAMPLE_CHARS)
            model = fit(found["text"].tolist(), found["y"].to_numpy(int), share)
            yield pd.DataFrame({"model": [pickle.dumps(model)]})

    found = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros(0, int))


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with a score for each whole text in a column of that name; null and empty texts get the score of no words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda: Scorer(sent.value).score, name)
