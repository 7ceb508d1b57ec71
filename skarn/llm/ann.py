"""Approximate nearest neighbours by score-aware quantisation and exact reranking.

Method: each component is a subspace of its own, coded by one of sixteen codewords (four bits).  Training weighs the part of a residual that is parallel to its vector more than the
rest, since that part changes large inner products most: codewords are the solutions of weighted
least squares, and codes are chosen by coordinate descent on the anisotropic loss.  A query reads
one table of 256 sums for each byte (two codes), and the best of this scan are scored again on
the original vectors.

The scan selects.  A residual's part along its vector only scales the inner product, so the scan
divides it out, exactly.  What is left is the product of two vectors orthogonal to the row: the
rest of the residual and the rest of the query, whose norms are known.  A row is scored exactly if
its scan and the product of those norms reach the k-th exact score found, so no row of the best
k is lost, however many rows have the same codes.  For near copies both rests are small, and the
bound is narrow just where many rows are alike.

The codebook is fitted on a bounded sample (SAMPLE rows of least hash); all rows are indexed, each
once, in blocks of bounded size by which the queries pass in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import CANDIDATES, FINITE, best_rows, blocks, search

K, SAMPLE, SUB, CODES = 20, 10_000, 1, 16
#: Parallel residuals weigh this many times the others.
PARALLEL, ROUNDS, SWEEPS = 4.0, 10, 2
#: Rows of each block that are scored exactly first for each query, and rows scored at a time.
RERANK, AT_ONCE = 96, 1_024
#: Codes that keep a smaller share of their row are not scaled.
KEPT = 0.25


def padded(x: np.ndarray) -> np.ndarray:
    """Components in float64, with zeros up to a whole number of bytes of codes."""
    extra = -x.shape[1] % (2 * SUB)
    return np.pad(x.astype(float), ((0, 0), (0, extra)))


def encode(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on |r|^2 + (PARALLEL - 1) (r.x / |x|)^2."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, SUB)
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    residual = parts[:, :, None, :] - books[None]
    square = (residual**2).sum(3)
    along = (residual * parts[:, :, None, :]).sum(3) / norm[:, None, None]
    codes = square.argmin(2)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(SWEEPS):
        for j in range(m):
            others = total - along[np.arange(n), j, codes[:, j]]
            cost = square[:, j] + (PARALLEL - 1) * (others[:, None] + along[:, j]) ** 2
            codes[:, j] = cost.argmin(1)
            total = others + along[np.arange(n), j, codes[:, j]]
    return codes


def fit(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Codebooks (subspaces x codes x SUB) of padded rows."""
    rng = np.random.default_rng(seed)
    n, m = len(x), x.shape[1] // SUB
    parts = x.reshape(n, m, SUB)
    evenly = ((np.arange(CODES) + 0.5) / CODES * n).astype(int)
    books = np.stack([parts[np.lexsort(parts[:, j].T)[evenly], j] for j in range(m)])
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    for _ in range(ROUNDS):
        codes = encode(x, books)
        quantised = books[np.arange(m)[None], codes]
        for j in range(m):
            other = ((parts - quantised) * unit).sum((1, 2)) - ((parts[:, j] - quantised[:, j]) * unit[:, j]).sum(1)
            for c in range(CODES):
                on = codes[:, j] == c
                if on.sum() < 2:
                    books[j, c] = parts[rng.integers(0, n), j]
                    continue
                u, p = unit[on, j], parts[on, j]
                a = on.sum() * np.eye(SUB) + (PARALLEL - 1) * u.T @ u
                b = p.sum(0) + (PARALLEL - 1) * (u * ((u * p).sum(1) + other[on])[:, None]).sum(0)
                books[j, c] = np.linalg.solve(a + 1e-9 * np.eye(SUB), b)
            quantised[:, j] = books[j, codes[:, j]]
    return books


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> Iterator[np.ndarray]:
    """Approximate inner products of each query and all coded rows, by one table a byte."""
    pairs = np.ascontiguousarray((codes[:, 0::2] * CODES + codes[:, 1::2]).T.astype(np.intp))
    for q in queries.reshape(len(queries), len(books), SUB):
        table = np.einsum("mcs,ms->mc", books, q).astype(np.float32)
        two = (table[0::2, :, None] + table[1::2, None, :]).reshape(len(pairs), -1)
        total = np.zeros(pairs.shape[1], np.float32)
        for t, at in zip(two, pairs, strict=True):
            total += t.take(at)
        yield total


def exact_scores(q: np.ndarray, candidates: np.ndarray, rows: np.ndarray) -> np.ndarray:
    parts = [(candidates[rows[a : a + AT_ONCE]] * q).sum(1) for a in range(0, len(rows), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Coded:
    """A block's codes and what its rows' residuals leave open."""

    def __init__(self, candidates: np.ndarray, books: np.ndarray) -> None:
        n = len(candidates)
        self.books, self.codes = books, np.concatenate([encode(padded(candidates[a : a + AT_ONCE]), books) for a in range(0, n, AT_ONCE)])
        self.square, self.kept, self.rest, self.slack = (np.zeros(n) for _ in range(4))
        for a in range(0, n, AT_ONCE):
            at = slice(a, a + AT_ONCE)
            x = padded(candidates[at])
            quantised = books[np.arange(len(books))[None], self.codes[at]].reshape(x.shape)
            square = np.maximum((x**2).sum(1), 1e-300)
            residual = ((x - quantised) ** 2).sum(1)
            kept = (quantised * x).sum(1) / square
            along = np.where(kept > KEPT, (1 - kept) ** 2 * square, 0)
            self.square[at], self.kept[at] = square, np.where(kept > KEPT, kept, 1.0)
            self.rest[at] = np.sqrt(np.maximum(residual - along, 0)) / self.kept[at]
            # The tables and their sums are in single precision, the scores in double.
            self.slack[at] = (np.sqrt((quantised**2).sum(1)) + np.sqrt(square)) * (len(books) + 8) * 2.0**-23
        # What isn't scaled has all of its error open.
        self.scaled = self.kept != 1.0

    def bounds(self, q: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, upper bounds) of the inner products, from the scan."""
        norm = np.sqrt((q**2).sum())
        estimate = about / self.kept
        widest = norm * self.rest
        # The query's part orthogonal to a row is largest where the product is nearest to zero.
        least = np.maximum(np.abs(estimate) - widest, 0)
        across = np.where(self.scaled, np.sqrt(np.maximum(norm**2 - least**2 / self.square, 0)), norm)
        return estimate, estimate + across * self.rest + self.slack * norm


def index_block(candidates: np.ndarray, books: np.ndarray | None, k: int, rerank: int) -> Callable:
    """Code a block once; the function returned yields the best k of each query.

    Exact scores of the `rerank` best of the table scan come first, then those of the rows whose
    bound reaches the k-th of them.
    """
    n = len(candidates)
    coded = None
    if books is not None and n > rerank + 1 and padded(candidates[:1]).shape[1] == books.shape[0] * SUB:
        coded = Coded(candidates, books)

    def find(queries: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        scans = scan(padded(queries), coded.codes, books) if coded else None
        for i, q in enumerate(queries):
            if coded:
                estimate, most = coded.bounds(q, next(scans))
                first = best_rows(estimate, rerank + 1)
                first = first[first != own[i]]
                found = exact_scores(q, candidates, first)
                least = np.partition(found, len(found) - k)[len(found) - k] if len(found) >= k else -np.inf
                open_ = ~(most < least)
                open_[first] = False
                rest = np.flatnonzero(open_)
                rest = rest[rest != own[i]]
                rows, scores = np.r_[first, rest], np.r_[found, exact_scores(q, candidates, rest)]
                order = np.argsort(rows)
                rows, scores = rows[order], scores[order]
            else:
                rows = np.arange(n)
                rows = rows[rows != own[i]]
                scores = exact_scores(q, candidates, rows)
            best = best_rows(scores, k)
            yield i, rows[best], scores[best]

    return find


def nearest(vectors: DataFrame, every: int = 20, k: int = K, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): near each query's k largest inner products, best first.

    Queries are rows whose vec_id is divisible by `every`; candidates all other rows of as many
    components; ties go to the smaller vec_id, null last.  Null and zero vectors, and those with
    null or non-finite components, take no part.  Scores are double inner products of the
    original vectors.  Vectors of another size than the sample's commonest are scored exactly.
    """
    keep = f"{FINITE} and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), "vec_id").where(keep)
    sample = [r[0] for r in rows.orderBy(F.xxhash64("vec_id", "embedding")).select("embedding").limit(SAMPLE).collect()]
    books = None
    if sample:
        sizes = [len(v) for v in sample]
        dim = max(set(sizes), key=sizes.count)
        books = fit(padded(np.array([v for v in sample if len(v) == dim])))
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    return search(blocks(vectors, every, keep, CANDIDATES), lambda x: index_block(x, sent.value, k, rerank), k, "double").withColumn("rank", F.col("rank").cast("int"))
