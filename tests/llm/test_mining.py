"""Hard negatives, SimHash components and source divergence against brute force, with odd rows."""

import collections
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from skarn.llm import divergence, hard_negatives, queries, simhash

from ..conftest import SMALL

INF, NAN = float("inf"), float("nan")
VECTORS = "vec_id long, label int, embedding array<float>, uid string, block int, score double"


# 11


def brute_negatives(rows, every, positives, negatives, low=80, high=100, scale=256):
    """All rows by plain loops over Python integers."""
    kept = [(k, i, label, [math.floor(scale * float(x)) for x in v]) for k, (i, label, v) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, i, label, v in kept:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, m) for n, j, m, w in kept if n != k and len(w) == len(v)]
        for score, j, _ in sorted((x for x in scored if x[2] == label), key=order)[:positives]:
            fit = [x for x in scored if x[2] != label and low * score <= 100 * x[0] <= high * score]
            out += [(i, j, r, n, score, s) for r, (s, n, _) in enumerate(sorted(fit, key=order)[:negatives], 1)]
    return collections.Counter(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    rows = [(k, int(rng.integers(0, 4)), (centres[rng.integers(0, 5)] + 0.3 * rng.normal(size=6)).astype(np.float32).tolist()) for k in range(400)]
    one = rows[7][2]
    rows += [(1000 + k, k % 3, one) for k in range(300)]  # copies of one vector under several labels
    rows += [rows[0], rows[10], (None, 1, one), (None, 2, rows[3][2]), (2000, None, one), (2010, 1, None), (2020, 1, [None, *one[1:]])]
    rows += [(2030, 1, [NAN, *one[1:]]), (2040, 1, [INF, *one[1:]]), (2050, 1, [1.0, 2.0]), (2060, 1, [1.0, 2.5]), (2061, 2, [1.0, 2.0]), (2070, 1, []), (2080, 3, [0.0] * 6), (2090, 0, [-x for x in one])]
    return rows


def mined(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "u", 1, 0.5) for r in rows], VECTORS).repartition(5)
    got = hard_negatives.hard_negatives(frame, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(map(tuple, got.collect()))


def test_hard_negatives_equal_brute_force(spark, vectors):
    assert mined(spark, vectors, every=10) == brute_negatives(vectors, 10, 5, 5)
    assert mined(spark, [], every=10) == {}
    assert mined(spark, vectors[:3], every=1) == brute_negatives(vectors[:3], 1, 5, 5)


def test_hard_negatives_in_many_small_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 64)
    monkeypatch.setattr(hard_negatives, "PIVOTS", 8)
    assert mined(spark, vectors, every=7, positives=3, negatives=4, low=50, high=90) == brute_negatives(vectors, 7, 3, 4, 50, 90)


def test_hard_negatives_of_huge_components(spark):
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, (rng.normal(size=3) * 3e4).astype(np.float32).tolist()) for k in range(60)]
    assert mined(spark, rows, every=10) == brute_negatives(rows, 10, 5, 5)


def test_annuli_pass_over_what_the_bounds_exclude():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8))
    near = np.concatenate([c + 0.03 * rng.normal(size=(100, 8)) for c in centres])
    x = np.floor(256 * near / np.linalg.norm(near, axis=1)[:, None])
    most = float((x**2).sum(1).max())
    whole = hard_negatives.augmented(x, most)
    pivots = hard_negatives.fit_pivots(whole, 30)
    far = hard_negatives.distances(whole, pivots)
    n = np.arange(len(x))
    frame = pd.DataFrame({"uid": n, "vid": n, "missing": False, "label": n % 3, "embedding": list(x), "pivot": far.argmin(1), "dist": far.min(1)})
    block, seen = hard_negatives.Block(frame, 8, pivots, most), []
    exact = block.scores
    block.scores = lambda q, rows: seen.append(len(rows)) or exact(q, rows)
    for k in range(0, len(x), 100):
        block.same_label(x[k], int(k % 3), k, 5, np.inf)
    assert sum(seen) < 0.5 * 1000 * 30  # of the 1,000 rows of the label that each of 30 searches could read


# 12

ODD = [None, "", " \n\t", "a", "A b", "a\x0bB", "é É x", "É é x y", "w " * 5000, "one two three four five six"]


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return collections.Counter((i, f"{p:016x}", low.get(root(k))) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True)))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    texts = [*ODD]
    for _ in range(25):
        own = rng.choices(words, k=rng.randint(60, 400))
        for _ in range(rng.randint(1, 6)):
            edited = [*own]
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            texts.append(" ".join(edited))
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[12]), (None, "nothing else says so"), (3, texts[13])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, label int")
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})
    assert collections.Counter(map(tuple, simhash.simhash_components(frame).collect())) == want
    # Keys that are split again find the same links.
    assert collections.Counter(map(tuple, simhash.simhash_components(frame, crowd=1).collect())) == want
    assert simhash.simhash_components(frame.limit(0)).count() == 0


def test_simhash_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, queries.op12_simhash(spark, SMALL).collect())) == brute_components(rows)


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_shingles_of_long_texts_in_pieces(monkeypatch, size):
    rng = random.Random(size)
    for _ in range(20):
        text = "".join(rng.choice("ab \n\x0bÉ") for _ in range(rng.randint(0, 200))).encode()
        whole = simhash.shingle_hashes(text)
        with monkeypatch.context() as m:
            m.setattr(simhash._pieces, "__defaults__", (size,))
            assert simhash.shingle_hashes(text).tolist() == whole.tolist()


def test_fingerprint_groups(spark):
    """Dense groups: every fingerprint within reach of others, in more than one word of lanes."""
    rng = np.random.default_rng(0)
    prints = np.unique(rng.integers(0, 4096, 700)).astype(np.uint64)
    sizes = [100, 1, 300, len(prints) - 401]
    row, low = simhash.link_groups(prints, np.array(sizes))
    got = np.arange(len(prints))
    got[row] = low
    for lo, n in zip(np.cumsum([0, *sizes[:-1]]), sizes, strict=True):
        near = np.array([[(int(a) ^ int(b)).bit_count() <= 2 for b in prints[lo : lo + n]] for a in prints[lo : lo + n]])
        label = np.arange(n)
        for _ in range(n):
            label = np.array([label[x].min() for x in near])
        assert (got[lo : lo + n] - lo == label).all()
    frame = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    links = {tuple(r) for r in simhash.linked_prints(frame, crowd=64).collect()}
    assert all((u ^ v).bit_count() >= 1 for u, v in links)


# 13


def brute_divergence(rows, min_docs, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    used, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang or "", source or ""))
        used.update((lang or "", source or "", t) for t in terms)
        docs.update((lang or "", t) for t in set(terms))
    out = []
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), d in docs.items() if x == lang and d >= min_docs)
        sources = [s for x, s in groups if x == lang]
        total = lambda s: sum(used[lang, s, t] for t in kept)  # noqa: B023, E731
        p = {s: {t: share(used[lang, s, t], total(s), len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(used[lang, s, t] for s in sources), sum(map(total, sources)), len(kept)) for t in kept}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if used[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found[:most], 1)]
    return collections.Counter(out)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The", "Été", "été", "naïve", "x1y", "a_b", "don't", "日本語", "\u0085z", "𝒜bc", "ZZ", "q"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for _ in range(120)]
    rows += [(None, "en", "none"), ("", "de", "a"), ("", "de", "b"), ("12 34", "de", "c"), ("solo", "it", "a"), ("w " * 20000 + "rare", "en", "a"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = collections.Counter(map(tuple, divergence.source_divergence(frame, min_docs=8, top=4).collect()))
    want = brute_divergence(rows, 8, 4)
    assert got == want
    assert any(r[0] == "de" and r[2] == "pair" and r[4] == 0 for r in want)
    assert divergence.source_divergence(frame.limit(0)).count() == 0


def test_divergence_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang", "source").collect()]
    got = queries.op13_divergence(spark, SMALL)
    assert collections.Counter(map(tuple, got.collect())) == brute_divergence(rows, 30)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_hard_negatives_on_the_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = collections.Counter(map(tuple, queries.op11_hard_negatives(spark, SMALL).collect()))
    assert got == brute_negatives(rows, 100, 5, 5)
