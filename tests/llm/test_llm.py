"""The training-data operators on small fixtures: brute force, round trips and odd rows."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skarn.llm import ann, bpe, chat, license_scan, line_dedup, minhash, packing, quality, queries, topk, toxicity
from skarn.llm.components import connected_components

from ..conftest import SMALL

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "a  b", "a \n b", "x\n y", " lead", "trail ", "a\n\n b\n", "é ü\t q", "日本語 😀", "don't 12 x1 a_b <|endoftext|>", "ab" * 3000, "w " * 4000]
DOCS = "doc_id long, text string, lang string, score double, n_lines int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, very long texts, and columns named as the operators' own."""
    rows = [(i, t, "en", 9.0, 7) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "x", None, None, None), (None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# 7


def test_bpe_equals_the_library(spark, odd, nothing):
    ranks = bpe.parse_ranks(open(RANKS, "rb").read())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.encode_digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    ids = {tuple(r.ids) for r in bpe.encode_ids(odd, RANKS, public_tokenizers.PATTERN).collect()}
    assert ids == {tuple(own.encode_ordinary(r.text or "")) for r in odd.collect()}


def test_bpe_native_fold(spark):
    ranks = {bytes([b]): b for b in range(97, 123)} | {b"ab": 200, b"abc": 201, b"bc": 199, b"cd": 202}
    words = ["abcd", "aabcbc", "z", "cdab"]
    frame = spark.createDataFrame([([bytearray(w.encode()) for w in words],)], "w array<binary>")
    got = frame.select(bpe.merge_words_native(F.col("w"), ranks)).first()[0]
    assert got == [bpe.fold_merges(w.encode(), ranks) for w in words]


# 5


def check_packing(rows, texts, capacity):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    want = collections.Counter()
    for doc_id, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r.length for r in rows)


def test_packing(spark, odd, nothing):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check_packing(packing.pack_documents(odd, JSON).collect(), texts, 1024)
    assert packing.pack_documents(nothing, JSON).count() == 0


def test_packing_is_near_the_bound(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, total = check_packing(packing.pack_documents(docs, JSON).collect(), [(r.doc_id, r.text) for r in docs.collect()], 1024)
    assert n <= -(-total // 1024) * 1.02 + 1


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= x]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [20, 64, 10, 64, 33][seed], 400).tolist()
    plan = packing.plan_best_fit(dict(collections.Counter(lengths)), 64)
    assert max(first + 0 for _, _, first, _, _ in plan) < best_fit_decreasing(lengths, 64)
    used = set()
    ends = collections.defaultdict(list)
    for length, rank, first, per, offset in plan:
        ends[length].append((rank, first, per, offset))
    for length, n in collections.Counter(lengths).items():
        for r in range(n):
            rank, first, per, offset = [x for x in ends[length] if x[0] <= r][-1]
            used.add(first + (r - rank) // per)
    assert len(used) == best_fit_decreasing(lengths, 64)


@pytest.mark.parametrize("seed", range(2))
def test_supersteps_pack_nearly_as_well(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [64, 40][seed], 300).tolist()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "doc_id long, length long")
    got, steps = packing.best_fit_supersteps(rows, 64)
    got = got.collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    inside = collections.defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(inside) <= 1.03 * best_fit_decreasing(lengths, 64) + 1 and steps < 40


# 6


def brute_lines(rows, least=40, docs=5):
    strip = "\t\n\x0b\x0c\r "
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(strip))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and (-(2**63) if i is None else i) != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out, key=str)


def test_line_dedup(spark, nothing):
    common, mixed = "É" + "Common line that many documents share, of over forty.", "short but common"
    rows = [(i, f"{'  ' if i % 2 else ''}{common.upper() if i % 3 == 0 else common}\r\nown line {i}\n{mixed}\n{common}") for i in range(8)]
    rows += [(20, "A" * 39), (21, "\n".join(["z" * 50] * 130)), (22, None), (23, ""), (None, common), (None, None)]
    rows += [(30 + i, "a" * 39 + " \n" + "b" * 40) for i in range(5)] + [(3, rows[3][1])]
    frame = spark.createDataFrame([(*r, "en", 1.0, 3) for r in rows], DOCS)
    out = line_dedup.dedup_lines(frame)
    assert set(out.columns) == {*frame.columns, "n_dropped"}
    got = [(r.doc_id, r.n_lines, r.n_dropped, sha(r.text.encode())) for r in out.collect()]
    assert sorted(got, key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(nothing).count() == 0


# 9


def test_near_duplicates_equal_brute_force(spark, nothing):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(800)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(vocab, rng.integers(60, 200)))
        for _ in range(rng.integers(1, 6)):
            copy = list(base)
            for k in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[k] = str(rng.choice(vocab))
            texts.append(" ".join(copy))
    texts += ["", None, "a b", "A  b", "solo words only here now"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (None, "alone without an id at all ok")]
    frame = spark.createDataFrame([(*r, "en", 1.0, 3) for r in rows], DOCS)
    got = minhash.near_duplicates(frame).collect()
    shingler = minhash.Shingler()
    clean = [t or "" for _, t in rows]
    owner, items, weights = shingler.shingles(clean)
    sets = [(items[owner == k], weights[owner == k]) for k in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            near = len(sets[i][0]) and len(sets[j][0]) and minhash.similarity(sets[i], sets[j]) >= 0.8
            if clean[i] == clean[j] or near:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    groups = collections.defaultdict(list)
    for (i, _), x in zip(rows, label, strict=True):
        groups[x].append(i)
    least = {x: min((i for i in g if i is not None), default=None) for x, g in groups.items()}
    want = collections.Counter((i, least[x]) for (i, _), x in zip(rows, label, strict=True))
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == want
    kept = minhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and kept.count() == len(groups)
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_star(spark):
    """Edits near one text and far from one another: neither end of most links is a pivot."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base)]
    for i in range(400):
        words = list(base)
        for slot in rng.choice(50, 7, replace=False):
            words[8 * slot + 3] = f"e{i}x{slot}"
        texts.append(" ".join(words))
    shingler = minhash.Shingler()
    sets = [shingler.shingles([t])[1:] for t in texts]
    assert min(minhash.similarity(sets[0], s) for s in sets[1:]) >= 0.8
    assert np.mean([minhash.similarity(sets[i], sets[i + 1]) >= 0.8 for i in range(1, 400)]) < 0.05
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.class_id for r in minhash.near_duplicates(frame).collect()} == {0}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(500 + i, 501 + i) for i in range(30)] + [(900, 901), (900, 901)]
    label = {x: x for e in edges for x in e}
    for a, b in edges * 40:
        label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: label[x] for e in edges if e[0] != e[1] for x in e}


# 1 and 2


def test_toxicity(spark, odd, nothing):
    rng = np.random.default_rng(0)
    vocab = ["".join(rng.choice(list("aeioubdklmnprst"), rng.integers(3, 9))) for _ in range(400)]
    insults = ["grobnik", "wazzock", "blorfed"]

    def text(bad):
        words = list(rng.choice(vocab, 60))
        if bad:
            for k in rng.integers(0, 60, 3):
                words[k] = str(rng.choice(insults))
        return " ".join(words[:30]) + ". " + " ".join(words[30:])

    y = np.array([k % 4 == 0 for k in range(400)], int)
    model = toxicity.fit([text(v) for v in y], y)
    scorer = toxicity.Scorer(model)
    clean, bad = scorer.score([text(0) for _ in range(100)]), scorer.score([text(1) for _ in range(100)])
    assert (clean < 0.5).mean() > 0.97 and (bad >= 0.5).mean() > 0.97
    gapped = [text(0) + f" you {w} there" for w in ("g-r-o-b-n-i-k", "g r o b n i k", "wazxzock", "waz.zock", "bloorfed")]
    assert (scorer.score(gapped) >= 0.5).all()
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(nothing, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = toxicity.fit_on_sample(odd, labels, 5, 0)
    assert toxicity.score_documents(odd, empty).where("score is null").count() == 0


def test_toxicity_sample_survives_a_very_long_document():
    rows = [(0, "a bad sentence. " * 5_000, 1), *((i, f"text {i} " * 10, i % 2) for i in range(1, 200))]
    found = toxicity.within_chars(pd.DataFrame(rows, columns=["doc_id", "text", "y"]), 40_000)
    assert set(found["doc_id"]) == set(range(200))
    sizes = found["text"].str.len()
    assert sizes.max() <= 2_000 and sizes.groupby(found["y"]).sum().max() <= 20_000
    few = toxicity.within_chars(pd.DataFrame(rows, columns=["doc_id", "text", "y"]), 4_000)
    assert few["doc_id"].max() > 150 and len(few) > 20  # not a prefix by id


def test_kernel_is_a_cosine_of_subsequences():
    k, d = toxicity.Kernel(), toxicity
    words = ["^idiot$", "^idxiot$", "^banana$"]
    row, feat, value = k.features(words)
    dense = np.zeros((3, d.BUCKETS), np.float32)
    dense[row, feat] = value

    def brute(a, b):
        import itertools

        def phi(w):
            out = collections.Counter()
            for c in itertools.combinations(range(len(w)), d.P):
                if c[-1] - c[0] < d.SPAN:
                    out["".join(w[i] for i in c)] += d.DECAY ** (c[-1] - c[0] + 1)
            return out

        x, y = phi(a), phi(b)
        norm = lambda z: sum(v * v for v in z.values()) ** 0.5
        return sum(v * y[s] for s, v in x.items()) / (norm(x) * norm(y)) ** d.SCALED

    for i in range(3):
        for j in range(3):
            assert abs(dense[i] @ dense[j] - brute(words[i], words[j])) < 1e-4


def test_quality(spark, odd, nothing):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["river", "stone", "walks", "over", "the", "hill", "and"], 80)) + "." for _ in range(200)]
    bad = ["BUY!! NOW!! " * 30 if k % 2 else "word " * 90 for k in range(100)]
    rows = quality.Statistics().rows(good + bad)
    y = np.r_[np.ones(200), np.zeros(100)]
    forest = quality.fit(rows, y)
    assert ((forest.score(rows) >= 0.5) == y).all()
    walked = forest.start + np.zeros(len(rows))
    for t in range(quality.TREES):  # node by node
        for i, x in enumerate(rows[:5]):
            k = 0
            while k < 2**quality.DEPTH - 1:
                k = 2 * k + 1 + int(x[forest.feature[t, k]] > forest.threshold[t, k])
            walked[i] += forest.value[t, k - (2**quality.DEPTH - 1)]
    assert np.allclose(walked[:5], forest.margins(rows[:5]))
    got = quality.score_documents(odd, forest).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(nothing, forest).count() == 0


@pytest.mark.parametrize("name,label", [("op1_toxicity", "toxic"), ("op2_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    folder = SMALL.replace("0.001", "0.01")
    scores = {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}
    held = [(scores[r.doc_id].predicted, r[label]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if scores[r.doc_id].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.93


# 3


def test_licenses(spark, odd, nothing):
    model = license_scan.train([["the", "cat", "sat", "here"], ["some", "plain", "words"]] * 50)
    rows = [(1, "intro\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, "The license plate was red."), (4, "Permission slips are due."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.document_licenses(docs, license_scan.scan_licenses(docs, model)).collect()
    assert {r.doc_id: r.families for r in found} == {1: "mit", 2: "cc-by-nc", 3: "", 4: "", 5: ""}
    assert license_scan.scan_licenses(nothing, model).count() == 0
    assert license_scan.scan_licenses(odd, model).count() == 0


WRAPPED_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction."""


def test_licenses_in_wrapped_and_long_paragraphs(spark):
    model = license_scan.train([["the", "cat", "sat", "here"], ["some", "plain", "words"]] * 50)
    filler = " ".join(f"plain{i}" for i in range(1, 14)).replace("plain", "some words ")
    gpl = license_scan.TEMPLATES["gpl"][1]
    rows = [
        (1, "Title\n\n" + WRAPPED_MIT + "\n\nend"),
        (2, "word " * 13 + gpl),
        (3, filler + " Released under the MIT License. " + filler + " Licensed under CC BY-SA 4.0. " + filler),
        (4, "This work is under a Creative Commons Attribution 4.0 International License"),
        (5, "some words " * 200),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.families for r in license_scan.document_licenses(docs, license_scan.scan_licenses(docs, model)).collect()}
    assert found == {1: "mit", 2: "gpl", 3: "cc-by-sa,mit", 4: "cc-by", 5: ""}


def test_license_windows_and_cues():
    for templates in license_scan._template_words().values():
        for needle in templates:
            for before in range(0, 50):
                assert license_scan.in_order(needle, ["x"] * before + needle) == 1
            lacking = len(needle) - int(np.ceil(0.8 * len(needle) - 1e-9))
            kept = [w for w in needle if not re.search(license_scan.CUES, w)]
            assert len(needle) - len(kept) > lacking


# 4


def test_chat_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "\\<|im_end|>\\\n", "a\\b<|image|>", "x" * 50_000, "<<SYS>> [INST][INST] \\\\", "é😀"]
    rows = [(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(texts)] + [(2, 0, None, "hi"), (2, None, "system\n\\x", "first"), (None, 0, "user", "q"), (1, 0, "user", "")]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode())
        learnt = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), sha(learnt.encode()))
    for t in texts:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and not any(c in chat.escape(t or "") for c in ("</s>", "[INST]", "<|im_end|>"))
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_chat_parts(spark):
    kinds = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "s3://i", 56, 29, None, None), ("audio", None, "s3://a", None, None, 2.0, None), ("document", None, "s3://d", None, None, None, 3)]
    frame = spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id long, turn long, role string, text string, parts {kinds}")
    row = chat.format_conversations(frame).first()
    assert row.segment == "<|im_start|>user\nsee <|image|><|audio|><|document|><|im_end|>\n"
    assert [(x.kind, x.reference, x.tokens) for x in row.attachments] == [("image", "s3://i", 4), ("audio", "s3://a", 50), ("document", "s3://d", 768)]
    assert all(row.segment[x.at :].startswith(f"<|{x.kind}|>") for x in row.attachments)


# 8 and 10


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # copies: ties go to smaller ids
    odd = [(400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, [0.0] * 8), (None, rows[9][1]), (50, rows[50][1])]
    return spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, rank int, score int")


def brute_search(rows, every, k, scale, zeros):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and (zeros or any(v))]
    mat = np.array([v for _, v in ok])
    mat = np.floor(mat * scale) if scale else mat
    out = []
    for a, (q, _) in enumerate(ok):
        if q is not None and q % every == 0:
            s = (mat * mat[a]).sum(1)
            best = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-s[b], ok[b][0] is None, ok[b][0] or 0))[:k]
            out += [(q, r, ok[b][0], s[b]) for r, b in enumerate(best, 1)]
    return out


def test_exact_top_k(vectors):
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors).collect()]
    want = [(*r[:3], int(r[3])) for r in brute_search([(r.vec_id, r.embedding) for r in vectors.collect()], 50, 5, 256, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_no_random_access_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(3000, 16)) * np.linspace(3, 0.1, 16))
    own = np.array([5, -1])
    for i, rows, scores in topk.no_random_access(x, 5)(x[[5, 9]], own):
        s = x @ x[[5, 9][i]]
        if own[i] >= 0:
            s[own[i]] = -np.inf
        assert scores.tolist() == sorted(s, reverse=True)[:5] and s[rows].tolist() == scores.tolist()
    big = np.floor(np.array([[1e9, 3.0], [2e9, -1.0], [1e9, 5.0]]))
    assert [s.tolist() for _, _, s in topk.no_random_access(big, 2)(big[:1], np.array([0]))][0] == [2 * 10**18 - 3, 10**18 + 15]


def test_nearest(spark, vectors):
    got = ann.nearest(vectors).collect()
    want = brute_search([(r.vec_id, r.embedding) for r in vectors.collect()], 20, 20, None, False)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(r[0], r[2]) for r in want}) >= 0.9 * len({(r[0], r[2]) for r in want})
    exact = {(r[0], r[2]): r[3] for r in want}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_quantised_scan_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = ann.fit(ann.padded(x[:2000]))
    assert ann.encode(ann.padded(x[:10]), books).max() < 16
    own, hit = np.arange(40), 0
    for i, rows, _ in ann.index_block(x, books, 20, 160)(x[:40], own):
        s = x @ x[i]
        s[i] = -9
        hit += len(set(np.argsort(-s)[:20]) & set(rows.tolist()))
    assert hit / 800 >= 0.9


@pytest.mark.parametrize("noise", [0.0, 0.01, 0.1])
def test_nearest_among_near_copies(noise):
    """A third of the block lies around one centre, so that its codes coincide."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[::3] = rng.normal(size=64) + noise * rng.normal(size=(1000, 64))
    books = ann.fit(ann.padded(x[:2000]))
    asks = np.arange(0, 120)
    for i, rows, scores in ann.index_block(x, books, 20, 160)(x[asks], asks):
        exact = (x * x[i]).sum(1)
        exact[i] = -np.inf
        assert list(rows) == list(topk.best_rows(exact, 20)) and np.array_equal(scores, exact[rows])


def test_queries_have_all_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert base64.b64encode(b"x") == b"eA=="


def near_classes(rows):
    """The least id of each class of equal or similar texts, by all pairs of (id, text)."""
    shingler = minhash.Shingler()
    texts = sorted({t or "" for _, t in rows})
    owner, items, weights = shingler.shingles(texts)
    sets = [(items[owner == k], weights[owner == k]) for k in range(len(texts))]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i][0]) and len(sets[j][0]) and minhash.similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    ids = collections.defaultdict(list)
    place = {t: k for k, t in enumerate(texts)}
    for i, t in rows:
        ids[label[place[t or ""]]].append(i)
    return [min((i for i in group if i is not None), default=None) for group in ids.values()]


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on its predecessor's rows, with columns named as the operators' own, nulls, repeats and ties."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    own = {"score": F.lit(7.0), "n_lines": F.lit(3), "_id": F.lit("mine"), "kept_key": F.lit("too"), "keep": F.lit(True)}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns(own)
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.lit(None).cast("string")}))
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).repartition(3).cache()
    stages = dict(corpus_pipeline.STAGES)

    def kept(rows):
        assert rows.columns == docs.columns
        assert rows.where("score <> 7 or n_lines <> 3 or _id <> 'mine' or kept_key <> 'too' or not keep").count() == 0
        return rows.cache(), collections.Counter((r.doc_id, r.text) for r in rows.collect())

    texts = [(r.doc_id, r.text) for r in docs.collect()]
    forest = quality.fit_on_sample(docs, labels, modulus=3, held=1)
    scores = forest.score(quality.Statistics().rows([t or "" for _, t in texts]))
    good, got = kept(stages["quality"](spark, docs, SMALL))
    assert got == collections.Counter(x for x, y in zip(texts, scores, strict=True) if y >= 0.5)

    texts = [(r.doc_id, r.text) for r in good.collect()]
    scores = toxicity.Scorer(toxicity.fit_on_sample(good, labels, modulus=5, held=0)).score([t or "" for _, t in texts])
    civil, got = kept(stages["toxicity"](spark, good, SMALL))
    assert got == collections.Counter(x for x, y in zip(texts, scores, strict=True) if y < 0.5)

    lines, got = kept(stages["line_dedup"](spark, civil, SMALL))
    want = collections.Counter((i, digest) for i, _, _, digest in brute_lines([(r.doc_id, r.text) for r in civil.collect()]))
    assert collections.Counter((i, sha(t.encode())) for (i, t), n in got.items() for _ in range(n)) == want
    assert lines.where("n_chars <> char_length(text)").count() == 0

    copies, got = kept(stages["near_duplicates"](spark, lines, SMALL))
    assert collections.Counter(i for i, _ in got.elements()) == collections.Counter(near_classes([(r.doc_id, r.text) for r in lines.collect()]))

    rows = [(r.doc_id, r.text) for r in copies.collect()]
    check_packing(stages["packing"](spark, copies, SMALL).collect(), rows, 1024)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_classes_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    one = {(r.doc_id, r.class_id) for r in minhash.near_duplicates(docs.coalesce(1)).collect()}
    assert one == {(r.doc_id, r.class_id) for r in minhash.near_duplicates(docs.repartition(7, F.rand(3))).collect()}


def test_vectors_of_other_sizes(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 0.5]), (100, [1.0, 2.0, 3.0]), (7, [3.0, 1.0, 1.0]), (150, []), (8, []), (200, [0.25])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(vectors).collect()}
    # Vectors meet those of as many components; those of none have an inner product of nothing.
    assert got == {(0, 50): 256 * 256 + 512 * 128, (50, 0): 256 * 256 + 512 * 128, (100, 7): 256 * 768 + 512 * 256 + 768 * 256, (150, 8): 0}
    found = {(r.query_id, r.vec_id): r.score for r in ann.nearest(vectors).collect()}
    assert found == {(0, 50): 2.0, (100, 7): 8.0}


def test_chat_with_other_parts(spark):
    said = "SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, 'hi' AS text"
    plain = chat.read_back(chat.format_conversations(spark.sql(said))).collect()
    for other in ("'x' AS parts", "array(1, 2) AS parts", "array(named_struct('kind', 1)) AS parts"):
        assert chat.read_back(chat.format_conversations(spark.sql(f"{said}, {other}"))).collect() == plain


def test_near_duplicates_of_very_long_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.integers(0, 5000, 200_000)]
    edited = list(words)
    edited[::20_000] = ["other"] * 10
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1])), (4, "w " * 400_000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL.replace("0.001", "0.01"))
    assert rows.count() == rows.select("doc_id", "piece").distinct().count() > 500
