"""Stems, phrases, tiers and what earlier rounds got wrong, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skarn.functions import stems
from skarn.functions.stems import porter
from skarn.operators import changes, phrases, scoring, sequences, traverse

from .conftest import SMALL


def plain_porter(w):
    """Porter's algorithm by letters."""
    if not re.fullmatch("[a-z]{3,64}", w):
        return w

    def forms(s):
        out = ""
        for i, c in enumerate(s):
            out += "c" if c not in "aeiou" and not (c == "y" and i > 0 and out[-1] == "c") else "v"
        return out

    measure = lambda s: len(re.findall("v+c+", forms(s)))
    vowel = lambda s: "v" in forms(s)
    short = lambda s: len(s) > 2 and forms(s)[-3:] == "cvc" and s[-1] not in "wxy"
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = False
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and vowel(w[:-2]):
        w, cut = w[:-2], True
    elif w.endswith("ing") and vowel(w[:-3]):
        w, cut = w[:-3], True
    if cut:
        if w.endswith(("at", "bl", "iz")) or measure(w) == 1 and short(w):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (stems.STEP_2, stems.STEP_3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in stems.STEP_4 if w.endswith(e)), key=len, default=None)
    if end and measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


KNOWN = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic",
    "hopefulness": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "generalizations": "gener", "licensed": "licens", "licenses": "licens", "is": "is", "été": "été", "x1s": "x1s",
}


def test_porter(spark):
    """The vocabulary of the documents, known words, and made-up words with every suffix, as by letters."""
    rng = random.Random(1)
    ends = [*stems.STEP_2, *stems.STEP_3, *stems.STEP_4, "s", "ed", "ing", "y", "e", "sses", "ies", "eed", "ll", "yy"]
    made = {"".join(rng.choices("aeiouybcdstl", k=rng.randint(0, 6))) + rng.choice(ends) + rng.choice(["", "s", "ed", "ing", "e", "ly"]) for _ in range(3000)}
    said = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.explode(phrases.words(F.col("text"))).alias("t"))
    got = said.unionAll(spark.createDataFrame([(w,) for w in [*made, *KNOWN]], "t string")).distinct().select("t", porter(F.col("t")).alias("s")).collect()
    assert len(got) > 10_000
    assert [(r.t, r.s, plain_porter(r.t)) for r in got if r.s != plain_porter(r.t)] == []
    assert {r.t: r.s for r in got if r.t in KNOWN} == KNOWN


DOCS = [
    (1, "Red apple", None), (2, "red car", "apple"), (3, "blue apple", ""), (4, "apple red; red apples! Red apple", "a"), (5, None, None),
    (6, "big red", "apple pie"), (7, "the the the", ""), (8, "", "redapple"), (9, "red\napple\tred-apple", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, title string")


def found(frame):
    return {r.doc_id for r in frame.collect()}


def test_phrases_and_all_words(docs):
    assert found(phrases.search(docs, '"red apple"', 10, stemmed=False)) == {1, 4, 9}
    assert found(phrases.search(docs, "red apple", 10)) == {1, 4, 9}
    assert found(phrases.search(docs, "red apple", 10, every=False)) == {1, 2, 3, 4, 6, 9}
    # A phrase doesn't go on in the next field, and words may come from any field.
    assert found(phrases.search(docs, '"red apple"', 10, fields=("text", "title"))) == {1, 4, 9}
    assert found(phrases.search(docs, "red apple", 10, fields=("text", "title"))) == {1, 2, 4, 6, 9}
    assert found(phrases.search(docs, '"apples red"', 10)) == {4, 9} and found(phrases.search(docs, '"apples big"', 10)) == set()
    for query in ("", " -- ", '""'):
        assert phrases.search(docs, query, 10).count() == 0
    texts = phrases.split_words(docs, ["text"])
    counts = {(r.doc_id, r.unit): r.tf for r in phrases.occurrences(phrases.postings(texts), [["the", "the"], ["red", "apple"], ["red"]]).collect()}
    assert counts == {(7, 0): 2, (1, 1): 1, (4, 1): 1, (9, 1): 2, (1, 2): 1, (2, 2): 1, (4, 2): 3, (6, 2): 1, (9, 2): 2}


def test_postings_hold_positions_of_stems(docs):
    texts = phrases.split_words(docs.where("doc_id = 4"), ["text"])
    got = {r.term: r["at"] for r in phrases.postings(texts, phrases.stems(texts)).collect()}
    assert got == {"appl": [0, 3, 5], "red": [1, 2, 4]}


def test_tiers(docs):
    """Tier 1 is of documents with all words; only where there are none do letters within words count."""
    first = phrases.tiers(docs, "red apples", 10).collect()
    assert {r.tier for r in first} == {1} and {r.doc_id for r in first} == {1, 4, 9}
    second = phrases.tiers(docs, "pple lue", 10).collect()
    assert [(r.doc_id, r.tier) for r in second] == [(3, 2)]
    assert phrases.tiers(docs, "nothing", 10).count() == 0


def test_paragraphs_of_rows_with_one_id(spark):
    rows = spark.createDataFrame([(1, "a\n\nb"), (1, "c\n\nd"), (2, None), (3, "x" * 50 + "\n\n" + "y" * 50 + "\n\nz")], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sequences.chunk_paragraphs(rows, 60).collect()))
    assert got == [(1, 0, "a\n\nb"), (1, 0, "c\n\nd"), (3, 0, "x" * 50), (3, 1, "y" * 50 + "\n\nz")]


def test_immune_types_are_never_low(spark):
    columns = "id long, type string, importance double, access_count int, archived boolean, created_at date"
    rows = [(k, t, 0.01, 0, False, "2023-01-01") for k, t in enumerate(["guardrail", "convention", "warning", "note", None])]
    frame = spark.createDataFrame([(*r[:5],) for r in rows], columns.rsplit(",", 1)[0]).withColumn("created_at", F.lit("2023-01-01").cast("date"))
    got = {r.id: (r.low, r.roi) for r in scoring.roi(frame, "2024-02-01").collect()}
    assert {k: v[0] for k, v in got.items()} == {0: False, 1: False, 2: False, 3: True, 4: True}


def test_slices_of_long_chains(spark):
    n = 30
    rows = spark.createDataFrame([("f", k, f"v{k}", [f"v{k - 1}"]) for k in range(1, n + 1)], "path string, line int, variable string, used array<string>")
    target = spark.createDataFrame([("f", n, f"v{n}")], "path string, line int, variable string")
    assert changes.backward_slice(rows, target, traverse.settled).count() == n


def test_stored_tables_follow_their_files(spark, tmp_path):
    from skarn.plans import adapters

    for name in ("customer", "supplier", "part", "nation", "region", "lineitem", "orders"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(5).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = adapters.nodes(spark, str(tmp_path)).count()
    assert adapters.nodes(spark, str(tmp_path)).count() == before
    spark.read.parquet(f"{SMALL}/customer.parquet").limit(9).write.mode("overwrite").parquet(str(tmp_path / "customer.parquet"))
    assert adapters.nodes(spark, str(tmp_path)).count() == before + 4
