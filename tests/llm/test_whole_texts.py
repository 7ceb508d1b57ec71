"""Licences against every window of every text, and very long texts for the operators that read whole texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from skarn.llm import license_scan as ls
from skarn.llm import line_dedup, quality, queries, toxicity

from ..conftest import SMALL


def every_window(model, paragraph):
    """Families of a paragraph: each template at each start, without cues, steps or caches."""
    words, places = ls.words_of(paragraph), set()
    for family, templates in ls._template_words().items():
        for needle in templates:
            least = ls.CONFIRM * len(needle)
            size = len(needle) + ls.SLACK
            inside = [w in set(needle) for w in words]
            for lo in range(max(1, len(words) - size + 1)):
                if sum(inside[lo : lo + size]) < least:
                    continue
                found = ls._in_window(needle, words[lo : lo + size])
                if found >= least:
                    a, b = ls._trimmed(needle, words, lo, min(len(words), lo + size), found)
                    p = model.probabilities([words[a:b]])[0]
                    k = int(p[:-1].argmax())
                    if ls.FAMILIES[k] == family and p[k] >= model.threshold:
                        places.add((-found / len(needle), -found, family, a, b))
    taken = []
    for _, _, family, lo, hi in sorted(places):
        if all(f == family or hi <= x or y <= lo for f, x, y in taken):
            taken.append((family, lo, hi))
    return {f for f, _, _ in taken}


def test_licences_equal_every_window(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = ls.fit_on_corpus(docs)
    want, known = {}, {}
    for r in docs.collect():
        blocks = re.split(ls.BLANK, r.text or "")
        found = [known[b] if b in known else known.setdefault(b, every_window(model, b)) for b in blocks]
        want[r.doc_id] = ",".join(sorted(set().union(*found))), sum(map(bool, found))
    got = {r.doc_id: (r.families, r.n_license_paragraphs) for r in queries.op3_license_scan(spark, SMALL).collect()}
    assert got == want
    assert sum(bool(f) for f, _ in want.values()) >= 1


@pytest.fixture(scope="module")
def long_texts(spark):
    """Half a million words and more: with a licence at the end, in one line, and in very many lines."""
    said = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("text").limit(40).collect()
    base = " ".join(r.text for r in said if r.text)
    text = base * max(1, 3_000_000 // len(base))
    rows = [(1, text + "\n\nReleased under the MIT License."), (2, text), (3, "\n".join(["a line that many documents share, of forty code points", "x"] * 60_000)), (4, base)]
    rows += [(k, "a line that many documents share, of forty code points") for k in range(10, 16)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_licence_at_the_end_of_a_long_text(spark, long_texts):
    model = ls.fit_on_corpus(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    got = {r.doc_id: r.families for r in ls.document_licenses(long_texts, ls.scan_licenses(long_texts, model)).collect()}
    assert "mit" in got[1].lower() and (not got[2] or "mit" not in got[2].lower() or "mit" in got[4].lower())


def test_scores_of_long_texts(spark, long_texts):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    for module, modulus, held in ((toxicity, 5, 0), (quality, 3, 1)):
        model = module.fit_on_sample(docs, labels, modulus=modulus, held=held)
        got = {r.doc_id: r.score for r in module.score_documents(long_texts, model, "score").collect()}
        assert set(got) == {1, 2, 3, 4, *range(10, 16)} and all(0 <= s <= 1 for s in got.values())


def test_lines_of_long_texts(spark, long_texts):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in line_dedup.dedup_lines(long_texts).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).collect()}
    assert got[3] == (120_000, 60_000, hashlib.sha256("\n".join(["x"] * 60_000).encode()).hexdigest())
    assert got[15][1] == 0 and got[10][1] == 1
