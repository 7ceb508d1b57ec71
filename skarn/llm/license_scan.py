"""Licence families of documents from a trained paragraph classifier and template comparison.

Method: paragraphs (blocks between blank lines; single newlines only wrap) become sparse hashed
word 1- to 3-grams.  A multinomial logistic regression is trained on sentences of the licence templates below, with words dropped, repeated
and put in, against paragraphs of the corpus that share no licence vocabulary.  The unknown class
is calibrated: a paragraph whose best family has less than a threshold probability, set on held
out training paragraphs, is unknown.  A predicted family counts only if comparison with its
templates confirms it: enough of one template sentence's words must be in the paragraph, in order.
Every window of a paragraph that a template confirms is classified by itself, so neither the length
of a paragraph nor another licence in it hides one; a paragraph may have several families.

Only paragraphs with a word of the licence vocabulary are compared; the vocabulary holds more words
of each template than a confirmed paragraph may lack, so none that could be confirmed is passed over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scoring import least_hashes

#: Notices by which licence families are known, one sentence a string.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL version 2 or later.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "This work is marked with CC0 1.0 Universal."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
}

FAMILIES = [*sorted(TEMPLATES), "unknown"]
BUCKETS, NOISY, NEGATIVES, ROUNDS, RATE, DECAY = 1 << 14, 40, 3_000, 60, 2.0, 1e-4
CONFIRM = 0.8
WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*")
SLACK, WINDOW = 6, 60
#: What ends a paragraph: a line of white space alone.
BLANK = r"\n[ \t\r\f\x0B]*\n\s*"


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def _cues() -> str:
    """A pattern of words, tested in the JVM first, that every confirmable paragraph has at least one of.

    Of each template it has the longest words, one more than a share of 1 - CONFIRM can leave out.
    """
    cues: set[str] = set()
    for template in (t for ts in TEMPLATES.values() for t in ts):
        words = words_of(template)
        short = len(words) - int(np.ceil(CONFIRM * len(words) - 1e-9)) + 1
        ranked = sorted((w for w in words if w[0].isalpha()), key=lambda w: (w not in cues, -len(w), w))
        cues.update(ranked[:short])
    return "(?<![a-z])(?:" + "|".join(sorted(cues)) + ")(?![a-z])"


CUES = _cues()


def grams(words: list[str]) -> np.ndarray:
    """Distinct hashed 1-, 2- and 3-grams."""
    found = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return np.fromiter((zlib.crc32(g.encode()) % BUCKETS for g in found), np.int64, len(found))


@dataclass
class Model:
    weights: np.ndarray
    threshold: float

    def probabilities(self, paragraphs: list[list[str]]) -> np.ndarray:
        rows = [grams(w) for w in paragraphs]
        z = np.stack([self.weights[r].sum(0) / np.sqrt(max(1, len(r))) for r in rows]) if rows else np.zeros((0, len(FAMILIES)))
        e = np.exp(z - z.max(1, keepdims=True)) if rows else z
        return e / e.sum(1, keepdims=True) if rows else z


def train(negatives: list[list[str]], seed: int = 5) -> Model:
    """Fit on noisy copies of the templates and on paragraphs without licences, and calibrate."""
    rng = np.random.default_rng(seed)
    filler = [w for ws in negatives for w in ws[:20]] or ["the", "of", "and", "to", "in"]
    x, y = [], []
    for k, family in enumerate(FAMILIES[:-1]):
        for template in TEMPLATES[family]:
            words = words_of(template)
            for t in range(NOISY):
                noisy = list(words)
                if t:
                    noisy = [w for w in noisy if rng.random() > 0.08] or list(words)
                    at = rng.integers(0, len(noisy) + 1)
                    extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 8))]
                    noisy[at:at] = extra
                x.append(grams(noisy))
                y.append(k)
    for ws in negatives:
        x.append(grams(ws))
        y.append(len(FAMILIES) - 1)
    licence_words = sorted({w for s in TEMPLATES.values() for t in s for w in words_of(t)})
    for _ in range(NEGATIVES // 4):  # licence words out of order, among others, are no licence
        mixed = [licence_words[i] for i in rng.integers(0, len(licence_words), 4)] + [filler[i] for i in rng.integers(0, len(filler), 8)]
        x.append(grams([mixed[i] for i in rng.permutation(len(mixed))]))
        y.append(len(FAMILIES) - 1)
    order = rng.permutation(len(x))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    y_all = np.array(y)
    weights = np.zeros((BUCKETS, len(FAMILIES)))
    sizes = np.array([len(r) for r in x])

    def margins(rows: np.ndarray) -> np.ndarray:
        flat = np.concatenate([x[i] for i in rows]) if len(rows) else np.zeros(0, np.int64)
        start = np.cumsum(sizes[rows]) - sizes[rows]
        full = sizes[rows] > 0
        z = np.zeros((len(rows), len(FAMILIES)))
        z[full] = np.add.reduceat(weights[flat], start[full])
        return z / np.sqrt(np.maximum(sizes[rows], 1))[:, None]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    balance = 1 / np.bincount(y_all, minlength=len(FAMILIES))[y_all]
    balance /= balance[used].mean()
    for epoch in range(ROUNDS):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            p = softmax(margins(part))
            p[np.arange(len(part)), y_all[part]] -= 1
            p *= (balance[part] / np.sqrt(np.maximum(sizes[part], 1)) / len(part))[:, None]
            step = RATE / (1 + epoch / 10)
            np.subtract.at(weights, np.concatenate([x[i] for i in part]), np.repeat(p * step * 16, sizes[part], 0))
        weights *= 1 - DECAY
    p = softmax(margins(held))
    unknown = p[y_all[held] == len(FAMILIES) - 1, :-1].max(1, initial=0)
    threshold = float(np.clip(np.quantile(unknown, 0.995) if len(unknown) else 0.5, 0.3, 0.9))
    return Model(weights, threshold)


@lru_cache(maxsize=1)
def _template_words() -> dict[str, list[list[str]]]:
    return {k: [words_of(t) for t in v] for k, v in TEMPLATES.items()}


def _in_window(needle: list[str], words: list[str]) -> int:
    """The number of a template's words found in order."""
    longest = [0] * (len(needle) + 1)
    for w in words:
        last = 0
        for j, n in enumerate(needle, 1):
            last, longest[j] = longest[j], max(longest[j], longest[j - 1], last + 1 if w == n else 0)
    return longest[-1]


def windows(needle: list[str], words: list[str], least: float) -> Iterator[tuple[int, int, int]]:
    """(from, to, words in order) of windows near a template's length with at least a share of its words.

    They start every SLACK words and end at the paragraph's end, so a verbatim sentence at any
    place is whole in one of them.
    """
    known = set(needle)
    counts = np.cumsum([0, *(w in known for w in words)])
    size, last = len(needle) + SLACK, max(0, len(words) - len(needle) - SLACK)
    for lo in sorted({*range(0, last + 1, SLACK), last}):
        hi = min(len(words), lo + size)
        if counts[hi] - counts[lo] >= least * len(needle):
            found = _in_window(needle, words[lo:hi])
            if found >= least * len(needle):
                yield lo, hi, found


def in_order(needle: list[str], words: list[str]) -> float:
    """The share of a template's words found in order in a window of the paragraph near its length."""
    return max((n for *_, n in windows(needle, words, 0.0)), default=0) / len(needle)


def confirm(family: str, words: list[str]) -> float:
    """The best agreement of a paragraph with the family's templates."""
    return max((in_order(t, words) for t in _template_words()[family]), default=0.0)


def _trimmed(needle: list[str], words: list[str], lo: int, hi: int, found: int) -> tuple[int, int]:
    """A window without the words at its ends that the comparison does not need."""
    while hi - lo > 1 and _in_window(needle, words[lo + 1 : hi]) == found:
        lo += 1
    while hi - lo > 1 and _in_window(needle, words[lo : hi - 1]) == found:
        hi -= 1
    return lo, hi


def families_of(model: Model, paragraph: str) -> list[tuple[str, float, float]]:
    """(family, probability, agreement) of each family that is both confirmed and predicted in some place.

    Where places of two families overlap, that of better agreement counts, then the longer one.
    """
    words = words_of(paragraph)
    there, seen, places = set(words), {}, set()
    for family, templates in _template_words().items():
        for needle in templates:
            if sum(w in there for w in needle) < CONFIRM * len(needle):
                continue
            for a, b, found in windows(needle, words, CONFIRM):
                lo, hi = _trimmed(needle, words, a, b, found)
                span = tuple(words[lo:hi])
                if span not in seen:
                    seen[span] = model.probabilities([list(span)])[0]
                p = seen[span]
                k = int(p[:-1].argmax())
                if FAMILIES[k] == family and p[k] >= model.threshold:
                    places.add((-found / len(needle), -found, family, lo, hi, float(p[k])))
    best, taken = {}, []
    for agreed, _, family, lo, hi, p in sorted(places):
        if all(f == family or hi <= x or y <= lo for f, x, y in taken):
            taken.append((family, lo, hi))
            best.setdefault(family, (family, p, -agreed))
    return [best[f] for f in sorted(best)]


def fit_on_corpus(docs: DataFrame, negatives: int = NEGATIVES, words: int = WINDOW) -> Model:
    """Train with windows without licence cues of at most `negatives` documents, of least hash of id.

    Each gives one window of at most `words` words, whose paragraph and place its id's hash picks.
    These bound the fit alone.  The hash comes before the text, so that only sampled texts are split.
    """
    parts = F.filter(F.split(F.col("text").cast("string"), BLANK, -1), lambda x: F.btrim(x) != "")
    pick = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), n).cast("int")
    inside = F.split(F.get(parts, pick(1, F.greatest(F.size(parts), F.lit(1)))), r"\s+")
    window = F.slice(inside, pick(2, F.greatest(F.size(inside) - words, F.lit(0)) + 1) + 1, F.lit(words))
    lines = docs.where(F.length("text") > 0).select("doc_id", F.array_join(window, " ").alias("line"))
    found = least_hashes(lines, "doc_id", negatives, docs.count()).where(~F.lower("line").rlike(CUES))
    return train([words_of(r["line"]) for r in found.collect()])


def scan_licenses(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph, family, probability, agreement): each family found in a paragraph.

    `paragraph` counts blocks between blank lines from 0; whole texts are read, and only paragraphs
    with a cue leave the JVM.  Null texts have none.  A document has a row for each family of each
    of its licence paragraphs; repeated rows and ids, null ones too, each have their own.  Other
    columns of `docs` play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lines = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), BLANK, -1)).alias("paragraph", "line"))
        .where(F.lower("line").rlike(CUES))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[tuple[str, float, float]]] = {}
        for batch in batches:
            rows = []
            for i, k, line in zip(batch["doc_id"], batch["paragraph"], batch["line"], strict=True):
                got = known.get(line) if len(line) < 400 else None
                if got is None:
                    got = families_of(sent.value, line)
                    if len(line) < 400 and len(known) < 50_000:
                        known[line] = got
                rows += [(i, k, *family) for family in got]
            out = pd.DataFrame(rows, columns=["doc_id", "paragraph", "family", "probability", "agreement"])
            yield out.astype({"doc_id": "Int64"})

    return lines.mapInPandas(run, "doc_id long, paragraph int, family string, probability double, agreement double")


def document_licenses(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, the sorted families of its paragraphs, and how many paragraphs.

    Rows of one id all get what any of them has; rows of null id get none.
    """
    per = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("family")).alias("families"), F.count_distinct("paragraph").alias("n"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(per, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_license_paragraphs"),
    )
