"""Search of memory: ranked by BM25 over several fields, filled up by likeness, and checked for contradictions."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and what contradicts them, and words that name no subject.
OPPOSED = [
    ("always", "never"), ("use", "avoid"), ("enable", "disable"), ("allow", "deny"), ("require", "optional"), ("prefer", "avoid"),
    ("include", "exclude"), ("must", "must not"), ("should", "should not"), ("do", "don't"), ("do", "do not"), ("add", "remove"), ("true", "false"),
    ("yes", "no"),
]
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after",
    "it", "this", "that", "these", "those", "and", "or", "but", "not", "if", "then", "else", "when", "where", "how", "what", "which", "who", "whom",
    "why", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "only", "own", "same", "so", "than", "too", "very",
    "just",
]


def subjects(text: Column) -> Column:
    """The distinct words over two letters of a text that may name a subject."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_.-]*"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2))


def contradictions(notes: DataFrame) -> DataFrame:
    """(id, other): notes (id, text) that share a subject, where one has a signal and the other its opposite.

    Each pair is found from both sides, once.  Candidates meet on an opposition and a subject, not
    all with all.
    """
    lowered = F.lower(F.coalesce("text", F.lit("")))
    signs = F.array_compact(F.array(*[F.when(lowered.contains(word), F.lit(f"{k}{side}")) for k, pair in enumerate(OPPOSED) for side, word in zip("+-", pair, strict=True)]))
    known = notes.select("id", F.explode(signs).alias("sign"), subjects(F.col("text")).alias("words")).select("id", "sign", F.explode("words").alias("word"))
    opposite = F.concat(F.substring("sign", 1, F.length("sign") - 1), F.when(F.col("sign").endswith("+"), "-").otherwise("+"))
    other = known.select(F.col("id").alias("other"), "sign", "word")
    return known.withColumn("sign", opposite).join(other, ["sign", "word"]).where("id <> other").select("id", "other").distinct()


def _is(word: str):
    return lambda x: x == word


def ranked(fields: DataFrame, words: list[str], k: int) -> DataFrame:
    """The k rows (id, text) with all of the words that BM25 ranks best, ties to the smaller id."""
    words = sorted({w.lower() for w in words})
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    per = fields.select("id", tokens.alias("t")).select("id", F.size("t").alias("length"), *[F.size(F.filter("t", _is(w))).alias(f"tf{k_}") for k_, w in enumerate(words)])
    df = [F.count_if(F.col(f"tf{k_}") > 0).alias(f"df{k_}") for k_ in range(len(words))]
    totals = per.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *df)
    score = F.lit(0.0)
    for k_ in range(len(words)):
        tf, n_with = F.col(f"tf{k_}"), F.col(f"df{k_}")
        idf = F.log(1 + (F.col("n") - n_with + 0.5) / (n_with + 0.5))
        score = score + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
    some = per.where(" and ".join(f"tf{k_} > 0" for k_ in range(len(words)))).join(F.broadcast(totals))  # one row of totals
    return some.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def alike(rows: DataFrame, query: str, least: float = 0.6) -> DataFrame:
    """(id, ratio): rows (id, text) by the share of matching blocks (Ratcliff and Obershelp) with a query, at least so much."""
    asked = query.lower()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = difflib.SequenceMatcher(None)
        for batch in batches:
            ratios = []
            for text in batch["text"].fillna(""):
                matcher.set_seqs(asked, text.lower())
                # The cheap bound first.
                ratios.append(matcher.ratio() if matcher.real_quick_ratio() >= least else 0.0)
            out = pd.DataFrame({"id": batch["id"], "ratio": ratios})
            yield out[out["ratio"] >= least]

    return rows.select("id", "text").mapInPandas(run, "id long, ratio double")


def filled(best: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """(id, score, source): the ranked rows, and while they are fewer than k those most alike."""
    extra = more.join(best.select("id"), "id", "left_anti").select("id", F.col("ratio").alias("score"), F.lit(1).alias("source"))
    return best.select("id", "score", F.lit(0).alias("source")).unionAll(extra).orderBy("source", F.desc("score"), "id").limit(k)
