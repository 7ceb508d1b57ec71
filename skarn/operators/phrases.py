"""Positional search: postings with positions over words or Porter stems, phrases, all words, and three tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import porter
from .search import K1, B
from .traverse import settled

#: What parts words.
SIGNS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SIGNS, -1), lambda x: x != "")


def split_words(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, field, words): each row's fields as arrays, settled, since texts are needed more than once."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("words")) for f in fields]))
    return settled(docs.select("doc_id", each.alias("x")).select("doc_id", "x.*"))


def stems(texts: DataFrame) -> DataFrame:
    """(term, stem) of each distinct word of (words)."""
    return settled(texts.select(F.explode("words").alias("term")).distinct().select("term", porter(F.col("term")).alias("stem")))


def postings(texts: DataFrame, stemmed: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """(doc_id, field, term, at): the positions (from 0, ascending) of a term in a row's field.

    With (term, stem) in `stemmed`, terms are stems.  With `only`, the postings of those terms alone,
    so that all others go before the shuffle.
    """
    each = texts.select("doc_id", "field", F.posexplode("words").alias("at", "term"))
    if stemmed is not None:
        wanted = stemmed if only is None else stemmed.where(F.col("stem").isin(only))
        each = each.join(wanted, "term").select("doc_id", "field", "at", F.col("stem").alias("term"))
    elif only is not None:
        each = each.where(F.col("term").isin(only))
    return each.groupBy("doc_id", "field", "term").agg(F.sort_array(F.collect_list("at")).alias("at"))


def occurrences(index: DataFrame, units: list[list[str]]) -> DataFrame:
    """(doc_id, unit, tf): how often each unit, a word or a phrase of several, stands in a document.

    A phrase starts where its i-th term stands i places later, for every i: positions are shifted by
    their term's place and met on the start; a field's phrase doesn't go on in the next field.
    """
    spark = index.sparkSession
    places = [(u, i, term, len(unit)) for u, unit in enumerate(units) for i, term in enumerate(unit)]
    asked = spark.createDataFrame(places, "unit int, i int, term string, size int")
    starts = index.join(F.broadcast(asked), "term").select("doc_id", "field", "unit", "i", "size", F.explode("at").alias("at"))
    met = starts.groupBy("doc_id", "field", "unit", (F.col("at") - F.col("i")).alias("start"), "size").agg(F.count("*").alias("n")).where("n = size")
    return met.groupBy("doc_id", "unit").agg(F.count("*").alias("tf"))


def bm25_scores(hits: DataFrame, size: DataFrame, n_units: int, k: int, every: bool) -> DataFrame:
    """(doc_id, score): the k best by BM25 of hits (doc_id, unit, tf, length), ties to the smaller id.

    `size` is one row (n, mean) of all documents; with `every`, only documents that have every unit.
    """
    df = hits.groupBy("unit").agg(F.count("*").alias("df"))  # a row a unit of the query
    scored = hits.join(F.broadcast(df), "unit").join(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    sums = scored.groupBy("doc_id").agg(F.round(F.sum(score), 6).alias("score"), F.count("*").alias("units"))
    found = sums.where(F.col("units") == n_units) if every else sums
    return found.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)


def query_units(docs: DataFrame, query: str, stemmed: bool) -> list[list[str]]:
    """A query's units: words, and phrases in double quotes; repeated ones count once."""
    units = []
    for i, part in enumerate(query.split('"')):
        row = docs.sparkSession.range(1).select(F.transform(words(F.lit(part)), porter if stemmed else lambda x: x).alias("w")).first()["w"]
        units += [row] if i % 2 else [[w] for w in row]
    return [u for k, u in enumerate(units) if u and u not in units[:k]]


def search(docs: DataFrame, query: str, k: int, every: bool = True, stemmed: bool = True, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, score): the k best documents for a query of words and "phrases in quotes".

    `every`: documents must have all units (the default, as search engines join words); otherwise
    any.  A null field is empty; a query without words finds nothing; rows that share an id count
    as one document.
    """
    units = query_units(docs, query, stemmed)
    if not units:
        return docs.sparkSession.createDataFrame([], "doc_id long, score double")
    texts = split_words(docs, list(fields))
    terms = sorted({t for u in units for t in u})
    index = postings(texts, stems(texts) if stemmed else None, terms)
    lengths = texts.groupBy("doc_id").agg(F.sum(F.size("words")).alias("length"))
    hits = occurrences(index, units).join(lengths, "doc_id")
    return bm25_scores(hits, lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean")), len(units), k, every)


def by_letters(docs: DataFrame, query: str, k: int, least: int = 3) -> DataFrame:
    """(doc_id, score): the k best documents that hold every word of a query, of `least` letters or more, within words.

    Ranked by BM25, where a word counts as often as it is found and a document is as long as its
    runs of three characters are many.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    asked = sorted({w for u in query_units(docs, query.replace('"', " "), False) for w in u if len(w) >= least})
    if not asked:
        return docs.sparkSession.createDataFrame([], "doc_id long, score double")
    tf = lambda w: ((F.length("low") - F.length(F.replace("low", F.lit(w), F.lit("")))) / len(w)).cast("long")
    per = docs.select("doc_id", low.alias("low")).select(
        "doc_id", F.greatest(F.length("low") - 2, F.lit(0)).cast("long").alias("length"), F.array(*[F.struct(F.lit(u).alias("unit"), tf(w).alias("tf")) for u, w in enumerate(asked)]).alias("hits")
    )
    per = settled(per)
    hits = per.select("doc_id", "length", F.inline("hits")).where("tf > 0")
    return bm25_scores(hits, per.agg(F.count("*").alias("n"), F.avg("length").alias("mean")), len(asked), k, True)


def tiers(docs: DataFrame, query: str, k: int) -> DataFrame:
    """(doc_id, tier, score): tier 1, documents with all of the query's words by their stems; if there are none, tier 2, those with all of them within words."""
    first = settled(search(docs, query.replace('"', " "), k))
    found, tier = (by_letters(docs, query, k), 2) if first.isEmpty() else (first, 1)
    return found.select("doc_id", F.lit(tier).alias("tier"), "score")
