"""Search: an inverted index with BM25, keyword and trigram matches, cosine top-k and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .traverse import settled

K1, B = 1.2, 0.75


def postings(docs: DataFrame, pattern: str = "[a-z0-9]+") -> DataFrame:
    """(doc_id, term, tf, length): term counts by document, and the document's terms in all."""
    terms = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("term"))
    counts = terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return counts.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id")))


def _same(word: str):
    return lambda x: F.when(x == word, x)


def bm25(docs: DataFrame, words: list[str], k: int) -> DataFrame:
    """The k documents of highest BM25 for some words, ties to the smaller doc_id.

    Only the words' postings leave the scan; lengths come from the same pass.
    """
    words = sorted(set(words))
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    per = docs.select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").alias("length"), F.array(*[F.struct(F.lit(w).alias("term"), F.size(F.array_compact(F.transform("t", _same(w)))).alias("tf")) for w in words]).alias("hits")
    )
    per = settled(per)  # texts are split once for sizes, frequencies and hits
    size = per.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = per.select("doc_id", "length", F.inline("hits")).where("tf > 0")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a word of the query
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("doc_id").agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def keyword(nodes: DataFrame, words: list[str], k: int) -> DataFrame:
    """Nodes whose name has every word: 3 for the name itself, 2 for its start, 1 within."""
    name = F.lower("name")
    has = [name.contains(w.lower()) for w in words]
    found = nodes.where(has[0] if len(has) == 1 else F.array_contains(F.array(*has), False) == False)  # noqa: E712
    query = " ".join(words).lower()
    score = F.when(name == query, 3).when(name.startswith(query), 2).otherwise(1)
    return found.select("qualified_name", "name", score.alias("score")).orderBy(F.desc("score"), "qualified_name").limit(k)


def trigrams(docs: DataFrame) -> DataFrame:
    """(doc_id, trigram, n): counts of three-character runs of the lower-cased text."""
    t = F.lower("text")
    runs = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    some = docs.where(F.length("text") >= 3).select("doc_id", F.explode(runs).alias("trigram"))
    return some.groupBy("doc_id", "trigram").agg(F.count("*").alias("n"))


def cosine_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows of highest cosine to one vector; 0 for other sizes and zero vectors, ties to the smaller id."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(e, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    size = sum(x * x for x in map(float, query)) ** 0.5
    cosine = F.when((F.size(e) == len(query)) & (norm > 0), dot / (norm * F.lit(size))).otherwise(0.0)
    return vectors.select("vec_id", F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(k)


def placed(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(key, place): the place from 0 of each row by a score, highest first, ties to the smaller key.

    Rows are range-sorted in many tasks; a row's place is its place in its partition after those of
    the partitions before, whose sizes are one small row each.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last(score), F.asc(key)]
    ordered = settled(rows.select(key, score).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))  # a row a partition
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select(key, (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias("place"))


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, place from 0): the sum of 1 / (k + place + 1)."""
    out = lists[0].select(key, "place")
    for other in lists[1:]:
        out = out.unionAll(other.select(key, "place"))
    return out.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("place") + 1)), 8).alias("score"))


def boosts(query: str) -> dict[str, float]:
    """How much a query's form favours kinds of nodes: Pascal case classes, underscores functions, dots qualified names."""
    q, out = query.strip(), {}
    if q[:1].isupper() and q[1:2].islower():
        out.update({"Class": 1.5, "Type": 1.5})
    if "_" in q and any(c.isalpha() for c in q):
        out["Function"] = 1.5
    if "." in q:
        out["qualified"] = 2.0
    return out


def hybrid(nodes: DataFrame, lists: list[DataFrame], query: str, k: int, files: list[str] = (), kind: str | None = None) -> DataFrame:
    """The k nodes best by fused ranked lists (qualified_name, place), favoured by the query's form and by files at hand."""
    favours = boosts(query)
    factor = F.lit(1.0)
    for name, by in favours.items():
        rule = F.contains(F.lower("qualified_name"), F.lit(query.strip().lower())) if name == "qualified" else F.col("kind") == name
        factor = factor * F.when(rule, by).otherwise(1.0)
    if files:
        factor = factor * F.when(F.col("file_path").isin(list(files)), 1.5).otherwise(1.0)
    fused = fuse(lists, "qualified_name")
    rows = fused.join(nodes.select("qualified_name", "kind", "file_path"), "qualified_name")
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return rows.select("qualified_name", "kind", F.round(F.col("score") * factor, 6).alias("score")).orderBy(F.desc("score"), "qualified_name").limit(k)


def close_words(vocabulary: DataFrame, word: str, k: int = 3, least: float = 0.6) -> DataFrame:
    """(term, ratio): the k terms most like a word by the share of matching blocks, at least so much."""
    from .memory import alike

    found = alike(vocabulary.select(F.xxhash64("term").alias("id"), F.col("term").alias("text")), word, least)
    named = found.join(vocabulary.select(F.xxhash64("term").alias("id"), "term"), "id")
    return named.orderBy(F.desc("ratio"), "term").limit(k).select("term", F.round("ratio", 6).alias("ratio"))
