"""Samples of labelled documents, and scores of whole texts in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import char_blocks

BLOCK_CHARS, BLOCK_ROWS = 1_000_000, 1_000


def least_hashes(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows of least hash of a key, of about `total`: each task sends its share, not n rows.

    Only hashes below a bound are ordered, under which n distinct keys are all but certain to
    lie; of a table with many repeated keys the sample may be smaller.
    """
    share = (n + 6 * n**0.5 + 50) / max(total, 1)
    h = F.xxhash64(key)
    near = rows if share >= 1 else rows.where(h < int(-(2**63) + share * 2**64))
    return near.orderBy(h, *rows.columns).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, balanced: bool = False) -> tuple[DataFrame, float]:
    """Labelled rows (doc_id, text, y), at most `most` ids, and the share of label 1 among all.

    The ids are those of least hash (if balanced, half of `most` for each label), so the sample
    does not depend on partitions.  Labels count once an id; ids with differing labels, and
    labels other than 0 and 1, are left out; an id with several texts counts with the least.  Only ids move before the choice; the chosen ones,
    at most `most`, are broadcast.
    """
    spark = docs.sparkSession
    agreed = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_y"))
        .where("y = _y")
        .select("doc_id", "y")
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    )
    counts = {r["y"]: r["count"] for r in agreed.groupBy("y").count().collect()}
    parts = [(agreed.where(F.col("y") == y), counts.get(y, 0)) for y in (0, 1)] if balanced else [(agreed, sum(counts.values()))]
    found = [(r[0], r[1]) for x, size in parts for r in least_hashes(x, "doc_id", most // len(parts), size).collect()]
    chosen = spark.createDataFrame(found, "_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return joined.select("doc_id", "text", "y"), counts.get(1, 0) / max(1, sum(counts.values()))


def scored(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "score") -> DataFrame:
    """`docs` with a score (replacing any column of that name) from a function of lists of whole texts."""

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = make()
        for part in parts:
            texts = part.fillna("").tolist()
            found = [score(texts[a:b]) for a, b in char_blocks(map(len, texts), BLOCK_CHARS, BLOCK_ROWS)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(batches, "double")(F.col("text").cast("string")))
