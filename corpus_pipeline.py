"""From raw documents to packed sequences: five stages, each a training-data operator.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns
the columns of documents, but for the last, which returns packed pieces.  Null texts count as
empty and null ids are ids of their own; repeated rows are judged alike and kept as often as they
come, but for near-duplicates, where one row of a class stays; columns beyond those of documents
pass through whatever their names, up to the last stage; no rows give no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import line_dedup, minhash, packing, quality, toxicity
from skarn.llm._common import shared_folder, spare


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees score 0.5 or more (a tie stays); an empty text is scored as such."""
    model = quality.fit_on_sample(docs, _labels(spark, sf_dir), modulus=3, held=1)
    score = spare(docs, "score")
    return quality.score_documents(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5 (a tie goes); an empty text is scored as such."""
    model = toxicity.fit_on_sample(docs, _labels(spark, sf_dir), modulus=5, held=0)
    score = spare(docs, "score")
    return toxicity.score_documents(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more share, but for the copy in the largest id; n_chars follows."""
    kept = line_dedup.dedup_lines(docs, counts=(spare(docs, "n_lines"), spare(docs, "n_dropped")))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the least id; all empty texts are one group."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences of 1,024; an empty text is its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", drop_copies),
    ("packing", pack),
]

#: SQL can express neither the trained models nor the hashing and packing; a test holds each stage to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is a table in the shared folder that the next reads."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
