"""Tables that live as long as one operator's rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .traverse import shared_folder


class Scratch:
    """A folder of Parquet tables in the session's shared folder.

    A table that is read again has no lineage, and, unlike a checkpoint's, its plan doesn't grow with
    each round; the files outlive executors.  `result` keeps one table and deletes all others.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.shared = spark, shared_folder(spark)
        self.at = f"{self.shared}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` as a table of its own."""
        self.n += 1
        return self._table(df, f"{self.at}/{self.n}")

    def result(self, df: DataFrame) -> DataFrame:
        """`df` as a table outside the folder, which goes."""
        out = self._table(df, f"{self.shared}/result-{uuid.uuid4().hex}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out

    def _table(self, df: DataFrame, at: str) -> DataFrame:
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
