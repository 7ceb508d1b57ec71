"""Running sums of groups of any size: no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sums_before(rows: DataFrame, group: Column, order: list[str], value: str, name: str, keep) -> DataFrame:
    """`rows` with `name`: the sum of `value` over the rows of the same group that come before by `order`, which tells rows apart.

    Rows are range-sorted by group and order; within a partition sums run over its own rows, and what
    earlier partitions hold of the same group, a row a partition and group, is added.  `keep` settles a
    table, since the partitions must not change.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keep(rows.withColumn("_group", group).repartitionByRange(parts, "_group", *order).withColumn("_part", F.spark_partition_id()))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("_part", "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ordered.groupBy("_part", "_group").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    summed = ordered.withColumn("_local", local).join(carry, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return summed.withColumn(name, F.col("_local") + F.col("_carried")).drop("_group", "_part", "_local", "_p", "_g", "_carried")
