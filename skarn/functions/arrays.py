"""Small helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def counted(values: Column) -> Column:
    """Distinct values of an array of strings as structs (n, v), commonest first, ties by value.

    The array is sorted once and cut where neighbours differ, so the work is that of a sort.
    """

    def runs(s: Column) -> Column:
        return let(F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))), lambda at: sized(s, at))

    def sized(s: Column, at: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(at, k + 1), F.size(s) + 1)
        pairs = F.transform(at, lambda i, k: F.struct((i - stop(k)).alias("m"), F.get(s, i - 1).alias("v")))
        return F.transform(F.array_sort(pairs), lambda p: F.struct((-p["m"]).alias("n"), p["v"].alias("v")))

    none = F.array().cast("array<struct<n:int,v:string>>")
    return let(F.array_sort(values), lambda s: F.when(F.size(s) == 0, none).otherwise(runs(s)))
