"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so that a lost executor costs one re-read.

    The session names the folder in spark.checkpoint.dir; only a local session without one (a
    test) gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder.

    For long loops: a checkpoint carries what the optimiser knows of its columns from round to
    round, which grows with each; a table read again does not.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names, or a temporary one of a local session."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="skarn-checkpoint-")


def spare(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000, size: str = "8m") -> Iterator[None]:
    """Smaller Arrow batches for what runs inside, to bound the memory of Python workers."""
    keys = {"maxRecordsPerBatch": str(rows), "maxBytesPerBatch": size}
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in keys}
    for k, v in keys.items():
        spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)


@contextlib.contextmanager
def memory_returned() -> Iterator[None]:
    """Give what the driver allocated inside back to the system at the end, where the C library can."""
    import pyarrow

    library = ctypes.CDLL(None)
    with contextlib.suppress(AttributeError):
        library.mallopt(-3, 128 * 1024)  # large arrays in mappings of their own, which go when they do
    try:
        yield
    finally:
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError):
            library.malloc_trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo a number: the split between training and held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def char_blocks(lengths: Iterable[int], most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` characters (one row may exceed it) and `rows` rows."""
    lo, total, k = 0, 0, -1
    for k, n in enumerate(lengths):
        if k > lo and (total + n > most or k - lo >= rows):
            yield lo, k
            lo, total = k, 0
        total += n
    if k >= lo:
        yield lo, k + 1


class Slots(dict):
    """Dense numbers for strings in order of arrival; `fresh` gathers those not yet described."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        slot = self[key] = len(self)
        self.fresh.append(key)
        return slot


class Growing:
    """A numpy array with amortised append."""

    def __init__(self, dtype, shape: tuple[int, ...] = ()) -> None:
        self.data, self.n = np.zeros((1024, *shape), dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : need] = values
        self.n = need


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
