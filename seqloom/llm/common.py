"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and every executor can reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset it lies in the warehouse, if all tasks run
    on this machine or the warehouse is no local folder; otherwise there is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        local = base.startswith(("file:", "/")) or ":" not in base
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a shared folder and read it back, which cuts its lineage."""
    path = shared_folder(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of two or three numbers that may be broadcast: with them some 100 MB in an executor.
BROADCAST_ROWS = 1_000_000


def if_small(thin: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcasting if it has BROADCAST_ROWS rows at
    most. Then the other side of its join stays where it is; beyond that both are shuffled."""
    return F.broadcast(thin) if thin.count() <= BROADCAST_ROWS else thin


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, named doc_id and text; a null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def tasks(spark: SparkSession, per_shuffle_partition: int = 1) -> int:
    """A partition count that follows the session's setting, which follows the cluster and the data."""
    return max(8, per_shuffle_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives back the free memory that Arrow's pool and the C library keep when a
    task ends: a worker stays, idle, while stages without Python run beside it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return tidied


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
