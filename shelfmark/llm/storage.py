"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import work_dir


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back: later reads survive lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, whose files Spark may remove when nothing refers to them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    return df.checkpoint()


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Give memory that the allocators hold on to back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` that gives freed memory back to the system when its task ends.

    Spark keeps its Python workers for later tasks, where memory that the allocators hold on
    to would be missing.
    """

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
