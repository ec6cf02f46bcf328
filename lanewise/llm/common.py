"""Shared folder, materialised tables and connected components of the training-data operators."""
from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later plans start from files that survive executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_memory: dict[object, object] = {}


def give_back() -> None:
    """Returns freed memory to the system: Python's, Arrow's pool and the C allocator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def remembered(owner: object, make: Callable[[], T]) -> T:
    """What a worker process keeps from task to task for one operator; the next operator's begins with the other's end."""
    if owner not in _memory:
        _memory.clear()
        give_back()
        _memory[owner] = make()
        give_back()
    return _memory[owner]


def few_at_once(spark: SparkSession) -> None:
    """Documents are long: batches between Spark and its Python workers are bounded by bytes and by fewer rows than usual."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def slices_of(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``most`` bytes of ``column`` each; a longer value is a part of its own."""
    total, start = 0, 0
    for i, v in enumerate(batch.column(column)):
        size = len(v.as_buffer()) if v.is_valid else 0
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b); ids without an edge do not appear.

    Every round takes the smallest label among the neighbours and then the label
    of that label, so rounds grow with the logarithm of a chain's length. A
    vertex with very many edges is met by partial minima, not by one task.
    """
    both = edges.select("a", "b").where("a <> b")
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))

    def step(now: DataFrame) -> DataFrame:
        near = (both.join(now.withColumnRenamed("id", "b"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        met = now.join(near, "id").select("id", F.least("component", "near").alias("now"))
        jump = met.select(F.col("id").alias("now"), F.col("now").alias("component"))
        return met.join(jump, "now").select("id", "component")

    while True:
        new = saved(step(labels).join(labels.withColumnRenamed("component", "was"), "id"))
        labels = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return labels
