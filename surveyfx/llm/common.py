"""Folders, written tables and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that Spark hands to a Python worker at a time.
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that the driver and all executors share (`spark.checkpoint.dir`).

    Where the setting is missing, a local session gets a folder of its own; on a cluster that is an error, because a machine's own folder is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="surveyfx-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Limit Arrow batches to `BATCH_BYTES` while a table is written; the session's own limit comes back afterwards.

    Executor and worker each hold a batch and copies of it, so that long texts make batches of the usual size dear.
    """
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_tables: list = []


def worker_tables(make: Callable) -> Callable:
    """Remember the tables that a tokenizer's tasks need in a worker, until a task of another kind runs there."""

    @lru_cache(maxsize=2)
    @wraps(make)
    def kept(*args):
        made = make(*args)
        release()  # what reading the vocabulary took
        return made

    _tables.append(kept)
    return kept


def release() -> None:
    """Give the system back what a worker holds but does not use; it stays behind, idle, when its task has ended."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def drop_tables() -> None:
    """Let go of tokenizers' tables in this worker."""
    if any(t.cache_info().currsize for t in _tables):
        for t in _tables:
            t.cache_clear()
        gc.collect()
        release()


def lean(task: Callable) -> Callable:
    """The task of a `mapInArrow` that runs without tokenizers' tables in its worker, and leaves no unused memory there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        yield from task(batches)
        release()

    return run


def tasks_for(df: DataFrame, rows: int, per_task: int) -> int:
    """Partitions for `rows` rows of which a task should hold `per_task`, at least the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(rows / per_task))


def row_key(*columns: str) -> list[Column]:
    """Two hashes that tell rows apart by the given columns; nulls differ from empty texts."""
    parts = [F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return [F.xxhash64(*parts), F.hash(*parts)]


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add; an operator's own columns replace the caller's."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])
