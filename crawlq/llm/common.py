"""Helpers shared by the operators: tables, shared scratch folder, bounds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The words of a text are the maximal runs of bytes that are not ASCII white
# space.  Python's ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

# A table of at most this many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a fresh temporary folder;
    on a cluster an error is raised, as executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="crawlq-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


# Paths handed out inside the innermost ``scratch`` block, for each open block.
_open: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside the block are deleted at its end, after errors too.

    What must outlive the block is written, not merely planned, inside it, to a
    path taken outside.
    """
    _open.append([])
    try:
        yield
    finally:
        drop_stored(spark, *_open.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    return stored_at(df, scratch_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# What Python workers keep from task to task, a cache for each operator that has one.
_caches: list[dict] = []


def worker_cache() -> dict:
    """A cache at module level that stays in a Python worker between tasks of its operator."""
    _caches.append({})
    return _caches[-1]


def drop_worker_caches() -> None:
    """Empty what tasks of other operators left in this Python worker.

    Workers outlive their tasks, so a task of an operator without a cache would
    else have the memory of all that ran before it besides its own.  What is
    freed goes back to the system where the C library can do that.
    """
    if not any(_caches):
        return
    for cache in _caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def within(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts at most ``limit + 1``."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if within(df, limit) else df
