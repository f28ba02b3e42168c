"""Streaming ingest (S1-S2) with Structured Streaming.

The original service merges each small POST batch as it arrives (last
writer by arrival wins).  Here an incoming stream is first *landed*: a
``writeStream`` into a parquet table with a checkpoint, which gives
exactly-once files per micro-batch and survives executor or driver loss
(a restarted query resumes from its checkpoint).  Every landed row carries
the micro-batch stamp it arrived with.  Merging is then a batch job over
the landed rows, whose patches carry their order of arrival: the patch
operators fold them into what applying them one by one in that order gives
(last values, and a stamp that any of them set).

Paths live under the session's ``spark.checkpoint.dir`` (shared storage on a
cluster) unless given.  ``foreachBatch`` is not used: in PySpark it needs a
Python callback server; landing + merge needs none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crawlq.session import scratch_path

ARRIVAL_COL = "_arrival"


def file_stream(spark: SparkSession, directory: str, schema: StructType,
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over parquet files in ``directory`` (explicit schema)."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(directory)


def land(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
         processing_time: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table with a checkpoint.

    Each row gets ``_arrival``, the timestamp of the micro-batch that carried
    it.  ``available_now`` processes what is there and stops; otherwise the
    query runs with the given processing-time trigger.
    """
    stamped = stream.withColumn(ARRIVAL_COL, F.current_timestamp())
    writer = (stamped.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=processing_time or "10 seconds"))
    return writer.start()


def _finish(query, timeout_s: float | None) -> None:
    """Wait for an available-now stream; stop it and raise if it isn't done in time."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream had not landed all its input after {timeout_s} s")


def stream_append(spark: SparkSession, stream: DataFrame, path: str | None = None,
                  checkpoint: str | None = None, timeout_s: float | None = None) -> DataFrame:
    """Land the stream (available-now) and return the landed table.

    The returned DataFrame drops the arrival stamp; read ``path`` directly to
    keep it.
    """
    path = path or scratch_path(spark, "landed")
    checkpoint = checkpoint or scratch_path(spark, "landed-ckpt")
    q = land(stream, path, checkpoint)
    _finish(q, timeout_s)
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(path).drop(ARRIVAL_COL)


def merge_landed(spark: SparkSession, target: DataFrame, landed_path: str,
                 apply: Callable[[DataFrame, DataFrame], DataFrame], key: str,
                 order: str | None = None, since=None) -> DataFrame:
    """Merge landed patches into ``target`` in their order of arrival.

    ``since`` (a timestamp) restricts the merge to rows that arrived after
    it, so a continuously running :func:`land` can be merged periodically,
    each run picking up only the new micro-batches.  ``apply`` (e.g.
    :func:`crawlq.operators.merge.patch_status`) gets all the patches with
    the column ``_order`` (arrival, then ``order`` when given) and folds those
    of one ``key`` with partial aggregates; its result is returned.  Give
    ``order`` where a micro-batch may hold several patches of one key: without
    it, they count as ordered by their values.  Rows with a NULL ``key`` reach
    ``apply`` too.
    """
    from crawlq.operators.merge import ORDER_COL

    landed = spark.read.parquet(landed_path)
    if since is not None:
        landed = landed.filter(F.col(ARRIVAL_COL) > F.lit(since))
    ordering = F.struct(ARRIVAL_COL, order) if order else F.struct(ARRIVAL_COL)
    return apply(target, landed.withColumn(ORDER_COL, ordering).drop(ARRIVAL_COL))


def stream_upsert(spark: SparkSession, target: DataFrame, stream: DataFrame,
                  apply: Callable[[DataFrame, DataFrame], DataFrame], key: str,
                  order: str | None = None, path: str | None = None,
                  checkpoint: str | None = None, timeout_s: float | None = None) -> DataFrame:
    """Land a stream of patches (available-now), then merge them into
    ``target`` with :func:`merge_landed`."""
    path = path or scratch_path(spark, "patches")
    checkpoint = checkpoint or scratch_path(spark, "patches-ckpt")
    q = land(stream, path, checkpoint)
    _finish(q, timeout_s)
    if q.exception() is not None:
        raise q.exception()
    return merge_landed(spark, target, path, apply, key, order)
