"""S1 as a stateful stream: the fold of a patch log kept in the state store.

A streaming aggregation keeps one row per key: the (order, value) of the last
patch of every column (:func:`crawlq.operators.patch_log.fold`).  Each
micro-batch updates only the keys it names; no landing table is read again.
A merge reads the state of the last committed micro-batch with Spark's
``statestore`` source and applies it as a batch.

Late rows: a patch takes part by its order value, however late it arrives;
one that is older than what the state holds for a column changes nothing
there.  So no watermark is set and nothing is dropped, any cut of the input
into micro-batches gives the same state, and a restarted query goes on from
its checkpoint.  The state grows with the number of keys (as the table
itself), not with the number of patches; for many keys choose the RocksDB
state store (``spark.sql.streaming.stateStore.providerClass``).  The state is
partitioned by ``spark.sql.shuffle.partitions`` of the first run.

Patches that cannot be applied are landed as they are by a second query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from crawlq.operators import patch_log
from crawlq.session import scratch_path
from crawlq.streaming.stream import _finish, land


def fold_stream(log: DataFrame, order: str, checkpoint: str, now: Column | None = None, *,
                key: str = "id", stamp: str | None = None, available_now: bool = True,
                processing_time: str | None = None) -> StreamingQuery:
    """Start the query that folds a streamed patch log into its state store.

    Only the state is kept; the sink discards the changed rows.  With a
    ``stamp`` column, ``processed_at`` and ``updated_at`` are the patches' own
    times; otherwise ``now`` or the time of the micro-batch.
    """
    folded = patch_log.fold(log, order, now, key=key, stamp=stamp)
    writer = (folded.writeStream.outputMode("update").format("noop")
              .option("checkpointLocation", checkpoint))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=processing_time or "10 seconds"))
    return writer.start()


def folded_state(spark: SparkSession, checkpoint: str, key: str = "id") -> DataFrame:
    """The fold after the last committed micro-batch, one row per key.

    The state row of an aggregation holds the key and one buffer per
    aggregate, in their order; the buffer of ``max`` is its value.  All buffers
    have the same name, so they are named by position first.
    """
    state = spark.read.format("statestore").load(checkpoint)
    named = StructType([StructField(name, f.dataType) for name, f in zip(
        patch_log.FOLDED.values(), state.schema["value"].dataType.fields, strict=True)])
    return (state.select(F.col(f"key.{key}").alias(key), F.col("value").cast(named).alias("value"))
            .select(key, "value.*"))


def stream_patch_log(spark: SparkSession, target: DataFrame, log: DataFrame, order: str,
                     now: Column | None = None, *, key: str = "id", stamp: str | None = None,
                     on_missing: str = "reject", checkpoint: str | None = None,
                     rejects: str | None = None, timeout_s: float | None = None) -> DataFrame:
    """Fold what the stream holds now, then merge the state into ``target``.

    ``checkpoint`` (a folder of its own, reused by later calls) carries the
    state from call to call: each call folds the patches that arrived since,
    and its result is ``target`` with all patches since the first call.  Give
    the same ``target`` or the last result: applying a patch twice changes
    nothing.  Rejected patches are landed in ``rejects`` and come back with
    ``_action`` ``reject``.
    """
    checkpoint = checkpoint or scratch_path(spark, "patch-state")
    rejects = rejects or checkpoint.rstrip("/") + "-rejects"
    queries = [fold_stream(log, order, f"{checkpoint}/fold", now, key=key, stamp=stamp),
               land(log.filter(~patch_log.valid(key)), rejects, f"{checkpoint}/rejects")]
    for q in queries:
        _finish(q, timeout_s)
        if q.exception() is not None:
            raise q.exception()
    merged = patch_log.apply_folded(target, folded_state(spark, f"{checkpoint}/fold", key),
                                    key=key, on_missing=on_missing)
    return patch_log.with_rejected(merged, spark.read.schema(log.schema).parquet(rejects), key)
