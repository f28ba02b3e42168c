"""Requests that exclude each other, decided in their order.

A request is accepted if none of its keys was taken by an earlier accepted
request, and then takes all of them.  Served one by one, every decision waits
for the one before.  Here a request waits only for earlier requests that share
a key with it, and rounds decide all requests that wait for nothing:

* a request that is the first open one for each of its keys is accepted;
* every other open request with a key of an accepted one is rejected.

The first open request is always accepted, so every round decides some.  The
number of rounds is the longest chain of requests each of which hangs on the
one before; requests without common keys take one round together.  The state
between rounds is stored, so a round reads the rows that are still open and
nothing else, and a lost executor costs a re-read.  As soon as the open rows
are proven small (``merge.is_small``), one task serves the rest one by one:
chains are long exactly where few requests are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from crawlq.operators import merge
from crawlq.session import scratch_path

_FIRST, _WON = "_first", "_won"


def decide_in_order(items: DataFrame, request: str, key: str) -> DataFrame:
    """(``request``, ``accepted``): one row for each request of ``items``.

    ``items`` has a row for each key of a request; requests are served in
    ascending order of ``request``.  Repeated rows count once, rows with a
    NULL request or key are left out.  A key that very many requests share is
    pre-aggregated to its first request, and the other rows meet that one row
    in a join that AQE can split.
    """
    spark = items.sparkSession
    path = scratch_path(spark, "decisions")
    # Repeated rows change neither minima nor verdicts: they need no shuffle to go.
    open_items = merge.materialize(
        items.select(request, key).where(F.col(request).isNotNull() & F.col(key).isNotNull()))
    schema = StructType([StructField(request, open_items.schema[request].dataType), StructField("accepted", BooleanType())])
    while not open_items.isEmpty():
        if merge.is_small(open_items):
            ordered = open_items.select(request, key).repartition(1).sortWithinPartitions(request)
            ordered.mapInArrow(_one_by_one, schema).write.mode("append").parquet(path)
            break
        first = open_items.groupBy(key).agg(F.min(request).alias(_FIRST))
        seen = merge.materialize(open_items.join(merge.stored_side(first), key))
        won = merge.stored_side(seen.groupBy(request).agg(F.bool_and(F.col(request) == F.col(_FIRST)).alias(_WON))
                                .where(_WON).select(request))
        behind = seen.where(F.col(request) != F.col(_FIRST)).select(request, _FIRST)
        lost = behind.join(won.withColumnRenamed(request, _FIRST), _FIRST, "left_semi").select(request).distinct()
        decided = merge.materialize(won.withColumn("accepted", F.lit(True)).unionByName(lost.withColumn("accepted", F.lit(False))))
        decided.write.mode("append").parquet(path)
        open_items = merge.materialize(
            seen.select(request, key).join(merge.join_side(decided.select(request)), request, "left_anti"))
    if not _written(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Serve requests whose rows (request, key) come in ascending order."""
    taken, asking, keys = set(), None, set()
    for batch in batches:
        requests, accepted = [], []
        for request, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if request != asking and keys:
                requests.append(asking)
                accepted.append(taken.isdisjoint(keys))
                if accepted[-1]:
                    taken |= keys
                keys = set()
            asking = request
            keys.add(key)
        kind = batch.schema.field(0).type
        yield _decisions(requests, accepted, kind)
    if keys:
        yield _decisions([asking], [taken.isdisjoint(keys)], kind)


def _decisions(requests: list, accepted: list[bool], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(requests, kind), pa.array(accepted, pa.bool_())], names=["request", "accepted"])


def _written(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
