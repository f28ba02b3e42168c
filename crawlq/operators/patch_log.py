"""One log of mixed patches, replayed in order (M7-M10 as one).

Status changes, owner claims, claims for processing and cursor moves of one
queue arrive interleaved.  Each sets some columns to values that don't depend
on the row before, so applying them one by one equals, per column, the last
patch that sets the column.  The fold is therefore one aggregate per key:
``max`` over (order, value) structs, which combines on the map side (a key
holding a third of the log costs one row per partition) and is the same
expression in a batch and in a stream's state store.

A log row has the key, ``kind``, ``status``, ``extension_id``, ``start`` and
an order column:

==========  ============================================  ====================
kind        sets                                          valid when
==========  ============================================  ====================
status      status (NULL too); processed_at if it is      key given
            ``processing``
owner       extension_id                                  key and owner given
claim       status ``processing``, extension_id,          key and owner given
            processed_at
cursor      start                                         key and start given
==========  ============================================  ====================

Every valid patch sets ``updated_at``.  Empty text counts as not given.
Patches equal in order count as ordered by their values.  Other rows (a kind
not listed included) change nothing and come back as ``reject``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import ACTION_COL, PROCESSING
from crawlq.operators import merge

STATUS, OWNER, CLAIM, CURSOR = "status", "owner", "claim", "cursor"

# Column of the table -> column of the folded log that holds (order, value).
FOLDED = {"status": "_status", "extension_id": "_owner", "start": "_start",
          "processed_at": "_started", "updated_at": "_last"}


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def valid(key: str = "id") -> Column:
    """Whether a log row can be applied; never NULL."""
    kind = F.col("kind")
    ok = (F.when(kind == STATUS, F.lit(True))
          .when(kind.isin(OWNER, CLAIM), _given("extension_id"))
          .when(kind == CURSOR, F.col("start").isNotNull())
          .otherwise(F.lit(False)))
    return _given(key) & ok


def fold_aggregates(order: Column, stamp: Column) -> list[Column]:
    """The aggregates of the fold, one per column of :data:`FOLDED`, in its
    order; NULL where no patch sets the column."""
    kind = F.col("kind")
    status = F.when(kind == CLAIM, F.lit(PROCESSING)).otherwise(F.col("status"))
    moves = kind.isin(STATUS, CLAIM)
    sets = {
        "status": (moves, status),
        "extension_id": (kind.isin(OWNER, CLAIM), F.col("extension_id")),
        "start": (kind == CURSOR, F.col("start").cast("long")),
        "processed_at": (moves & (status == PROCESSING), stamp),
        "updated_at": (kind.isNotNull(), stamp),
    }
    return [F.max(F.when(cond, F.struct(order.alias("at"), value.alias("value")))).alias(FOLDED[c])
            for c, (cond, value) in sets.items()]


def fold(log: DataFrame, order: str, now: Column | None = None, *, key: str = "id",
         stamp: str | None = None) -> DataFrame:
    """One row per key with the (order, value) of the last patch of each column.

    ``log`` may be a stream.  Rows that are not :func:`valid` are left out.
    ``processed_at`` and ``updated_at`` take the patch's own ``stamp`` column
    where given, else ``now`` (default: the current time).
    """
    at = F.col(stamp) if stamp else (F.current_timestamp() if now is None else now)
    return log.filter(valid(key)).groupBy(key).agg(*fold_aggregates(F.col(order), at))


def refold(folded: DataFrame, key: str = "id") -> DataFrame:
    """Folds of several parts of a log (same order values) as one fold."""
    return folded.groupBy(key).agg(*[F.max(c).alias(c) for c in FOLDED.values()])


def apply_folded(target: DataFrame, folded: DataFrame, *, key: str = "id",
                 on_missing: str = "reject", broadcast_max_rows: int | None = None) -> DataFrame:
    """Merge a fold into ``target``: columns that no patch set keep their value.

    ``folded`` holds one row per key.  Columns that the target lacks (a seed
    queue has no ``start``) are left out.
    """
    cols = {c: f for c, f in FOLDED.items() if c in target.columns}
    source = folded.select(
        key, *[F.col(f).getField("value").alias(c) for c, f in cols.items()],
        *[F.col(f).isNotNull().alias("_sets" + f) for f in cols.values()])
    return merge.upsert(target, source, key, on_missing=on_missing,
                        given={c: "_sets" + f for c, f in cols.items()},
                        broadcast_max_rows=broadcast_max_rows)


def with_rejected(merged: DataFrame, rejected: DataFrame, key: str = "id") -> DataFrame:
    """``merged`` and the log rows that could not be applied."""
    cols = [c for c in (key, "status", "extension_id", "start") if c in merged.columns]
    bad = merge.cast_like(rejected.select(*cols), merged.schema)
    return merged.unionByName(bad.withColumn(ACTION_COL, F.lit(merge.REJECT)),
                              allowMissingColumns=True)


def replay(target: DataFrame, log: DataFrame, order: str, now: Column | None = None, *,
           key: str = "id", stamp: str | None = None, on_missing: str = "reject",
           broadcast_max_rows: int | None = None) -> DataFrame:
    """The table after all patches of ``log`` in their order, with ``_action``.

    The fold is stored once, as the merge reads it several times.  Unknown
    keys and rows that are not :func:`valid` are marked ``reject``.
    """
    folded = merge.materialize(fold(log, order, now, key=key, stamp=stamp))
    merged = apply_folded(target, folded, key=key, on_missing=on_missing,
                          broadcast_max_rows=broadcast_max_rows)
    return with_rejected(merged, log.filter(~valid(key)), key)
