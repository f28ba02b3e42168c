"""Global row numbers without a global window.

Rows are range-partitioned by the order, sorted inside their partition and
stored; a row's number is the count of the rows in the ranges before it plus
its place in its own range.  The counts are one row per range, so the prefix
sum over them is small whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlq.operators import merge

PART, ROW = "_part", "_row"

# ``monotonically_increasing_id``: the partition above, the place in it in the low 33 bits.
_PLACE_BITS = 33


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` sorted by range, with the number of each row's range (``_part``)
    and its place in it (``_row``).  Store it before use: the numbers belong to
    one execution.  Rows equal in the whole order share one range, so end the
    order with a unique column."""
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    return (ranged.withColumn(PART, F.shiftright("_at", _PLACE_BITS).cast("int"))
            .withColumn(ROW, F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_at"))


def starts(ranged: DataFrame) -> DataFrame:
    """One row per range: ``_part``, ``n`` rows, ``start`` = rows in the ranges before."""
    n = ranged.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    # One row per range: the window without a partition holds no more than that.
    before = F.sum("n").over(Window.orderBy(PART)) - F.col("n")
    return n.withColumn("start", before)


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the row number from 0 in the given order."""
    ranged = merge.materialize(in_ranges(df, order))
    # At most one row per partition of the range shuffle.
    at = F.broadcast(starts(ranged).select(PART, "start"))
    return ranged.join(at, PART).withColumn(rank, F.col("start") + F.col(ROW)).drop(PART, ROW, "start")
