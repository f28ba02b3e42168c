"""Pages at any offset of a stored order.

``offset``/``limit`` over an unsorted table sorts ``offset + limit`` rows for
each page.  Here the table is stored once in its order, in ranges, with an index of
the rows before each range; a page at any offset then reads the one or two
ranges it lies in, and inside them the parquet row groups whose places match.
The index goes stale with the table: write it anew (to a new path) after a merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from crawlq.operators.ranks import PART, ROW, in_ranges, starts


def write_pages(df: DataFrame, path: str, order: Sequence[Column]) -> None:
    """Store ``df`` in ``order`` (ended by a unique column) with its range index."""
    in_ranges(df, order).write.partitionBy(PART).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(_stored_schema(df.schema)).parquet(f"{path}/rows")
    starts(stored.select(PART)).write.parquet(f"{path}/index")


def _stored_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(ROW, LongType()), StructField(PART, IntegerType())])


def read_page(spark: SparkSession, path: str, schema: StructType, limit: int,
              offset: int = 0) -> DataFrame:
    """Rows ``offset .. offset + limit`` of the stored order, in it."""
    if limit < 0 or offset < 0:
        raise ValueError(f"limit and offset must not be negative, got {limit!r}, {offset!r}")
    # Ranges hold at least one row each, so at most limit + 1 of them overlap.
    hits = (spark.read.parquet(f"{path}/index")
            .filter((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)).collect())
    rows = spark.read.schema(_stored_schema(schema)).parquet(f"{path}/rows")
    inside = F.lit(False)
    for h in hits:
        inside = inside | ((F.col(PART) == h[PART]) & F.col(ROW).between(
            F.lit(max(0, offset - h["start"])), F.lit(offset + limit - h["start"] - 1)))
    parts = F.col(PART).isin([h[PART] for h in hits]) if hits else F.lit(False)
    return rows.filter(parts & inside).orderBy(PART, ROW).select(*schema.fieldNames())
