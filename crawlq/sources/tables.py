"""Table sources and sinks over parquet paths.

Tables are parquet directories under a root path.  A merge result is never
written over the path it reads: :func:`write_merged` writes a new snapshot
directory, refuses targets inside its own inputs, and counts the merge
actions with an ``Observation`` during that one write job (no second pass).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlq.constants import ACTION_COL
from crawlq.functions.columns import required_fields_ok
from crawlq.operators import merge
from crawlq.plans.normalize import rejected_rows, split_valid, valid_rows
from crawlq.sources.schemas import SCHEMAS


def table_path(root: str, platform: str, table_type: str) -> str:
    return posixpath.join(root.rstrip("/"), f"{platform}_{table_type}")


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(0)
        return True
    except AnalysisException:
        return False


def ensure_tables(spark: SparkSession, root: str,
                  schemas: Mapping[tuple[str, str], StructType] = SCHEMAS) -> DataFrame:
    """A2: create every missing table (an empty parquet table with the declared
    schema), leave existing ones alone.

    Returns a small report: platform, table_type, path, status
    (``created`` / ``existing``).
    """
    report = []
    for (platform, table_type), schema in schemas.items():
        path = table_path(root, platform, table_type)
        if table_exists(spark, path):
            report.append((platform, table_type, path, "existing"))
        else:
            spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
            report.append((platform, table_type, path, "created"))
    return spark.createDataFrame(
        report, "platform string, table_type string, path string, status string")


def scan(spark: SparkSession, path: str, schema: StructType,
         columns: Sequence[str] | None = None) -> DataFrame:
    """A3: read a table with its declared schema (no inference), optionally
    only some columns (pruned at the parquet scan)."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def to_batch(spark: SparkSession, data, schema: StructType | str | None = None) -> DataFrame | None:
    """A4: DataFrame -> itself; dict -> one-row frame; list of dicts -> frame;
    empty list -> ``None``; anything else -> ``TypeError``.

    Lists and dicts are request payloads (small by nature); large inputs
    arrive as DataFrames read from storage.
    """
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, dict):
        data = [data]
    if isinstance(data, list):
        if not data:
            return None
        return spark.createDataFrame(data, schema) if schema is not None else spark.createDataFrame(data)
    raise TypeError(f"unsupported batch type {type(data).__name__}; use a DataFrame, "
                    "a list of dicts or a dict")


def load_flat(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A5: the batch's columns that are listed, with ``parent_account_id`` as
    text (NULL stays NULL, unlike the original's ``"None"``)."""
    keep = [c for c in df.columns if c in set(columns)]
    return df.select(*[F.col(c).cast("string").alias(c) if c == "parent_account_id" else F.col(c)
                       for c in keep])


def load_nested(df: DataFrame, schema: StructType, json_col: str = "value") -> DataFrame:
    """JSON text rows parsed under the declared schema; unknown fields are
    ignored, missing ones are NULL."""
    return df.select(F.from_json(F.col(json_col), schema).alias("_r")).select("_r.*")


def read_json_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A6 for files: JSON lines read under the declared schema."""
    return spark.read.schema(schema).json(path)


def align_columns(batch: DataFrame, schema: StructType, key: str | None = None) -> DataFrame:
    """The batch's columns that the table declares (batch order kept)."""
    names = [f.name for f in schema.fields]
    if key is None:
        return batch.select(*[c for c in batch.columns if c in set(names)])
    return merge.align_columns(batch, names, key)


def append_rows(rows: DataFrame, path: str, schema: StructType,
                table_type: str | None = None) -> DataFrame:
    """Append rows to a table unconditionally (duplicates allowed).

    Columns the table lacks are dropped; rows missing a required field are
    not written.  Returns the rejected rows with their reason (a lazy
    DataFrame over the same input).
    """
    aligned = merge.cast_like(align_columns(rows, schema), schema)
    ok = required_fields_ok(table_type or "", aligned.columns)
    marked = split_valid(aligned, {"missing required fields": ok})
    valid_rows(marked).write.mode("append").parquet(path)
    return rejected_rows(marked)


def write_merged(merged: DataFrame, path: str, mode: str = "errorifexists",
                 partition_by: Sequence[str] = ()) -> dict[str, int]:
    """A9 + D9: write a merge result as a new table and return the number of
    rows per action, counted during the write itself.

    ``reject`` rows and the action column are not written.  The result goes to
    a new path: a path that exists may be one that the plan reads, so other
    modes are refused.
    """
    if mode not in ("errorifexists", "error"):
        raise ValueError(f"a merge result goes to a new path; mode {mode!r} may overwrite what the plan reads")
    obs = Observation("merge_actions")
    counted = merged.observe(obs, *[
        F.count_if(F.col(ACTION_COL) == a).alias(a)
        for a in (merge.KEEP, merge.UPDATE, merge.INSERT, merge.REJECT)])
    writer = merge.table_rows(counted).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return {k: int(v) for k, v in obs.get.items()}
