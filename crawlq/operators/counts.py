"""Roll-ups kept up to date by merges.

A merge knows which rows it changed.  :func:`tracked` lets the target carry
the counted columns as they were before; from the merge's ``update`` and
``insert`` rows each roll-up then takes minus the old and plus the new values.
The counts of the profile section are of joined pairs (URL rows times
profiles of an account), whose change is
``dU x P_before + U_after x dP``.  Nothing but the changed rows, and for pairs
the rows of their accounts, is counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import ACTION_COL
from crawlq.operators import merge, stats

_BEFORE = "_before"

SEED_COLS = ("status", "extension_id")
URL_COLS = ("account_id", "status", "crawl_depth")
PROFILE_COLS = ("account_id",)


def tracked(target: DataFrame, *cols: str) -> DataFrame:
    """The target of a merge, carrying ``cols`` as they are before it."""
    return target.withColumn(_BEFORE, F.struct(*cols))


def changes(merged: DataFrame, *cols: str) -> DataFrame:
    """Net change of the number of rows per ``cols`` that a merge of a
    :func:`tracked` target made: ``cols``, ``n`` (never 0)."""
    before = F.when(F.col(_BEFORE).isNotNull(), F.struct(
        *[F.col(_BEFORE).getField(c).alias(c) for c in cols], F.lit(-1).alias("n")))
    after = F.struct(*cols, F.lit(1).alias("n"))
    moved = merged.filter(F.col(ACTION_COL).isin(merge.UPDATE, merge.INSERT))
    each = moved.select(F.explode(F.array(before, after)).alias("m")).filter(F.col("m").isNotNull())
    return each.select("m.*").groupBy(*cols).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def _section(name: str, change: DataFrame, dim1: Column, dim2: Column) -> DataFrame:
    return change.groupBy(F.lit(name).alias("section"), dim1.cast("string").alias("dim1"),
                          dim2.cast("string").alias("dim2")).agg(F.sum("n").alias("n"))


def seed_changes(merged: DataFrame, section: str = "seed_urls") -> DataFrame:
    """Change of a seed section of the report by a merge of its queue."""
    return _section(section, changes(merged, *SEED_COLS), stats.status_label(), stats.owner_label())


def url_changes(merged: DataFrame, section: str = "profile_urls") -> DataFrame:
    """Change of a URL section of the report by a merge of its queue."""
    return _section(section, changes(merged, *URL_COLS), stats.depth_label(), stats.status_label())


def profile_changes(urls_merged: DataFrame | None, profiles_before: DataFrame,
                    profiles_merged: DataFrame | None, urls_after: DataFrame,
                    section: str = "profiles") -> DataFrame:
    """Change of the profile section by a merge of the URL queue, of the profile
    table, or of both (then the URL queue's counts as the first)."""
    parts = []
    if urls_merged is not None:
        du = changes(urls_merged, *URL_COLS)
        p = profiles_before.groupBy("account_id").agg(F.count(F.lit(1)).alias("_k"))
        parts.append(du.join(p, "account_id"))
    if profiles_merged is not None:
        dp = changes(profiles_merged, *PROFILE_COLS).withColumnRenamed("n", "_k")
        u = urls_after.groupBy(*URL_COLS).agg(F.count(F.lit(1)).alias("n"))
        parts.append(u.join(dp, "account_id"))
    if not parts:
        raise ValueError("give the merge of the URL queue, of the profile table, or both")
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pairs = pairs.withColumn("n", F.col("n") * F.col("_k"))
    return _section(section, pairs, stats.depth_label(), stats.status_label())


def maintained(report: DataFrame, *change: DataFrame) -> DataFrame:
    """The long-form report (:func:`stats.stats_report`) after the changes.

    Groups that come to 0 rows leave it.  A group below 0 means that a change
    belongs to another report: the job fails.
    """
    keys = ("section", "dim1", "dim2")
    out = report.select(*keys, "n")
    for c in change:
        out = out.unionByName(c.select(*keys, "n"))
    total = out.groupBy(*keys).agg(F.sum("n").alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.concat(
        F.lit("negative count in section "), F.col("section")))).otherwise(F.col("n"))
    return total.filter(F.col("n") != 0).withColumn("n", checked.cast("long"))
