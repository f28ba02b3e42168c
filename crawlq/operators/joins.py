"""Join operators over the URL queue and the profile table.

All joins are equi-joins on one key.  The read joins force no broadcast:
both sides are plain shuffles, so the optimizer and AQE choose (a side is
broadcast only when its measured size is under the threshold; otherwise both
sides shuffle on the key and AQE splits skewed partitions).  The batch probe
(:func:`key_exists`) broadcasts only a size-checked side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import COMPLETED
from crawlq.operators import merge

_LINEAGE_COLS = ("account_id", "parent_account_id", "crawl_depth", "seed_url_id")


def parent_in(df: DataFrame, parents: DataFrame, parent_col: str = "parent_account_id",
              key: str = "account_id") -> DataFrame:
    """Rows of ``df`` whose non-NULL parent is one of ``parents[key]``.

    A left-semi join: each row is kept at most once, whatever the number of
    matching parents.  NULL parents never match.
    """
    probe = parents.select(F.col(key).alias(parent_col))
    return df.filter(F.col(parent_col).isNotNull()).join(probe, parent_col, "left_semi")


def not_exists(df: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """C4: rows of ``df`` whose key does not occur in ``target`` (left-anti).

    Rows with a NULL key never match, so they are kept (as in ``NOT EXISTS``).
    """
    return df.join(target.select(key), key, "left_anti")


def key_exists(batch: DataFrame, target: DataFrame, key: str,
               flag: str = "exists", small: bool | None = None) -> DataFrame:
    """The whole batch with a boolean ``flag`` telling whether its key exists.

    One join for the batch instead of one probe per key.  Only the target
    keys that occur in the batch are looked up (:func:`merge.matched_keys`:
    a broadcast semi join over the target's key column when the batch's key
    set is small, pre-aggregated key sets otherwise); that found-key set is
    at most one row per batch key, so the final left join cannot fan out;
    it is broadcast with a small batch, otherwise materialised and broadcast
    only if that proves small.
    """
    bkeys = batch.select(key).dropDuplicates([key])
    # The raw batch is probed: its distinct keys would take a shuffle to count.
    small = merge.is_small(batch.select(key)) if small is None else small
    found = merge.matched_keys(target, bkeys, key, small).withColumn(flag, F.lit(True))
    # A large batch may still hold few keys: then it need not be shuffled either.
    side = F.broadcast(found) if small else merge.stored_side(found)
    return (batch.join(side, key, "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def _profile_side(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "account_id", "username", "profile_image",
        F.col("created_at").alias("processed_at"),
    )


def _ordered(df: DataFrame) -> DataFrame:
    """Depth, then profile time; account and parent break ties.

    The tie-breakers make the order total, so a range-partitioned global
    sort gets balanced partitions even when a few (depth, time) values hold
    most rows, and the output order is the same on every run.
    """
    return df.orderBy(F.col("crawl_depth").asc_nulls_first(),
                      F.col("processed_at").asc_nulls_first(),
                      F.col("account_id").asc_nulls_first(),
                      F.col("parent_account_id").asc_nulls_first())


def completed_profiles(url_queue: DataFrame, profiles: DataFrame,
                       order: bool = True) -> DataFrame:
    """Completed URL rows joined to their profiles.

    Output: account_id, parent_account_id, crawl_depth, seed_url_id, username,
    profile_image, processed_at (the profile's ``created_at``) and the
    constant status ``completed``; ordered by depth, then processed_at.
    """
    urls = (url_queue.filter(F.col("status") == COMPLETED)
            .select(*_LINEAGE_COLS))
    out = (urls.join(_profile_side(profiles), "account_id", "inner")
           .withColumn("status", F.lit(COMPLETED)))
    return _ordered(out) if order else out


def lineage_profiles(url_queue: DataFrame, profiles: DataFrame,
                     seed_url_id: str | Column, order: bool = True) -> DataFrame:
    """Profiles reached from one seed: direct rows plus one level below.

    ``direct`` = completed URL rows of the seed.  Children = completed rows
    whose non-NULL parent is the account of a direct row (one level only;
    grandchildren are not included).  Both parts are concatenated with
    duplicates kept, then inner-joined to the profile table on account_id;
    columns as in :func:`completed_profiles`.
    """
    seed = seed_url_id if isinstance(seed_url_id, Column) else F.lit(seed_url_id)
    completed = url_queue.filter(F.col("status") == COMPLETED).select(*_LINEAGE_COLS)
    direct = completed.filter(F.col("seed_url_id") == seed)
    children = parent_in(completed, direct.select("account_id"))
    lineage = direct.unionByName(children)
    out = (lineage.join(_profile_side(profiles), "account_id", "inner")
           .withColumn("status", F.lit(COMPLETED)))
    return _ordered(out) if order else out
