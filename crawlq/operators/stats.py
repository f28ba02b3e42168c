"""Status roll-ups of the queues.

All counts are ``groupBy(...).count()``: Spark aggregates each partition
before the shuffle (map-side partial aggregation), so a status or depth that
holds most of the rows costs one small partial row per partition, not a
hot reducer.  Counts are named ``n`` (a column named ``count`` collides with
``Row.count``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import DEFAULT_CRAWL_DEPTH, PENDING, UNASSIGNED


def status_label(status: Column | str = "status") -> Column:
    """NULL or empty status reads as pending."""
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(PENDING))


def owner_label(owner: Column | str = "extension_id") -> Column:
    """NULL or empty owner reads as ``unassigned``."""
    o = F.col(owner) if isinstance(owner, str) else owner
    return F.coalesce(F.nullif(o, F.lit("")), F.lit(UNASSIGNED))


def depth_label(depth: Column | str = "crawl_depth") -> Column:
    """NULL or 0 depth reads as depth 1."""
    d = F.col(depth) if isinstance(depth, str) else depth
    return F.coalesce(F.nullif(d, F.lit(0)), F.lit(DEFAULT_CRAWL_DEPTH).cast("long"))


def _count(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stats_by_owner(df: DataFrame) -> DataFrame:
    """Rows per (status, extension_id); NULLs kept as their own groups."""
    return _count(df, F.col("status"), F.col("extension_id"))


def stats_by_depth(df: DataFrame) -> DataFrame:
    """Rows per (status, crawl_depth)."""
    return _count(df, F.col("status"), F.col("crawl_depth"))


def stats_profile_by_depth(profiles: DataFrame, url_queue: DataFrame,
                           key: str = "account_id") -> DataFrame:
    """D3: profile rows per (status, crawl_depth) of their URL rows.

    The profile table carries neither column, so each profile is joined to
    the URL rows of its account and the joined pairs are counted, exactly as
    ``COUNT(*)`` over ``url_queue JOIN profiles USING (account_id)``.  Both
    sides are aggregated on the key first (partial aggregation, safe for
    hot accounts); the pair count is then ``urls * profiles`` per account,
    so the join moves one row per (account, status, depth) instead of the
    fan-out of both tables.
    """
    urls = url_queue.groupBy(key, "status", "crawl_depth").agg(
        F.count(F.lit(1)).alias("_u"))
    profs = profiles.groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
    return (urls.join(profs, key, "inner")
            .groupBy("status", "crawl_depth")
            .agg(F.sum(F.col("_u") * F.col("_p")).alias("n")))


def stats_owner_rollup(df: DataFrame) -> DataFrame:
    """Rows per (status label, owner label).

    Groups that fold into the same labels (NULL and 'pending', NULL and '')
    are summed; the original overwrote one with the other.
    """
    return _count(df, status_label().alias("status"), owner_label().alias("extension_id"))


def stats_depth_rollup(df: DataFrame) -> DataFrame:
    """Rows per (depth label, status label), summed across folded groups."""
    return _count(df, depth_label().alias("crawl_depth"), status_label().alias("status"))


def _long(section: str, df: DataFrame, dim1: str, dim2: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"),
                     F.col(dim1).cast("string").alias("dim1"),
                     F.col(dim2).cast("string").alias("dim2"), "n")


def stats_report(seeds: DataFrame, urls: DataFrame, profiles: DataFrame,
                 seeds_v1: DataFrame | None = None,
                 urls_v1: DataFrame | None = None) -> DataFrame:
    """The five roll-ups as one long table (section, dim1, dim2, n).

    seed sections: dim1 = status label, dim2 = owner label; URL and profile
    sections: dim1 = depth label, dim2 = status label.  The profile section
    goes through :func:`stats_profile_by_depth`, then is relabelled.
    """
    parts = [
        _long("seed_urls", stats_owner_rollup(seeds), "status", "extension_id"),
        _long("profile_urls", stats_depth_rollup(urls), "crawl_depth", "status"),
        _long("profiles", _relabel_depth(stats_profile_by_depth(profiles, urls)),
              "crawl_depth", "status"),
    ]
    if seeds_v1 is not None:
        parts.append(_long("seed_urls_v1", stats_owner_rollup(seeds_v1), "status", "extension_id"))
    if urls_v1 is not None:
        parts.append(_long("profile_urls_v1", stats_depth_rollup(urls_v1), "crawl_depth", "status"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _relabel_depth(counts: DataFrame) -> DataFrame:
    return (counts.groupBy(depth_label().alias("crawl_depth"), status_label().alias("status"))
            .agg(F.sum("n").alias("n")))


def nested_rollup(long_form: DataFrame, outer: str, inner: str, value: str = "n") -> DataFrame:
    """D4/D5 map form: one row per ``outer`` label with ``counts``, the map
    inner -> value.

    NULL keys are labelled first by the roll-ups, so map keys are never NULL.
    A row holds the inner labels of one outer label and nothing is gathered
    beyond that.
    """
    entry = F.struct(F.col(inner).cast("string"), F.col(value))
    return long_form.groupBy(F.col(outer).cast("string").alias(outer)).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counts"))
