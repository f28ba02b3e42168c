"""Prioritised and paged reads of the work queues.

Every read is filter -> sort -> limit (optionally offset), which Catalyst
plans as ``TakeOrderedAndProject``: each partition keeps only its own top
``offset + limit`` rows, so the single final merge handles at most
``partitions * (offset + limit)`` rows, whatever the queue size.  The
filter and the column list reach the parquet scan.  Sort keys of the
original reads are not unique, so ``id`` is appended as the last key: the
same table always yields the same page.

NULL order: ascending keys put NULLs first, descending keys put them last.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import (
    FAILED, LIMIT_KEYWORDS, LIMIT_PROFILES, LIMIT_SEEDS_PAGE,
    LIMIT_SEEDS_PENDING, LIMIT_URLS, PENDING, PROCESSING, RESUME_PRIORITY,
    RESUME_PRIORITY_NULL, RESUME_PRIORITY_OTHER, SKIPPED,
)

def _status() -> Column:
    return F.col("status")


def _owner() -> Column:
    return F.col("extension_id")


def _created() -> Column:
    return F.col("created_at")


def check_bounds(limit: int, offset: int = 0, bounds: tuple[int, int] = (100, 1000)) -> None:
    """``limit`` within [1, max] and ``offset`` >= 0, else ``ValueError``.

    ``bounds`` is a (default, max) pair from :mod:`crawlq.constants`.
    """
    hi = bounds[1]
    if not isinstance(limit, int) or not 1 <= limit <= hi:
        raise ValueError(f"limit must be an integer in [1, {hi}], got {limit!r}")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError(f"offset must be an integer >= 0, got {offset!r}")


def top_k(df: DataFrame, keys: Iterable[Column], limit: int, offset: int = 0) -> DataFrame:
    """Sort by ``keys`` then ``id`` and take rows ``offset .. offset+limit``."""
    ordered = df.orderBy(*keys, F.col("id").asc_nulls_first())
    if offset:
        return ordered.offset(offset).limit(limit)
    return ordered.limit(limit)


def _after(stamp: str, after: tuple | None) -> Column:
    """Keyset paging: rows behind (``stamp`` value, id) in the order newest
    first, NULL stamps last, then by id.  No task holds the pages before."""
    if after is None:
        return F.lit(True)
    value, last_id = after
    at, later = F.col(stamp), F.col("id") > _lit(last_id)
    if value is None:
        return at.isNull() & later
    v = _lit(value)
    return at.isNull() | (at < v) | ((at == v) & later)


def _unowned() -> Column:
    return _owner().isNull() | (_owner() == "")


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _keyword_out(df: DataFrame) -> DataFrame:
    # The read reports a missing cursor as 0.
    return df.select("id", "keyword", "status",
                     F.coalesce(F.col("start"), F.lit(0)).alias("start"),
                     "extension_id")


def queue_pending_unowned(df: DataFrame, limit: int = LIMIT_KEYWORDS[0]) -> DataFrame:
    """B1: pending keywords with no owner, oldest first.

    Keyword queues do not read NULL status as pending.
    """
    check_bounds(limit, 0, LIMIT_KEYWORDS)
    rows = df.filter((_status() == PENDING) & _unowned())
    return _keyword_out(top_k(rows, [_created().asc_nulls_first()], limit))


def queue_pending_or_owned(df: DataFrame, owner: str | Column,
                           limit: int = LIMIT_KEYWORDS[0]) -> DataFrame:
    """B2: keywords this owner is processing, then unowned pending ones.

    Rows in ``processing`` (all of them owned by ``owner``) sort first, then
    by age.
    """
    check_bounds(limit, 0, LIMIT_KEYWORDS)
    me = _lit(owner)
    rows = df.filter(((_status() == PROCESSING) & (_owner() == me))
                     | ((_status() == PENDING) & _unowned()))
    rank = F.when(_status() == PROCESSING, 1).otherwise(2)
    return _keyword_out(top_k(rows, [rank, _created().asc_nulls_first()], limit))


def _seed_cols(df: DataFrame, *names: str) -> list[str]:
    """The output columns of seed reads; the v1 table has no ``max_profiles``."""
    return [n for n in names if n != "max_profiles" or n in df.columns]


def seed_pending(df: DataFrame, owner: str | Column,
                 limit: int = LIMIT_SEEDS_PENDING[0]) -> DataFrame:
    """Seeds to work on: pending or NULL status (any owner), or in
    processing by this owner; the owner's own rows first, then oldest."""
    check_bounds(limit, 0, LIMIT_SEEDS_PENDING)
    me = _lit(owner)
    mine = (_status() == PROCESSING) & (_owner() == me)
    rows = df.filter((_status() == PENDING) | _status().isNull() | mine)
    rank = F.when(mine, 0).otherwise(1)
    return top_k(rows, [rank, _created().asc_nulls_first()], limit).select(
        *_seed_cols(df, "id", "url", "max_profiles", "status", "extension_id"))


def seed_page(df: DataFrame, status: str | None = None, limit: int = LIMIT_SEEDS_PAGE[0],
              offset: int = 0, after: tuple | None = None) -> DataFrame:
    """One page of seeds, newest first, optionally of one status.

    ``after`` = (``created_at``, ``id``) of the last row seen starts the page
    behind it, which suits deep pages better than ``offset``.
    """
    check_bounds(limit, offset, LIMIT_SEEDS_PAGE)
    rows = (df.filter(_status() == status) if status else df).filter(_after("created_at", after))
    return top_k(rows, [_created().desc_nulls_last()], limit, offset).select(
        *_seed_cols(df, "id", "url", "max_profiles", "status", "extension_id", "created_at", "updated_at"))


_URL_OUT = ("id", "account_id", "url", "parent_account_id", "crawl_depth",
            "source_type", "seed_url_id")


def _url_filters(depth, seed) -> Column:
    cond = F.lit(True)
    if depth is not None:
        cond = cond & (F.col("crawl_depth") == _lit(depth))
    if seed is not None:
        cond = cond & (F.col("seed_url_id") == _lit(seed))
    return cond


def _url_read(rows: DataFrame, limit: int) -> DataFrame:
    keys = [F.col("crawl_depth").asc_nulls_first(), _created().asc_nulls_first()]
    return top_k(rows, keys, limit).select(*_URL_OUT)


def url_pending(df: DataFrame, depth: int | None = None, seed: str | None = None,
                limit: int = LIMIT_URLS[0]) -> DataFrame:
    """Pending (or NULL status) URLs, optional depth / seed filters, by
    depth then age.  The filters bind to every row (intended grouping)."""
    check_bounds(limit, 0, LIMIT_URLS)
    rows = df.filter(((_status() == PENDING) | _status().isNull()) & _url_filters(depth, seed))
    return _url_read(rows, limit)


def url_pending_as_written(df: DataFrame, depth: int | None = None,
                           seed: str | None = None,
                           limit: int = LIMIT_URLS[0]) -> DataFrame:
    """The same read with the original operator precedence:
    ``status = 'pending' OR (status IS NULL AND depth AND seed)``, so the
    depth and seed filters only restrict the NULL-status rows."""
    check_bounds(limit, 0, LIMIT_URLS)
    rows = df.filter((_status() == PENDING) | (_status().isNull() & _url_filters(depth, seed)))
    return _url_read(rows, limit)


def resume_rank(status: Column | None = None) -> Column:
    """Processing 0, failed 1, skipped 2, pending or NULL 3, other 4."""
    status = _status() if status is None else status
    rank = F.when(status.isNull(), F.lit(RESUME_PRIORITY_NULL))
    for value, prio in RESUME_PRIORITY:
        rank = rank.when(status == value, F.lit(prio))
    return rank.otherwise(F.lit(RESUME_PRIORITY_OTHER))


def url_resumable(df: DataFrame, depth: int | None = None, seed: str | None = None,
                  limit: int = LIMIT_URLS[0]) -> DataFrame:
    """URLs to resume (pending, processing, failed, skipped or NULL), by
    depth, then resume priority, then age."""
    check_bounds(limit, 0, LIMIT_URLS)
    resumable = _status().isin(PENDING, PROCESSING, FAILED, SKIPPED) | _status().isNull()
    rows = df.filter(resumable & _url_filters(depth, seed))
    keys = [F.col("crawl_depth").asc_nulls_first(), resume_rank(), _created().asc_nulls_first()]
    return top_k(rows, keys, limit).select(*_URL_OUT, "status")


def urls_by_keyword(df: DataFrame, keyword_id: str | Column,
                    key_col: str = "keyword_id") -> DataFrame:
    """All URLs found for one keyword, oldest first (no limit)."""
    return (df.filter(F.col(key_col) == _lit(keyword_id))
            .orderBy(_created().asc_nulls_first(), F.col("id").asc_nulls_first())
            .select("id", "url", "status", F.col(key_col).alias("keyword_id")))


def profile_page(df: DataFrame, limit: int = LIMIT_PROFILES[0], offset: int = 0,
                 after: tuple | None = None) -> DataFrame:
    """One page of profiles, most recently updated first.

    ``after`` = (``updated_at``, ``id``) of the last row seen starts the page
    behind it.

    The original read also filters on a ``platform`` column that its table
    does not have; that predicate is dropped.
    """
    check_bounds(limit, offset, LIMIT_PROFILES)
    rows = df.filter(_after("updated_at", after))
    return top_k(rows, [F.col("updated_at").desc_nulls_last()], limit, offset).select(
        "id", "username", "title", "location")


def allowed_patch(patch: DataFrame, allowed: Iterable[str], key: str = "id") -> DataFrame:
    """Keep the key and the allowed columns of an update payload.

    Raises ``ValueError`` when the payload has none of the allowed columns.
    """
    allowed = list(allowed)
    keep = [c for c in patch.columns if c in allowed]
    if not keep:
        raise ValueError(f"no valid fields to update; allowed: {sorted(allowed)}")
    if key not in patch.columns:
        raise ValueError(f"update payload lacks key column {key!r}")
    return patch.select(key, *keep)


def seed_url_valid(url: Column | str, prefix: str, suffix: str) -> Column:
    """The URL starts with ``prefix`` and ends with ``suffix``."""
    u = F.col(url) if isinstance(url, str) else url
    return u.startswith(prefix) & u.endswith(suffix)
