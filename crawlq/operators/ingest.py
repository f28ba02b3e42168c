"""Composite ingest operators.

An ingest call of the original service takes one request payload.  Here a
call takes a DataFrame that may hold many requests at once, told apart by a
``batch`` column; decisions the service makes per request ("any conflict
rejects the whole request") are made per batch with an aggregate and a
join, never by collecting rows.  The per-request verdicts (one row per
request) are broadcast when their size is proven small and materialised
otherwise, so a request holding a third of all rows is split by AQE rather
than landing in one task.  Without a ``batch`` column the whole DataFrame
is one request; its verdict is a scalar subquery.

All batches of one call are checked against the same queue snapshot, as
concurrent requests would be; keyword requests can also be served one after
the other, each seeing what the accepted ones before it wrote (``in_order``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import (
    ACTION_COL, FRIEND_URL_BASE, KEYWORD_SITE_SUFFIX, MAX_CRAWL_DEPTH,
    SEED_URL_PREFIX, SEED_URL_SUFFIX,
)
from crawlq.functions import columns as C
from crawlq.operators import frontier, joins, merge
from crawlq.operators.request_order import decide_in_order
from crawlq.operators.queue_reads import seed_url_valid
from crawlq.plans import normalize as N

_ONE = "_batch"


def _batch_col(df: DataFrame, batch: str | None) -> tuple[DataFrame, str]:
    if batch is None:
        return df.withColumn(_ONE, F.lit(0)), _ONE
    return df, batch


def _judge(rows: DataFrame, bad_counts: DataFrame, batch: str,
           single: bool) -> tuple[DataFrame, DataFrame]:
    """Split ``rows`` into (rows of clean requests, rows of rejected requests).

    ``bad_counts`` has one row per request (``batch``, ``_bad``).  For one
    request the verdict is a scalar subquery.  For many, the verdicts are
    joined once (broadcast when their size is proven small, materialised
    otherwise, so a request holding a third of the rows is split by AQE)
    and the result is filtered both ways.
    """
    if single:
        bad = bad_counts.select(F.max("_bad")).scalar()
        return rows.filter(bad == 0), rows.filter(bad > 0)
    judged = rows.join(merge.join_side(bad_counts), batch, "inner")
    return (judged.filter(F.col("_bad") == 0).drop("_bad"),
            judged.filter(F.col("_bad") > 0).drop("_bad"))


# ------------------------------------------------------------------ keywords

def distinct_keywords(batch: DataFrame, col: str = "keyword", suffix: str = KEYWORD_SITE_SUFFIX,
                      batch_col: str | None = None) -> DataFrame:
    """D7 + I4: stripped, non-blank, distinct keywords (per batch), with the
    original text (``original``) and the stored form (``keyword`` = text +
    suffix)."""
    keys = [batch_col] if batch_col else []
    # distinct() over key columns only: a hash aggregate with map-side
    # combine; the stored form is derived after it.
    orig = batch.select(*keys, C.strip_text(col).alias("original"))
    uniq = orig.filter(F.col("original") != "").distinct()
    return uniq.withColumn("keyword", C.normalize_keyword("original", suffix))


def keyword_conflicts(batch: DataFrame, queue: DataFrame, col: str = "keyword",
                      suffix: str = KEYWORD_SITE_SUFFIX,
                      batch_col: str | None = None) -> DataFrame:
    """Per batch, how many distinct keywords already exist and how many are
    new, and the verdict ``all_exist`` / ``some_exist`` / ``all_new``.

    Any existing keyword rejects the whole batch (the first two verdicts).
    """
    kw = distinct_keywords(batch, col, suffix, batch_col)
    flagged = joins.key_exists(kw, queue.select("keyword"), "keyword")
    return _verdicts(flagged, [batch_col] if batch_col else [])


def _verdicts(flagged: DataFrame, keys: list[str]) -> DataFrame:
    out = flagged.groupBy(*keys).agg(
        F.count_if(F.col("exists")).alias("n_existing"),
        F.count_if(~F.col("exists")).alias("n_new"))
    verdict = (F.when(F.col("n_existing") == 0, F.lit("all_new"))
               .when(F.col("n_new") == 0, F.lit("all_exist"))
               .otherwise(F.lit("some_exist")))
    return out.withColumn("verdict", verdict)


def keyword_conflict_list(batch: DataFrame, queue: DataFrame, col: str = "keyword",
                          suffix: str = KEYWORD_SITE_SUFFIX,
                          batch_col: str | None = None) -> DataFrame:
    """The keywords behind :func:`keyword_conflicts`: one row per request
    and distinct keyword, with ``exists``."""
    kw = distinct_keywords(batch, col, suffix, batch_col)
    return joins.key_exists(kw, queue.select("keyword"), "keyword").select(
        *([batch_col] if batch_col else []), "original", "keyword", "exists")


def _with_ids(rows: DataFrame, id_expr: Column | None) -> DataFrame:
    """Rows with new random ids are stored once, so every later read sees the same ids."""
    return rows if id_expr is not None else merge.materialize(rows)


def _served_in_order(flagged: DataFrame, batch_col: str) -> DataFrame:
    """Keywords flagged against the queue, flagged again as each request finds
    them: ``exists`` also for a keyword of an earlier accepted request;
    ``accepted`` tells whether the request is.

    Accepted requests exclude each other, so a keyword has at most one writer:
    all rows meet only the writers, the rest is done on open requests."""
    flagged = merge.materialize(flagged)
    # A request that the queue itself rejects writes nothing, so nobody waits for it.
    known = merge.stored_side(flagged.where("exists").select(batch_col).distinct())
    open_rows = flagged.select(batch_col, "keyword").join(known, batch_col, "left_anti")
    decided = decide_in_order(open_rows, batch_col, "keyword")
    won = merge.stored_side(decided.where("accepted").select(batch_col))
    writer = merge.stored_side(flagged.join(won, batch_col, "left_semi").select("keyword", F.col(batch_col).alias("_writer")))
    return flagged.join(writer, "keyword", "left").withColumns({
        "exists": F.col("exists") | F.coalesce(F.col("_writer") < F.col(batch_col), F.lit(False)),
        "accepted": F.coalesce(F.col("_writer") == F.col(batch_col), F.lit(False))}).drop("_writer")


def keyword_conflicts_in_order(batch: DataFrame, queue: DataFrame, batch_col: str, col: str = "keyword",
                               suffix: str = KEYWORD_SITE_SUFFIX) -> DataFrame:
    """D8 for requests served one after the other in ascending ``batch_col``:
    counts and verdict as each request finds the queue, with what the accepted
    requests before it inserted."""
    kw = merge.materialize(distinct_keywords(batch, col, suffix, batch_col))
    served = _served_in_order(joins.key_exists(kw, queue.select("keyword"), "keyword"), batch_col)
    return _verdicts(served, [batch_col])


def create_keywords(batch: DataFrame, queue: DataFrame, col: str = "keyword",
                    suffix: str = KEYWORD_SITE_SUFFIX, batch_col: str | None = None,
                    now: Column | None = None, id_expr: Column | None = None,
                    in_order: bool = False) -> DataFrame:
    """Strip, drop blanks, de-duplicate, add the suffix, reject every
    batch holding a keyword that already exists, fill defaults (id, pending,
    start 0, stamps) and insert the rest if absent (key ``keyword``).

    ``in_order``: the batches are served one after the other in ascending
    ``batch_col``, and one that holds a keyword which an earlier accepted one
    inserted is rejected as well.  Otherwise all see the queue as it is, and
    a keyword of several batches is written once.  Batches without a value in
    ``batch_col`` have no place in the order and are rejected there.

    Returns the keyword queue with ``_action``; keywords of rejected batches
    appear as ``reject`` rows.
    """
    if in_order and batch_col is None:
        raise ValueError("requests in order need a batch column")
    # The request rows feed the key probe, the verdicts and both outcomes:
    # compute them once into the checkpoint folder.
    kw, b = _batch_col(distinct_keywords(batch, col, suffix, batch_col), batch_col)
    kw = merge.materialize(kw)
    flagged = joins.key_exists(kw, queue.select("keyword"), "keyword")
    if in_order:
        flagged = merge.materialize(_served_in_order(flagged, b))
        good, bad = flagged.where("accepted"), flagged.where("not accepted")
    else:
        counts = flagged.groupBy(b).agg(F.count_if(F.col("exists")).alias("_bad"))
        good, bad = _judge(flagged, counts, b, batch_col is None)
    # One row per keyword over all requests: a later request finds it written.
    rows = merge.cast_like(N.normalize_keyword_rows(good.select("keyword").distinct(), now, id_expr),
                           queue.schema)
    rows = _with_ids(rows, id_expr)
    # Kept batches hold no queued keyword (that is what kept them), so the
    # insert-if-absent anti join would pass every row: append them directly.
    merged = (queue.withColumn(ACTION_COL, F.lit(merge.KEEP))
              .unionByName(rows.select(*[c for c in rows.columns if c in queue.columns])
                           .withColumn(ACTION_COL, F.lit(merge.INSERT)),
                           allowMissingColumns=True))
    rejected = bad.select("keyword", F.lit(merge.REJECT).alias(ACTION_COL))
    return merged.unionByName(rejected, allowMissingColumns=True)


# --------------------------------------------------------------------- seeds

def create_seeds(batch: DataFrame, queue: DataFrame, col: str = "url",
                 prefix: str = SEED_URL_PREFIX, suffix: str = SEED_URL_SUFFIX,
                 check: bool = True, v1: bool = False, batch_col: str | None = None,
                 now: Column | None = None, id_expr: Column | None = None,
                 broadcast_max_rows: int | None = None) -> DataFrame:
    """Seed URLs; with ``check`` every URL of a batch must start with
    ``prefix`` and end with ``suffix`` or the whole batch is rejected (v1
    routes skip the check).  Defaults: id, pending, max_profiles 100 (not
    v1), stamps.  Inserted if the URL is absent; a URL of several batches
    goes in with the first of them, repeats in a batch all go in.  Returns the seed queue with ``_action`` (rejected URLs as
    ``reject``)."""
    rows, b = _batch_col(batch.select(*([batch_col] if batch_col else []),
                                      F.col(col).alias("url")), batch_col)
    if check:
        valid = F.coalesce(seed_url_valid("url", prefix, suffix), F.lit(False))
        counts = rows.groupBy(b).agg(F.count_if(~valid).alias("_bad"))
        good, bad = _judge(rows, counts, b, batch_col is None)
        rejected = bad.select("url", F.lit(merge.REJECT).alias(ACTION_COL))
    else:
        good, rejected = rows, None
    if batch_col is not None:
        # A url goes to the first request that has it; its repeats there all go in.
        first = good.groupBy(F.col("url").alias("_u")).agg(F.min(b).alias("_first"))
        good = good.join(first, (F.col("url") == F.col("_u")) & (F.col(b) == F.col("_first")))
    seeds = _with_ids(N.normalize_seed_rows(good.select("url"), now, id_expr, v1=v1), id_expr)
    merged = merge.insert_if_absent(queue, seeds, "url", broadcast_max_rows=broadcast_max_rows)
    if rejected is not None:
        merged = merged.unionByName(rejected, allowMissingColumns=True)
    return merged


# ---------------------------------------------------------------------- URLs

def enqueue_urls(batch: DataFrame, queue: DataFrame, platform: str = "social",
                 marker: str = "in", now: Column | None = None, id_expr: Column | None = None,
                 broadcast_max_rows: int | None = None) -> DataFrame:
    """URL rows get defaults (first platform: account_id derived from the
    URL when the column is absent), then are inserted if the account is not
    queued yet; repeats in the batch all go in."""
    rows = N.url_defaults(batch, now, id_expr, derive_account=platform == "pro", marker=marker)
    rows = _with_ids(rows, id_expr)
    return merge.insert_if_absent(queue, rows, "account_id", broadcast_max_rows=broadcast_max_rows)


# ------------------------------------------------------------------ profiles

def ingest_profile_pro(batch: DataFrame, profiles: DataFrame, mode: str = "single",
                       now: Column | None = None, id_expr: Column | None = None,
                       broadcast_max_rows: int | None = None) -> DataFrame:
    """First-platform profiles.  ``single``: normalise (P1) and upsert by
    account_id.  ``batch``: normalise and append (duplicates allowed)."""
    rows = _with_ids(N.normalize_profile_pro(batch, now, id_expr), id_expr)
    if mode == "single":
        return merge.upsert(profiles, rows, "account_id", broadcast_max_rows=broadcast_max_rows)
    if mode == "batch":
        return append_rows(profiles, rows)
    raise ValueError(f"unknown mode {mode!r}")


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A7 as a plan: the table plus the aligned, cast rows marked ``insert``.

    Columns the table lacks are dropped (reported by
    :func:`crawlq.operators.merge.dropped_columns`); rows are not checked
    against existing keys.
    """
    names = set(table.columns)
    aligned = merge.cast_like(rows.select(*[c for c in rows.columns if c in names]),
                              table.schema)
    return (table.withColumn(ACTION_COL, F.lit(merge.KEEP))
            .unionByName(aligned.withColumn(ACTION_COL, F.lit(merge.INSERT)),
                         allowMissingColumns=True))


def ingest_profile_social(batch: DataFrame, profiles: DataFrame, url_queue: DataFrame,
                          mode: str = "single", max_depth: int = MAX_CRAWL_DEPTH,
                          url_base: str = FRIEND_URL_BASE, now: Column | None = None,
                          id_expr: Column | None = None, order: str | None = None,
                          broadcast_max_rows: int | None = None
                          ) -> tuple[DataFrame, DataFrame]:
    """Second-platform profiles and their friends' URLs.

    ``single``: clean (P2), normalise (P3), insert if the account is absent.
    Every row is a request of its own, so the first of an account goes in (by
    the column ``order``, or by its values) and later ones find it written.
    ``batch``: normalise (P3) and append.  Rejected rows (no account_id or
    username) are marked ``reject`` in the profile result and expand nothing.
    Then the friend lists of the accepted rows are expanded into new URL
    rows (G1).

    Returns (profile table with ``_action``, URL queue with ``_action``).
    """
    incoming = N.clean_profile_social(batch) if mode == "single" else batch
    norm = _with_ids(N.normalize_profile_social(incoming, now, id_expr), id_expr)
    ok = N.valid_rows(norm)
    if mode == "single":
        prof = merge.insert_if_absent(profiles, ok, "account_id", dedupe=True,
                                      order=F.lit(0) if order is None else order,
                                      broadcast_max_rows=broadcast_max_rows)
    elif mode == "batch":
        prof = append_rows(profiles, ok)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    bad = N.rejected_rows(norm)
    prof = prof.unionByName(
        bad.select(F.col("account_id").cast("string"), F.lit(merge.REJECT).alias(ACTION_COL)),
        allowMissingColumns=True)
    # Accepted rows only; their normalised friend lists and depths give the
    # same edges as the raw ones (NULL items and missing depth are handled
    # the same way by the frontier).
    if "friend_lists" in batch.columns:
        urls = frontier.expand_frontier(ok, url_queue, max_depth=max_depth,
                                        url_base=url_base, now=now,
                                        broadcast_max_rows=broadcast_max_rows)
    else:
        urls = url_queue.withColumn(ACTION_COL, F.lit(merge.KEEP))
    return prof, urls
