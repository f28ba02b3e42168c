"""Frontier expansion from friend lists.

A profile's ``friend_lists`` array becomes one edge row per friend with
``explode``; edges whose next depth stays within ``max_depth`` become new
URL rows, inserted only for accounts the URL queue does not hold yet.

Scale: ``explode`` is a narrow operation (no shuffle).  The queued accounts
among the candidates are found from pre-aggregated key sets (a broadcast
semi join when the candidates are few), then removed by an anti join whose
two sides are plain shuffles, so a popular friend that appears in a third of
all lists is split by AQE's skew-join handling.  With ``dedupe=True`` the
candidates are first reduced to one row per account by a partial aggregate,
which also collapses hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import (
    DEFAULT_CRAWL_DEPTH, FRIEND_URL_BASE, MAX_CRAWL_DEPTH, PENDING,
)
from crawlq.functions import columns as C
from crawlq.operators import merge
from crawlq.plans.normalize import url_defaults


def friend_edges(profiles: DataFrame, account: str = "account_id",
                 friends: str = "friend_lists", depth: str = "crawl_depth",
                 order: str | None = None) -> DataFrame:
    """One row per (profile, friend).

    Output: ``parent_account_id`` (the profile), ``account_id`` (the friend,
    as text; NULL items stay NULL), ``parent_depth`` (missing or NULL depth
    reads as 1), ``_seq`` (the profile's ``order`` value, or its account,
    and the friend's position: the order in which a sequential writer would
    have seen the edge).
    """
    d = (C.depth_default(depth) if depth in profiles.columns
         else F.lit(DEFAULT_CRAWL_DEPTH).cast("long"))
    first = F.col(order) if order else F.col(account).cast("string")
    return (profiles
            .select(F.col(account).cast("string").alias("parent_account_id"),
                    d.alias("parent_depth"), first.alias("_o"),
                    F.posexplode(friends).alias("_pos", "account_id"))
            .select("parent_account_id", F.col("account_id").cast("string").alias("account_id"),
                    "parent_depth", F.struct("_o", "_pos").alias("_seq")))


def frontier_candidates(edges: DataFrame, max_depth: int = MAX_CRAWL_DEPTH,
                        url_base: str = FRIEND_URL_BASE, now: Column | None = None,
                        id_expr: Column | None = None) -> DataFrame:
    """URL rows for every edge whose next depth is at most ``max_depth``."""
    nxt = F.col("parent_depth") + 1
    rows = edges.filter(nxt <= max_depth).select(
        "account_id",
        F.concat(F.lit(url_base), F.col("account_id")).alias("url"),
        "parent_account_id",
        nxt.alias("crawl_depth"),
        F.lit("friend").alias("source_type"),
        F.lit(PENDING).alias("status"),
        "_seq",
    )
    return url_defaults(rows, now, id_expr)


def expand_frontier(profiles: DataFrame, url_queue: DataFrame, *,
                    max_depth: int = MAX_CRAWL_DEPTH, url_base: str = FRIEND_URL_BASE,
                    dedupe: bool = False, order: str | None = None,
                    now: Column | None = None, id_expr: Column | None = None,
                    edges: bool = False,
                    broadcast_max_rows: int | None = None) -> DataFrame:
    """G1: new URL rows for the friends of ``profiles``.

    Per friend: account_id = friend id, url = ``url_base`` + id, parent =
    the profile's account, depth = profile depth + 1 (missing depth -> 1),
    source ``friend``, status ``pending``; only when depth + 1 <= max_depth.
    No seed id is set.  Rows whose account is already queued are skipped;
    NULL friend ids are dropped; a friend shared by several profiles yields
    several rows unless ``dedupe`` keeps the first by ``_seq``.
    ``edges=True`` takes an edge table shaped like :func:`friend_edges`.

    Returns the merge output (queue rows ``keep`` + new rows ``insert``);
    :func:`crawlq.operators.merge.inserted_rows` gives only the new rows.
    """
    e = profiles if edges else friend_edges(profiles, order=order)
    cand = frontier_candidates(e, max_depth, url_base, now, id_expr)
    return merge.insert_if_absent(url_queue, cand, "account_id", dedupe=dedupe, order="_seq",
                                  broadcast_max_rows=broadcast_max_rows)
