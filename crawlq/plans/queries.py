"""Registered queries over the driver's test tables (see ``registry``).

Every query runs over the whole adapter tables.  Limits appear only where the
operator is a top-k read (queue reads with their default read limits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    LongType, StringType, StructField, StructType, TimestampNTZType,
)

from crawlq.constants import ALLOWED_SEED_PATCH
from crawlq.functions import columns, payloads, reports
from crawlq.operators import (
    counts, dealing, frontier, ingest, joins, merge, patch_log, queue_reads, stats,
)
from crawlq.plans import normalize
from crawlq.sources import pages, snapshots, tables
from crawlq.sources.schemas import table_schema
from crawlq.session import ensure_checkpoint_dir, scratch_path
from crawlq.streaming import stateful, stream
from crawlq.plans.registry import QUERIES, register
from crawlq.sources.fixtures import (
    ADAPTERS, FIXED_NOW_TEXT, HOST_PREFIX, KEYWORD_SUFFIX, SEED_SUFFIX, base_table, load_adapter,
    post_arrays, social_profiles, with_ctes,
)

# Seed whose lineage the flagship query traces.
LINEAGE_SEED = "7"

_LINEAGE_SELECT = (
    "SELECT l.account_id, l.parent_account_id, l.crawl_depth, l.seed_url_id, "
    "p.username, p.profile_image, p.created_at AS processed_at, "
    "'completed' AS status"
)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_adapter(spark, sf_dir, name)


# --------------------------------------------------------------------- joins

@register("lineage_profiles", with_ctes(
    f"{_LINEAGE_SELECT} FROM lin l JOIN profile p ON l.account_id = p.account_id",
    "url_queue", "profile",
    ctes=f"""
direct AS (SELECT account_id, parent_account_id, crawl_depth, seed_url_id FROM url_queue
           WHERE seed_url_id = '{LINEAGE_SEED}' AND status = 'completed'),
lin AS (SELECT * FROM direct
        UNION ALL
        SELECT account_id, parent_account_id, crawl_depth, seed_url_id FROM url_queue
        WHERE status = 'completed' AND parent_account_id IS NOT NULL
          AND parent_account_id IN (SELECT account_id FROM direct))"""))
def q_lineage_profiles(spark, sf_dir):
    """Profiles reached from seed 7: completed direct rows and their children."""
    return joins.lineage_profiles(_t(spark, sf_dir, "url_queue"),
                                  _t(spark, sf_dir, "profile"), LINEAGE_SEED)


@register("completed_profiles", with_ctes(
    "SELECT u.account_id, u.parent_account_id, u.crawl_depth, u.seed_url_id, "
    "p.username, p.profile_image, p.created_at AS processed_at, 'completed' AS status "
    "FROM url_queue u JOIN profile p ON u.account_id = p.account_id "
    "WHERE u.status = 'completed'",
    "url_queue", "profile"))
def q_completed_profiles(spark, sf_dir):
    """All completed URL rows joined to their profiles."""
    return joins.completed_profiles(_t(spark, sf_dir, "url_queue"),
                                    _t(spark, sf_dir, "profile"))


# --------------------------------------------------------------- queue reads

_NF = "ASC NULLS FIRST"
READ_OWNER = "ext_1"
SEED_OWNER = "ext_2"
URL_DEPTH, URL_SEED = 1, "3"


@register("queue_pending_unowned", with_ctes(
    "SELECT id, keyword, status, COALESCE(start, 0) AS start, extension_id FROM keyword_queue "
    "WHERE status = 'pending' AND (extension_id IS NULL OR extension_id = '') "
    f"ORDER BY created_at {_NF}, id {_NF} LIMIT 100", "keyword_queue"))
def q_queue_pending_unowned(spark, sf_dir):
    """Oldest 100 pending keywords without an owner."""
    return queue_reads.queue_pending_unowned(_t(spark, sf_dir, "keyword_queue"))


@register("queue_pending_or_owned", with_ctes(
    "SELECT id, keyword, status, COALESCE(start, 0) AS start, extension_id FROM keyword_queue "
    f"WHERE (status = 'processing' AND extension_id = '{READ_OWNER}') "
    "OR (status = 'pending' AND (extension_id IS NULL OR extension_id = '')) "
    "ORDER BY CASE WHEN status = 'processing' THEN 1 ELSE 2 END, "
    f"created_at {_NF}, id {_NF} LIMIT 100", "keyword_queue"))
def q_queue_pending_or_owned(spark, sf_dir):
    """100 keywords for one owner: its processing rows first, then unowned pending."""
    return queue_reads.queue_pending_or_owned(_t(spark, sf_dir, "keyword_queue"), READ_OWNER)


@register("seed_pending", with_ctes(
    "SELECT id, url, max_profiles, status, extension_id FROM seed_queue "
    f"WHERE (status = 'pending' OR status IS NULL) OR (status = 'processing' AND extension_id = '{SEED_OWNER}') "
    f"ORDER BY CASE WHEN status = 'processing' AND extension_id = '{SEED_OWNER}' THEN 0 ELSE 1 END, "
    f"created_at {_NF}, id {_NF} LIMIT 10", "seed_queue"))
def q_seed_pending(spark, sf_dir):
    """10 seeds for one owner: its processing seeds first, then pending/NULL by age."""
    return queue_reads.seed_pending(_t(spark, sf_dir, "seed_queue"), SEED_OWNER)


@register("seed_page", with_ctes(
    "SELECT id, url, max_profiles, status, extension_id, created_at, updated_at FROM seed_queue "
    f"ORDER BY created_at DESC NULLS LAST, id {_NF} LIMIT 100 OFFSET 20", "seed_queue"))
def q_seed_page(spark, sf_dir):
    """Second page (offset 20, 100 rows) of all seeds, newest first."""
    return queue_reads.seed_page(_t(spark, sf_dir, "seed_queue"), None, 100, 20)


@register("seed_page_after", with_ctes(
    "SELECT id, url, max_profiles, status, extension_id, created_at, updated_at FROM seed_queue "
    "WHERE created_at IS NULL OR created_at < TIMESTAMP '1995-06-17' "
    "OR (created_at = TIMESTAMP '1995-06-17' AND id > '5') "
    f"ORDER BY created_at DESC NULLS LAST, id {_NF} LIMIT 100", "seed_queue"))
def q_seed_page_after(spark, sf_dir):
    """The page of 100 seeds behind a given (created_at, id), newest first."""
    return queue_reads.seed_page(_t(spark, sf_dir, "seed_queue"), None, 100,
                                 after=(F.to_timestamp_ntz(F.lit("1995-06-17 00:00:00")), "5"))


@register("seed_page_failed", with_ctes(
    "SELECT id, url, max_profiles, status, extension_id, created_at, updated_at FROM seed_queue "
    f"WHERE status = 'failed' ORDER BY created_at DESC NULLS LAST, id {_NF} LIMIT 100",
    "seed_queue"))
def q_seed_page_failed(spark, sf_dir):
    """First page of failed seeds, newest first."""
    return queue_reads.seed_page(_t(spark, sf_dir, "seed_queue"), "failed")


_URL_COLS = "id, account_id, url, parent_account_id, crawl_depth, source_type, seed_url_id"


@register("url_pending", with_ctes(
    f"SELECT {_URL_COLS} FROM url_queue "
    f"WHERE (status = 'pending' OR status IS NULL) AND crawl_depth = {URL_DEPTH} AND seed_url_id = '{URL_SEED}' "
    f"ORDER BY crawl_depth {_NF}, created_at {_NF}, id {_NF} LIMIT 200", "url_queue"))
def q_url_pending(spark, sf_dir):
    """Pending URLs of depth 1 under seed 3 (filters bind to all rows)."""
    return queue_reads.url_pending(_t(spark, sf_dir, "url_queue"), URL_DEPTH, URL_SEED)


@register("url_pending_as_written", with_ctes(
    f"SELECT {_URL_COLS} FROM url_queue "
    f"WHERE status = 'pending' OR status IS NULL AND crawl_depth = {URL_DEPTH} AND seed_url_id = '{URL_SEED}' "
    f"ORDER BY crawl_depth {_NF}, created_at {_NF}, id {_NF} LIMIT 200", "url_queue"))
def q_url_pending_as_written(spark, sf_dir):
    """The pending-URL read with the original AND/OR precedence."""
    return queue_reads.url_pending_as_written(_t(spark, sf_dir, "url_queue"), URL_DEPTH, URL_SEED)


@register("url_pending_all", with_ctes(
    f"SELECT {_URL_COLS} FROM url_queue WHERE status = 'pending' OR status IS NULL "
    f"ORDER BY crawl_depth {_NF}, created_at {_NF}, id {_NF} LIMIT 200", "url_queue"))
def q_url_pending_all(spark, sf_dir):
    """Pending URLs with no depth / seed filter."""
    return queue_reads.url_pending(_t(spark, sf_dir, "url_queue"))


@register("url_resumable", with_ctes(
    f"SELECT {_URL_COLS}, status FROM url_queue "
    "WHERE (status = 'pending' OR status = 'processing' OR status = 'failed' OR status = 'skipped' OR status IS NULL) "
    "AND crawl_depth = 2 "
    f"ORDER BY crawl_depth {_NF}, CASE WHEN status = 'processing' THEN 0 WHEN status = 'failed' THEN 1 "
    "WHEN status = 'skipped' THEN 2 WHEN status = 'pending' OR status IS NULL THEN 3 ELSE 4 END, "
    f"created_at {_NF}, id {_NF} LIMIT 200", "url_queue"))
def q_url_resumable(spark, sf_dir):
    """Depth-2 URLs to resume, processing first, then failed, skipped, pending."""
    return queue_reads.url_resumable(_t(spark, sf_dir, "url_queue"), depth=2)


@register("urls_by_keyword", with_ctes(
    "SELECT id, url, status, seed_url_id AS keyword_id FROM url_queue WHERE seed_url_id = '3'",
    "url_queue"))
def q_urls_by_keyword(spark, sf_dir):
    """All URLs of one foreign key (seed_url_id stands in for keyword_id)."""
    return queue_reads.urls_by_keyword(_t(spark, sf_dir, "url_queue"), "3", key_col="seed_url_id")


@register("profile_page", with_ctes(
    "SELECT id, username, title, location FROM profile "
    f"ORDER BY updated_at DESC NULLS LAST, id {_NF} LIMIT 100 OFFSET 10", "profile"))
def q_profile_page(spark, sf_dir):
    """Profiles 11-110 by most recent update."""
    return queue_reads.profile_page(_t(spark, sf_dir, "profile"), 100, 10)


def _indexed(spark, df, order, limit, offset):
    path = scratch_path(spark, "pages")
    pages.write_pages(df, path, order)
    return pages.read_page(spark, path, df.schema, limit, offset)


@register("profile_page_indexed", with_ctes(
    "SELECT id, username, title, location FROM profile "
    f"ORDER BY updated_at DESC NULLS LAST, id {_NF} LIMIT 100 OFFSET 70", "profile"))
def q_profile_page_indexed(spark, sf_dir):
    """Profiles 71-170 by most recent update, read from the ranges that hold them."""
    order = [F.col("updated_at").desc_nulls_last(), F.col("id").asc_nulls_first()]
    return _indexed(spark, _t(spark, sf_dir, "profile"), order, 100, 70).select(
        "id", "username", "title", "location")


_DEAL_LIMIT = 5
_DEAL_SQL = with_ctes(
    "SELECT id, extension_id, place, fresh FROM kept UNION ALL SELECT r.id, s.extension_id, s.place, TRUE "
    "FROM r JOIN s ON r.n = s.n", "keyword_queue", "owner_patch",
    ctes=f"""
w AS (SELECT DISTINCT extension_id FROM owner_patch WHERE extension_id IS NOT NULL AND extension_id <> ''),
own AS (SELECT id, extension_id, row_number() OVER (PARTITION BY extension_id ORDER BY created_at {_NF}, id {_NF}) - 1 AS place
        FROM keyword_queue WHERE status = 'processing' AND extension_id IN (SELECT extension_id FROM w)),
kept AS (SELECT id, extension_id, place, FALSE AS fresh FROM own WHERE place < {_DEAL_LIMIT}),
held AS (SELECT w.extension_id, count(k.id) AS k FROM w LEFT JOIN kept k USING (extension_id) GROUP BY 1),
places AS (SELECT extension_id, CAST(i AS BIGINT) AS place, i - k AS turn
           FROM held, range({_DEAL_LIMIT}) t(i) WHERE i >= k),
s AS (SELECT *, row_number() OVER (ORDER BY turn, extension_id) AS n FROM places),
r AS (SELECT id, row_number() OVER (ORDER BY created_at {_NF}, id {_NF}) AS n FROM keyword_queue
      WHERE status = 'pending' AND coalesce(extension_id, '') = '')""")


@register("deal_work", _DEAL_SQL)
def q_deal_work(spark, sf_dir):
    """Keywords for every worker in one call: its own rows first, then unowned
    pending ones, dealt in turn."""
    return dealing.deal(_t(spark, sf_dir, "keyword_queue"), _t(spark, sf_dir, "owner_patch"), _DEAL_LIMIT)


# --------------------------------------------------------------------- stats

_SL = "COALESCE(NULLIF(status, ''), 'pending')"
_OL = "COALESCE(NULLIF(extension_id, ''), 'unassigned')"
_DL = "COALESCE(NULLIF(crawl_depth, 0), 1)"


@register("stats_by_owner", with_ctes(
    "SELECT status, extension_id, count(*) AS n FROM seed_queue GROUP BY status, extension_id",
    "seed_queue"))
def q_stats_by_owner(spark, sf_dir):
    """Seed rows per (status, owner)."""
    return stats.stats_by_owner(_t(spark, sf_dir, "seed_queue"))


@register("stats_by_depth", with_ctes(
    "SELECT status, crawl_depth, count(*) AS n FROM url_queue GROUP BY status, crawl_depth",
    "url_queue"))
def q_stats_by_depth(spark, sf_dir):
    """URL rows per (status, depth)."""
    return stats.stats_by_depth(_t(spark, sf_dir, "url_queue"))


@register("stats_profile_by_depth", with_ctes(
    "SELECT u.status, u.crawl_depth, count(*) AS n FROM url_queue u "
    "JOIN profile p ON u.account_id = p.account_id GROUP BY u.status, u.crawl_depth",
    "url_queue", "profile"))
def q_stats_profile_by_depth(spark, sf_dir):
    """Profiles per (status, depth) of their URL rows."""
    return stats.stats_profile_by_depth(_t(spark, sf_dir, "profile"), _t(spark, sf_dir, "url_queue"))


@register("stats_owner_rollup", with_ctes(
    f"SELECT {_SL} AS status, {_OL} AS extension_id, count(*) AS n FROM seed_queue "
    f"GROUP BY {_SL}, {_OL}", "seed_queue"))
def q_stats_owner_rollup(spark, sf_dir):
    """Seed rows per (status label, owner label)."""
    return stats.stats_owner_rollup(_t(spark, sf_dir, "seed_queue"))


@register("stats_depth_rollup", with_ctes(
    f"SELECT {_DL} AS crawl_depth, {_SL} AS status, count(*) AS n FROM url_queue "
    f"GROUP BY {_DL}, {_SL}", "url_queue"))
def q_stats_depth_rollup(spark, sf_dir):
    """URL rows per (depth label, status label)."""
    return stats.stats_depth_rollup(_t(spark, sf_dir, "url_queue"))


@register("stats_nested_rollup", with_ctes(
    "SELECT section, outer_label, inner_label, n, count(*) OVER (PARTITION BY section, outer_label) AS n_labels FROM ("
    f"SELECT 'seed_urls' AS section, {_SL} AS outer_label, {_OL} AS inner_label, count(*) AS n FROM seed_queue GROUP BY ALL UNION ALL "
    f"SELECT 'profile_urls', CAST({_DL} AS STRING), {_SL}, count(*) FROM url_queue GROUP BY ALL)", "seed_queue", "url_queue"))
def q_stats_nested_rollup(spark, sf_dir):
    """The map form of the roll-ups: one row per outer label, its map shown entry by entry with its size."""
    seeds = stats.nested_rollup(stats.stats_owner_rollup(_t(spark, sf_dir, "seed_queue")), "status", "extension_id")
    urls = stats.nested_rollup(stats.stats_depth_rollup(_t(spark, sf_dir, "url_queue")), "crawl_depth", "status")
    both = (seeds.select(F.lit("seed_urls").alias("section"), F.col("status").alias("outer_label"), "counts")
            .unionByName(urls.select(F.lit("profile_urls").alias("section"), F.col("crawl_depth").alias("outer_label"), "counts")))
    return both.select("section", "outer_label", F.size("counts").cast("long").alias("n_labels"),
                       F.explode("counts").alias("inner_label", "n"))


@register("stats_report", with_ctes(
    "SELECT 'seed_urls' AS section, status AS dim1, extension_id AS dim2, n FROM so "
    "UNION ALL SELECT 'profile_urls', CAST(crawl_depth AS STRING), status, n FROM ud "
    "UNION ALL SELECT 'profiles', CAST(crawl_depth AS STRING), status, n FROM pd "
    "UNION ALL SELECT 'seed_urls_v1', status, extension_id, n FROM so "
    "UNION ALL SELECT 'profile_urls_v1', CAST(crawl_depth AS STRING), status, n FROM ud",
    "seed_queue", "url_queue", "profile",
    ctes=f"""
so AS (SELECT {_SL} AS status, {_OL} AS extension_id, count(*) AS n FROM seed_queue GROUP BY 1, 2),
ud AS (SELECT {_DL} AS crawl_depth, {_SL} AS status, count(*) AS n FROM url_queue GROUP BY 1, 2),
pd AS (SELECT COALESCE(NULLIF(u.crawl_depth, 0), 1) AS crawl_depth,
              COALESCE(NULLIF(u.status, ''), 'pending') AS status, count(*) AS n
       FROM url_queue u JOIN profile p ON u.account_id = p.account_id GROUP BY 1, 2)"""))
def q_stats_report(spark, sf_dir):
    """All five roll-ups in long form (v1 tables are the same adapters)."""
    seeds, urls = _t(spark, sf_dir, "seed_queue"), _t(spark, sf_dir, "url_queue")
    return stats.stats_report(seeds, urls, _t(spark, sf_dir, "profile"), seeds, urls)


# -------------------------------------------------------------------- merges

NOW_SQL = f"TIMESTAMP '{FIXED_NOW_TEXT}'"


def _now():
    """The fixed batch stamp as a Spark column (timestamp without zone)."""
    return F.expr(f"TIMESTAMP_NTZ '{FIXED_NOW_TEXT}'")


_URLQ = ("id", "account_id", "seed_url_id", "parent_account_id", "crawl_depth", "url",
         "source_type", "status", "processed_at", "created_at", "updated_at")
_KWQ = ("id", "keyword", "extension_id", "start", "status", "processed_at", "created_at",
        "updated_at")
_PROF = ("id", "account_id", "username", "title", "location", "profile_image", "created_at",
         "updated_at")


def _cols(prefix, names, override=None):
    override = override or {}
    return ", ".join(override.get(c, f"{prefix}.{c}") + (f" AS {c}" if c in override else "")
                     for c in names)


def _null_cols(names, given):
    return ", ".join(given.get(c, "NULL") + f" AS {c}" for c in names)


_PATCHED = (
    f"SELECT {_cols('u', _URLQ, {'status': 'CASE WHEN p.id IS NOT NULL THEN p.status ELSE u.status END', 'processed_at': 'CASE WHEN p.id IS NOT NULL THEN COALESCE(p.processed_at, u.processed_at) ELSE u.processed_at END', 'updated_at': 'CASE WHEN p.id IS NOT NULL THEN p.updated_at ELSE u.updated_at END'})}, "
    "CASE WHEN p.id IS NOT NULL THEN 'update' ELSE 'keep' END AS _action "
    "FROM url_queue u LEFT JOIN p ON u.id = p.id "
    f"UNION ALL SELECT {_null_cols(_URLQ, {'id': 'p.id', 'status': 'p.status', 'processed_at': 'p.processed_at', 'updated_at': 'p.updated_at'})}, 'reject' "
    "FROM p WHERE NOT EXISTS (SELECT 1 FROM url_queue u WHERE u.id = p.id)")


@register("patch_status", with_ctes(
    _PATCHED, "url_queue", "status_patch",
    ctes=f"""p AS (SELECT id, status, CASE WHEN status = 'processing' THEN {NOW_SQL} END AS processed_at,
              {NOW_SQL} AS updated_at FROM status_patch)"""))
def q_patch_status(spark, sf_dir):
    """Status patches by id over url_queue; unknown ids rejected, processed_at
    stamped only for rows moving to processing."""
    return merge.patch_status(_t(spark, sf_dir, "url_queue"), _t(spark, sf_dir, "status_patch"),
                              _now())


@register("patch_status_repeated", with_ctes(
    _PATCHED, "url_queue", "user_patch",
    ctes=f"""p AS (SELECT id, arg_max(status, seq) AS status,
              CASE WHEN bool_or(status = 'processing') THEN {NOW_SQL} END AS processed_at,
              {NOW_SQL} AS updated_at FROM user_patch GROUP BY id)"""))
def q_patch_status_repeated(spark, sf_dir):
    """Many status patches per id, folded in their order: last status, and the
    stamp of any move to processing."""
    return merge.patch_status(_t(spark, sf_dir, "url_queue"), _t(spark, sf_dir, "user_patch"),
                              _now(), order="seq")


@register("affected_rows", with_ctes(
    "SELECT a AS _action, count(*) AS n FROM ("
    "SELECT CASE WHEN p.id IS NOT NULL THEN 'update' ELSE 'keep' END AS a "
    "FROM url_queue u LEFT JOIN status_patch p ON u.id = p.id "
    "UNION ALL SELECT 'reject' FROM status_patch p "
    "WHERE NOT EXISTS (SELECT 1 FROM url_queue u WHERE u.id = p.id)) GROUP BY a",
    "url_queue", "status_patch"))
def q_affected_rows(spark, sf_dir):
    """Rows per merge action of the status patch."""
    return merge.affected_rows(merge.patch_status(
        _t(spark, sf_dir, "url_queue"), _t(spark, sf_dir, "status_patch"), _now()))


@register("upsert", with_ctes(
    f"SELECT {_cols('t', _PROF, {'username': 'CASE WHEN s.account_id IS NOT NULL THEN s.username ELSE t.username END', 'location': 'CASE WHEN s.account_id IS NOT NULL THEN s.location ELSE t.location END'})}, "
    "CASE WHEN s.account_id IS NOT NULL THEN 'update' ELSE 'keep' END AS _action "
    "FROM profile t LEFT JOIN s ON t.account_id = s.account_id "
    f"UNION ALL SELECT {_null_cols(_PROF, {'account_id': 's.account_id', 'username': 's.username', 'location': 's.location'})}, 'insert' "
    "FROM s WHERE NOT EXISTS (SELECT 1 FROM profile t WHERE t.account_id = s.account_id)",
    "profile", "profile_patch",
    ctes="s AS (SELECT account_id, username, location FROM profile_patch WHERE account_id IS NOT NULL)"))
def q_upsert(spark, sf_dir):
    """Upsert by account_id: explicit NULLs overwrite, absent columns are kept,
    unknown columns dropped, NULL keys dropped, new keys inserted."""
    return merge.upsert(_t(spark, sf_dir, "profile"), _t(spark, sf_dir, "profile_patch"),
                        "account_id")


# Ties on seq are broken by the remaining row values in column order, as
# the library's first-per-key pick does.
_SEQ_ORDER = "seq, id, url, source_type, status, created_at, updated_at"

_BATCH_GIVEN = {c: f"b.{c}" for c in ("id", "account_id", "url", "source_type", "status",
                                      "created_at", "updated_at")}


@register("stats_report_maintained", with_ctes(
    "SELECT 'seed_urls' AS section, status AS dim1, extension_id AS dim2, n FROM so "
    "UNION ALL SELECT 'profile_urls', CAST(crawl_depth AS STRING), status, n FROM ud "
    "UNION ALL SELECT 'profiles', CAST(crawl_depth AS STRING), status, n FROM pd",
    "seed_queue", "url_queue", "profile", "status_patch", "profile_patch",
    ctes=f"""
u2 AS (SELECT u.account_id, u.crawl_depth, CASE WHEN p.id IS NOT NULL THEN p.status ELSE u.status END AS status
       FROM url_queue u LEFT JOIN status_patch p ON u.id = p.id),
p2 AS (SELECT account_id FROM profile UNION ALL SELECT account_id FROM profile_patch s WHERE account_id IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM profile t WHERE t.account_id = s.account_id)),
so AS (SELECT {_SL} AS status, {_OL} AS extension_id, count(*) AS n FROM seed_queue GROUP BY 1, 2),
ud AS (SELECT {_DL} AS crawl_depth, {_SL} AS status, count(*) AS n FROM u2 GROUP BY 1, 2),
pd AS (SELECT COALESCE(NULLIF(u.crawl_depth, 0), 1) AS crawl_depth,
              COALESCE(NULLIF(u.status, ''), 'pending') AS status, count(*) AS n
       FROM u2 u JOIN p2 p ON u.account_id = p.account_id GROUP BY 1, 2)"""))
def q_stats_report_maintained(spark, sf_dir):
    """The report of the tables before two merges, brought up to date by what the
    merges (status patches, a profile upsert) changed."""
    seeds, urls, profiles = (_t(spark, sf_dir, n) for n in ("seed_queue", "url_queue", "profile"))
    report = stats.stats_report(seeds, urls, profiles)
    patched = merge.patch_status(counts.tracked(urls, *counts.URL_COLS),
                                 _t(spark, sf_dir, "status_patch"), _now())
    upserted = merge.upsert(counts.tracked(profiles, *counts.PROFILE_COLS),
                            _t(spark, sf_dir, "profile_patch"), "account_id")
    return counts.maintained(
        report, counts.url_changes(patched),
        counts.profile_changes(patched, profiles, upserted, merge.table_rows(patched)))


@register("insert_if_absent", with_ctes(
    f"SELECT {_cols('u', _URLQ)}, 'keep' AS _action FROM url_queue u "
    f"UNION ALL SELECT {_null_cols(_URLQ, _BATCH_GIVEN)}, 'insert' FROM url_batch b "
    "WHERE b.account_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id)",
    "url_queue", "url_batch"))
def q_insert_if_absent(spark, sf_dir):
    """Insert batch rows whose account is new; repeats inside the batch all go in."""
    return merge.insert_if_absent(_t(spark, sf_dir, "url_queue"), _t(spark, sf_dir, "url_batch"),
                                  "account_id")


@register("insert_if_absent_dedupe", with_ctes(
    f"SELECT {_cols('u', _URLQ)}, 'keep' AS _action FROM url_queue u "
    f"UNION ALL SELECT {_null_cols(_URLQ, _BATCH_GIVEN)}, 'insert' FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY {_SEQ_ORDER}) AS rn FROM url_batch) b "
    "WHERE b.rn = 1 AND b.account_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id)",
    "url_queue", "url_batch"))
def q_insert_if_absent_dedupe(spark, sf_dir):
    """Insert-if-absent keeping only the first batch row per new account."""
    return merge.insert_if_absent(_t(spark, sf_dir, "url_queue"), _t(spark, sf_dir, "url_batch"),
                                  "account_id", dedupe=True, order="seq")


@register("insert_key_only", with_ctes(
    f"SELECT {_cols('u', _URLQ)}, 'keep' AS _action FROM url_queue u "
    f"UNION ALL SELECT {_null_cols(_URLQ, {'account_id': 'b.account_id'})}, 'insert' FROM "
    "(SELECT DISTINCT account_id FROM url_batch) b WHERE b.account_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id)",
    "url_queue", "url_batch"))
def q_insert_key_only(spark, sf_dir):
    """Key-only source: new accounts inserted with only the key set."""
    batch = _t(spark, sf_dir, "url_batch").select("account_id")
    return merge.upsert(_t(spark, sf_dir, "url_queue"), batch, "account_id")


def _kw_patch_sql(sets: dict) -> str:
    """Oracle for a keyword-queue patch: valid rows update known ids; unknown
    ids are rejected with their patch values; invalid rows rejected as given."""
    body = _cols("k", _KWQ, {c: f"CASE WHEN p.id IS NOT NULL THEN p.{c} ELSE k.{c} END"
                             for c in sets})
    unknown = {"id": "p.id", **{c: f"p.{c}" for c in sets}}
    return (
        f"SELECT {body}, CASE WHEN p.id IS NOT NULL THEN 'update' ELSE 'keep' END AS _action "
        "FROM keyword_queue k LEFT JOIN p ON k.id = p.id "
        f"UNION ALL SELECT {_null_cols(_KWQ, unknown)}, 'reject' FROM p "
        "WHERE NOT EXISTS (SELECT 1 FROM keyword_queue k WHERE k.id = p.id) "
        f"UNION ALL SELECT {_null_cols(_KWQ, {'id': 'o.id', 'extension_id': 'o.extension_id'})}, "
        f"'reject' FROM owner_patch o WHERE NOT ({_CLAIM_VALID})")


def _kw_patch_cte(sets: dict) -> str:
    vals = ", ".join(f"{v} AS {c}" for c, v in sets.items())
    return f"p AS (SELECT id, {vals} FROM owner_patch WHERE {_CLAIM_VALID})"


_CLAIM_VALID = ("id IS NOT NULL AND id <> '' AND extension_id IS NOT NULL "
                "AND extension_id <> ''")
_OWNER_SETS = {"extension_id": "extension_id", "updated_at": NOW_SQL}
_PROCESSING_SETS = {"status": "'processing'", "extension_id": "extension_id",
                    "processed_at": NOW_SQL, "updated_at": NOW_SQL}


@register("claim_owner", with_ctes(
    _kw_patch_sql(_OWNER_SETS), "keyword_queue", "owner_patch", ctes=_kw_patch_cte(_OWNER_SETS)))
def q_claim_owner(spark, sf_dir):
    """Owner claims by id: missing owner or unknown id rejected."""
    return merge.claim_owner(_t(spark, sf_dir, "keyword_queue"),
                             _t(spark, sf_dir, "owner_patch"), _now())


@register("claim_processing", with_ctes(
    _kw_patch_sql(_PROCESSING_SETS), "keyword_queue", "owner_patch",
    ctes=_kw_patch_cte(_PROCESSING_SETS)))
def q_claim_processing(spark, sf_dir):
    """Claims that also move the keyword to processing and stamp processed_at."""
    return merge.claim_processing(_t(spark, sf_dir, "keyword_queue"),
                                  _t(spark, sf_dir, "owner_patch"), _now())


_CURSOR_VALID = "id IS NOT NULL AND id <> '' AND current_start IS NOT NULL"


@register("advance_cursor", with_ctes(
    f"SELECT {_cols('k', _KWQ, {'start': 'CASE WHEN p.id IS NOT NULL THEN p.start ELSE k.start END', 'updated_at': 'CASE WHEN p.id IS NOT NULL THEN p.updated_at ELSE k.updated_at END'})}, "
    "CASE WHEN p.id IS NOT NULL THEN 'update' ELSE 'keep' END AS _action "
    "FROM keyword_queue k LEFT JOIN p ON k.id = p.id "
    f"UNION ALL SELECT {_null_cols(_KWQ, {'id': 'p.id', 'start': 'p.start', 'updated_at': 'p.updated_at'})}, 'reject' "
    "FROM p WHERE NOT EXISTS (SELECT 1 FROM keyword_queue k WHERE k.id = p.id) "
    f"UNION ALL SELECT {_null_cols(_KWQ, {'id': 'o.id', 'start': 'o.current_start'})}, 'reject' "
    f"FROM owner_patch o WHERE NOT ({_CURSOR_VALID})",
    "keyword_queue", "owner_patch",
    ctes=f"p AS (SELECT id, CAST(current_start AS BIGINT) AS start, {NOW_SQL} AS updated_at "
         f"FROM owner_patch WHERE {_CURSOR_VALID})"))
def q_advance_cursor(spark, sf_dir):
    """Paging-cursor moves by id: NULL cursor or unknown id rejected, 0 allowed."""
    return merge.advance_cursor(_t(spark, sf_dir, "keyword_queue"),
                                _t(spark, sf_dir, "owner_patch"), _now(), cursor="current_start")


_LOG_VALID = ("id IS NOT NULL AND id <> '' AND CASE kind WHEN 'status' THEN TRUE "
              "WHEN 'owner' THEN coalesce(extension_id, '') <> '' "
              "WHEN 'claim' THEN coalesce(extension_id, '') <> '' "
              "WHEN 'cursor' THEN start IS NOT NULL ELSE FALSE END")
_LOG_MOVE = "CASE kind WHEN 'claim' THEN 'processing' ELSE status END"


def _log_last(value: str, kinds: str) -> str:
    return f"max({{'o': seq, 'v': {value}}}) FILTER (kind IN ({kinds}))"


def _log_set(c: str, has: str, value: str | None = None) -> str:
    return f"CASE WHEN {has} THEN {value or 'p.' + c} ELSE k.{c} END"


_LOG_ORACLE = with_ctes(
    f"SELECT {_cols('k', _KWQ, {'status': _log_set('status', 'p.s IS NOT NULL', 'p.s.v'), 'extension_id': _log_set('extension_id', 'p.e IS NOT NULL', 'p.e.v'), 'start': _log_set('start', 'p.c IS NOT NULL', 'p.c.v'), 'processed_at': _log_set('processed_at', 'p.started', NOW_SQL), 'updated_at': _log_set('updated_at', 'p.id IS NOT NULL', NOW_SQL)})}, "
    "CASE WHEN p.id IS NOT NULL THEN 'update' ELSE 'keep' END AS _action "
    "FROM keyword_queue k LEFT JOIN p ON k.id = p.id "
    f"UNION ALL SELECT {_null_cols(_KWQ, {'id': 'p.id', 'status': 'p.s.v', 'extension_id': 'p.e.v', 'start': 'p.c.v', 'processed_at': f'CASE WHEN p.started THEN {NOW_SQL} END', 'updated_at': NOW_SQL})}, 'reject' "
    "FROM p WHERE NOT EXISTS (SELECT 1 FROM keyword_queue k WHERE k.id = p.id) "
    f"UNION ALL SELECT {_null_cols(_KWQ, {'id': 'id', 'status': 'status', 'extension_id': 'extension_id', 'start': 'start'})}, 'reject' "
    f"FROM patch_log WHERE NOT ({_LOG_VALID})",
    "keyword_queue", "patch_log",
    ctes=f"""p AS (SELECT id, {_log_last(_LOG_MOVE, "'status', 'claim'")} AS s,
              {_log_last('extension_id', "'owner', 'claim'")} AS e, {_log_last('start', "'cursor'")} AS c,
              coalesce(bool_or({_LOG_MOVE} = 'processing') FILTER (kind IN ('status', 'claim')), FALSE) AS started
       FROM patch_log WHERE {_LOG_VALID} GROUP BY id)""")


@register("patch_log", _LOG_ORACLE)
def q_patch_log(spark, sf_dir):
    """Mixed patches (status, owner, claim, cursor) of many ids, replayed in order."""
    return patch_log.replay(_t(spark, sf_dir, "keyword_queue"), _t(spark, sf_dir, "patch_log"),
                            "seq", _now())


# ------------------------------------------------------------ keyword ingest

_KW_TRIM = "trim(keyword)"
_KW_CTES = f"""
kw AS (SELECT DISTINCT batch_id, {_KW_TRIM} AS original,
              {_KW_TRIM} || '{KEYWORD_SUFFIX}' AS keyword
       FROM keyword_batch WHERE {_KW_TRIM} <> ''),
flag AS (SELECT kw.*, EXISTS (SELECT 1 FROM keyword_queue q WHERE q.keyword = kw.keyword) AS ex
         FROM kw),
cnt AS (SELECT batch_id, sum(CASE WHEN ex THEN 1 ELSE 0 END) AS n_existing,
               sum(CASE WHEN ex THEN 0 ELSE 1 END) AS n_new FROM flag GROUP BY batch_id)"""


def _kw_batch(spark, sf_dir):
    return _t(spark, sf_dir, "keyword_batch")


@register("distinct_keywords", with_ctes(
    "SELECT batch_id, original, keyword FROM kw", "keyword_batch", "keyword_queue",
    ctes=_KW_CTES))
def q_distinct_keywords(spark, sf_dir):
    """Stripped, non-blank, distinct keywords per request with the suffix."""
    return ingest.distinct_keywords(_kw_batch(spark, sf_dir), suffix=KEYWORD_SUFFIX,
                                    batch_col="batch_id")


@register("keyword_conflicts", with_ctes(
    "SELECT batch_id, CAST(n_existing AS BIGINT) AS n_existing, CAST(n_new AS BIGINT) AS n_new, "
    "CASE WHEN n_existing = 0 THEN 'all_new' WHEN n_new = 0 THEN 'all_exist' "
    "ELSE 'some_exist' END AS verdict FROM cnt", "keyword_batch", "keyword_queue", ctes=_KW_CTES))
def q_keyword_conflicts(spark, sf_dir):
    """Per request: existing vs new keywords and the verdict."""
    return ingest.keyword_conflicts(_kw_batch(spark, sf_dir), _t(spark, sf_dir, "keyword_queue"),
                                    suffix=KEYWORD_SUFFIX, batch_col="batch_id")


@register("keyword_conflict_list", with_ctes(
    "SELECT batch_id, original, keyword, ex AS exists FROM flag", "keyword_batch", "keyword_queue",
    ctes=_KW_CTES))
def q_keyword_conflict_list(spark, sf_dir):
    """Per request: its distinct keywords, each existing or new."""
    return ingest.keyword_conflict_list(_kw_batch(spark, sf_dir), _t(spark, sf_dir, "keyword_queue"),
                                        suffix=KEYWORD_SUFFIX, batch_col="batch_id")


@register("create_keywords", with_ctes(
    f"SELECT DISTINCT f.keyword, 'pending' AS status, CAST(0 AS INTEGER) AS start, {NOW_SQL} AS created_at, "
    f"{NOW_SQL} AS updated_at, 'insert' AS _action FROM flag f JOIN cnt c ON f.batch_id = c.batch_id "
    "WHERE c.n_existing = 0 "
    "UNION ALL SELECT f.keyword, NULL, NULL, NULL, NULL, 'reject' FROM flag f "
    "JOIN cnt c ON f.batch_id = c.batch_id WHERE c.n_existing > 0",
    "keyword_batch", "keyword_queue", ctes=_KW_CTES))
def q_create_keywords(spark, sf_dir):
    """Keyword requests: whole request rejected on any known keyword, others
    inserted with defaults (rows other than kept queue rows; ids omitted)."""
    out = ingest.create_keywords(_kw_batch(spark, sf_dir), _t(spark, sf_dir, "keyword_queue"),
                                 suffix=KEYWORD_SUFFIX, batch_col="batch_id", now=_now())
    return out.filter(F.col("_action") != "keep").select(
        "keyword", "status", "start", "created_at", "updated_at", "_action")


# Requests served one after the other, as a fold: the state is the keywords
# written so far and the marks of those who wrote them; a request that holds a
# queued or a written keyword writes nothing.  Of requests with the same
# keywords only the first can write.
_IN_ORDER_CTES = _KW_CTES + """,
req AS (SELECT kws, min(batch_id) AS batch_id
        FROM (SELECT batch_id, list_sort(list(keyword)) AS kws FROM flag GROUP BY batch_id HAVING NOT bool_or(ex)) GROUP BY kws),
state AS (SELECT list_reduce(list(list_append(kws, '#' || batch_id) ORDER BY batch_id),
                             lambda a, b: CASE WHEN list_has_any(a, b) THEN a ELSE list_concat(a, b) END) AS written FROM req),
won AS (SELECT batch_id FROM req WHERE '#' || batch_id IN (SELECT unnest(written) FROM state)),
writer AS (SELECT f.keyword, f.batch_id FROM flag f JOIN won w ON w.batch_id = f.batch_id),
found AS (SELECT f.batch_id, f.keyword, f.ex OR coalesce(w.batch_id < f.batch_id, false) AS ex,
                 f.batch_id IN (SELECT batch_id FROM won) AS ok
          FROM flag f LEFT JOIN writer w ON w.keyword = f.keyword)"""


@register("keyword_conflicts_in_order", with_ctes(
    "SELECT batch_id, count(*) FILTER (ex) AS n_existing, count(*) FILTER (NOT ex) AS n_new, "
    "CASE WHEN NOT bool_or(ex) THEN 'all_new' WHEN bool_and(ex) THEN 'all_exist' ELSE 'some_exist' END AS verdict "
    "FROM found GROUP BY batch_id", "keyword_batch", "keyword_queue", ctes=_IN_ORDER_CTES))
def q_keyword_conflicts_in_order(spark, sf_dir):
    """Per request, served in order: existing vs new keywords and the verdict."""
    return ingest.keyword_conflicts_in_order(_kw_batch(spark, sf_dir), _t(spark, sf_dir, "keyword_queue"),
                                             "batch_id", suffix=KEYWORD_SUFFIX)


@register("create_keywords_in_order", with_ctes(
    "SELECT 'keep' AS _action, NULL AS keyword, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM keyword_queue "
    "UNION ALL SELECT CASE WHEN ok THEN 'insert' ELSE 'reject' END, keyword, count(*), CASE WHEN ok THEN count(*) ELSE 0 END "
    "FROM found GROUP BY ok, keyword", "keyword_batch", "keyword_queue", ctes=_IN_ORDER_CTES))
def q_create_keywords_in_order(spark, sf_dir):
    """Keyword requests served in order: kept rows, and inserts and rejects of each keyword, with their distinct ids."""
    out = ingest.create_keywords(_kw_batch(spark, sf_dir), _t(spark, sf_dir, "keyword_queue"),
                                 suffix=KEYWORD_SUFFIX, batch_col="batch_id", now=_now(), in_order=True)
    kept = F.col("_action") == "keep"
    return (out.groupBy("_action", F.when(~kept, F.col("keyword")).alias("keyword"))
            .agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids")))


_SEED_OK = f"url LIKE '{HOST_PREFIX}%' AND url LIKE '%{SEED_SUFFIX}'"


@register("create_seeds", with_ctes(
    f"SELECT b.url, 'pending' AS status, CAST(100 AS BIGINT) AS max_profiles, {NOW_SQL} AS created_at, "
    f"{NOW_SQL} AS updated_at, 'insert' AS _action FROM seed_batch b "
    "WHERE b.batch_id NOT IN (SELECT batch_id FROM bad) "
    "AND NOT EXISTS (SELECT 1 FROM seed_queue q WHERE q.url = b.url) "
    "AND b.batch_id = (SELECT min(x.batch_id) FROM seed_batch x WHERE x.url = b.url AND x.batch_id NOT IN (SELECT batch_id FROM bad)) "
    "UNION ALL SELECT url, NULL, NULL, NULL, NULL, 'reject' FROM seed_batch "
    "WHERE batch_id IN (SELECT batch_id FROM bad)",
    "seed_batch", "seed_queue",
    ctes=f"bad AS (SELECT DISTINCT batch_id FROM seed_batch WHERE NOT COALESCE({_SEED_OK}, false))"))
def q_create_seeds(spark, sf_dir):
    """Seed requests: whole request rejected on one malformed URL; new URLs
    inserted with defaults, repeats inside a request all inserted."""
    out = ingest.create_seeds(_t(spark, sf_dir, "seed_batch"), _t(spark, sf_dir, "seed_queue"),
                              prefix=HOST_PREFIX, suffix=SEED_SUFFIX, batch_col="batch_id",
                              now=_now())
    return out.filter(F.col("_action") != "keep").select(
        "url", "status", "max_profiles", "created_at", "updated_at", "_action")


def _counts_sql(created: str, key: str, queue: str) -> str:
    """Rows per action, distinct ids and keys; ``created`` selects the key and _action of the inserts and rejects."""
    return (f"SELECT 'keep' AS _action, count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT {key}) AS n_keys "
            f"FROM {queue} UNION ALL SELECT _action, count(*), CASE WHEN _action = 'insert' THEN count(*) ELSE 0 END, "
            f"count(DISTINCT {key}) FROM ({created}) GROUP BY _action")


def _action_counts(out: DataFrame, key: str) -> DataFrame:
    return out.groupBy("_action").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"),
                                      F.count_distinct(key).alias("n_keys"))


@register("create_keywords_counts", with_ctes(_counts_sql(
    "SELECT DISTINCT f.keyword, 'insert' AS _action FROM flag f JOIN cnt c ON f.batch_id = c.batch_id WHERE c.n_existing = 0 "
    "UNION ALL SELECT f.keyword, 'reject' FROM flag f JOIN cnt c ON f.batch_id = c.batch_id WHERE c.n_existing > 0",
    "keyword", "keyword_queue"), "keyword_batch", "keyword_queue", ctes=_KW_CTES))
def q_create_keywords_counts(spark, sf_dir):
    """What keyword requests leave in the queue, kept rows included: rows, distinct ids and keywords per action."""
    return _action_counts(ingest.create_keywords(
        _kw_batch(spark, sf_dir), _t(spark, sf_dir, "keyword_queue"), suffix=KEYWORD_SUFFIX, batch_col="batch_id", now=_now()), "keyword")


@register("create_seeds_counts", with_ctes(_counts_sql(
    "SELECT b.url, 'insert' AS _action FROM seed_batch b WHERE b.batch_id NOT IN (SELECT batch_id FROM bad) "
    "AND NOT EXISTS (SELECT 1 FROM seed_queue q WHERE q.url = b.url) "
    "AND b.batch_id = (SELECT min(x.batch_id) FROM seed_batch x WHERE x.url = b.url AND x.batch_id NOT IN (SELECT batch_id FROM bad)) "
    "UNION ALL SELECT url, 'reject' FROM seed_batch WHERE batch_id IN (SELECT batch_id FROM bad)", "url", "seed_queue"),
    "seed_batch", "seed_queue",
    ctes=f"bad AS (SELECT DISTINCT batch_id FROM seed_batch WHERE NOT COALESCE({_SEED_OK}, false))"))
def q_create_seeds_counts(spark, sf_dir):
    """What seed requests leave in the queue, kept rows included: rows, distinct ids and URLs per action."""
    return _action_counts(ingest.create_seeds(
        _t(spark, sf_dir, "seed_batch"), _t(spark, sf_dir, "seed_queue"), prefix=HOST_PREFIX, suffix=SEED_SUFFIX,
        batch_col="batch_id", now=_now()), "url")


@register("enqueue_urls", with_ctes(
    f"SELECT id, url, account_id, 'pending' AS status, {NOW_SQL} AS created_at, "
    f"{NOW_SQL} AS updated_at FROM pu WHERE account_id IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM url_queue u WHERE u.account_id = pu.account_id)",
    "page_url", "url_queue",
    ctes="""pu AS (SELECT id, url, CASE WHEN url IS NOT NULL AND url <> '' THEN
  split_part(split_part(string_split(regexp_replace(url, '/+$', ''), '/')[
    list_position(string_split(regexp_replace(url, '/+$', ''), '/'), 'en') + 1], '?', 1), '#', 1)
  END AS account_id FROM page_url)"""))
def q_enqueue_urls(spark, sf_dir):
    """First-platform URL batch: account derived from the URL (marker 'en'),
    inserted when the account is not queued."""
    out = ingest.enqueue_urls(_t(spark, sf_dir, "page_url"), _t(spark, sf_dir, "url_queue"),
                              platform="pro", marker="en", now=_now())
    return merge.inserted_rows(out).select("id", "url", "account_id", "status",
                                           "created_at", "updated_at")


# -------------------------------------------------------------------- frontier

def _edges(spark, sf_dir):
    e = _t(spark, sf_dir, "friend_edge")
    return e.select(F.col("account_id").alias("parent_account_id"),
                    F.col("friend_id").alias("account_id"),
                    F.col("crawl_depth").alias("parent_depth"),
                    F.struct("edge_seq").alias("_seq"))


_FRONTIER_SELECT = (
    "SELECT e.friend_id AS account_id, 'https://host.example/' || e.friend_id AS url, "
    "e.account_id AS parent_account_id, e.crawl_depth + 1 AS crawl_depth, "
    "'friend' AS source_type, 'pending' AS status")
_FRONTIER_WHERE = (
    "e.crawl_depth + 1 <= 3 AND e.friend_id IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM url_queue u WHERE u.account_id = e.friend_id)")
_FRONTIER_OUT = ("account_id", "url", "parent_account_id", "crawl_depth", "source_type", "status")


@register("expand_frontier", with_ctes(
    f"{_FRONTIER_SELECT} FROM friend_edge e WHERE {_FRONTIER_WHERE}", "friend_edge", "url_queue"))
def q_expand_frontier(spark, sf_dir):
    """New depth+1 URL rows for friends not yet queued (repeats kept)."""
    out = frontier.expand_frontier(_edges(spark, sf_dir), _t(spark, sf_dir, "url_queue"),
                                   url_base=HOST_PREFIX, edges=True, now=_now())
    return merge.inserted_rows(out).select(*_FRONTIER_OUT)


@register("expand_frontier_dedupe", with_ctes(
    f"{_FRONTIER_SELECT} FROM (SELECT *, row_number() OVER (PARTITION BY friend_id ORDER BY edge_seq) AS rn "
    f"FROM friend_edge WHERE crawl_depth + 1 <= 3) e WHERE e.rn = 1 AND {_FRONTIER_WHERE}",
    "friend_edge", "url_queue"))
def q_expand_frontier_dedupe(spark, sf_dir):
    """Frontier keeping only the first edge per new friend account."""
    out = frontier.expand_frontier(_edges(spark, sf_dir), _t(spark, sf_dir, "url_queue"),
                                   url_base=HOST_PREFIX, edges=True, dedupe=True, now=_now())
    return merge.inserted_rows(out).select(*_FRONTIER_OUT)


_SP_DEPTH = "COALESCE(CAST(crawl_depth AS BIGINT), 1)"


@register("friend_edges", with_ctes(
    f"SELECT account_id AS parent_account_id, f1 AS account_id, {_SP_DEPTH} AS parent_depth "
    "FROM social_profile UNION ALL "
    f"SELECT account_id, f2, {_SP_DEPTH} FROM social_profile", "social_profile"))
def q_friend_edges(spark, sf_dir):
    """Friend lists exploded into (profile, friend) edges; NULL items kept."""
    return frontier.friend_edges(social_profiles(spark, sf_dir)).select(
        "parent_account_id", "account_id", "parent_depth")


# ---------------------------------------------------------- social profiles

_SOCIAL_CTES = """
c AS (SELECT *, CASE WHEN account_id IN ('None','null','undefined','') THEN NULL ELSE account_id END AS acc,
             CASE WHEN username IN ('None','null','undefined','') THEN NULL ELSE username END AS usr
      FROM social_profile),
v AS (SELECT *, CASE WHEN account_id IS NULL OR account_id = '' THEN 'account_id is required'
                     WHEN acc IS NULL OR acc = '' THEN 'account_id is required'
                     WHEN usr IS NULL OR usr = '' THEN 'username is required' END AS reason FROM c)"""


@register("normalize_profile_social", with_ctes(
    "SELECT acc AS account_id, COALESCE(usr, '') AS username, COALESCE(gender, '') AS gender, "
    f"{_SP_DEPTH} AS crawl_depth, concat_ws(',', f1, f2) AS friends, reason AS _reject_reason FROM v",
    "social_profile", ctes=_SOCIAL_CTES))
def q_normalize_profile_social(spark, sf_dir):
    """Clean + normalise incoming social profiles; invalid rows get a reason."""
    norm = normalize.normalize_profile_social(
        normalize.clean_profile_social(social_profiles(spark, sf_dir)), _now())
    return norm.select("account_id", "username", "gender", "crawl_depth",
                       F.array_join("friend_lists", ",").alias("friends"), "_reject_reason")


@register("ingest_profile_social", with_ctes(
    f"SELECT acc AS account_id, usr AS username, {NOW_SQL} AS created_at, 'insert' AS _action FROM v "
    "WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM profile p WHERE p.account_id = v.acc) "
    "UNION ALL SELECT acc, NULL, NULL, 'reject' FROM v WHERE reason IS NOT NULL",
    "social_profile", "profile", ctes=_SOCIAL_CTES))
def q_ingest_profile_social(spark, sf_dir):
    """Social profiles inserted if absent; rejected rows reported."""
    prof, _ = ingest.ingest_profile_social(
        social_profiles(spark, sf_dir), _t(spark, sf_dir, "profile"),
        _t(spark, sf_dir, "url_queue"), url_base=HOST_PREFIX, now=_now())
    return prof.filter(F.col("_action") != "keep").select(
        "account_id", "username", "created_at", "_action")


@register("ingest_profile_social_urls", with_ctes(
    "SELECT e.f AS account_id, 'https://host.example/' || e.f AS url, e.account_id AS parent_account_id, "
    "e.d + 1 AS crawl_depth, 'friend' AS source_type, 'pending' AS status FROM "
    f"(SELECT account_id, f1 AS f, {_SP_DEPTH} AS d FROM v WHERE reason IS NULL "
    f" UNION ALL SELECT account_id, f2, {_SP_DEPTH} FROM v WHERE reason IS NULL) e "
    "WHERE e.d + 1 <= 3 AND e.f IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM url_queue u WHERE u.account_id = e.f)",
    "social_profile", "url_queue", ctes=_SOCIAL_CTES))
def q_ingest_profile_social_urls(spark, sf_dir):
    """Friend URLs created by a social-profile ingest (accepted rows only)."""
    _, urls = ingest.ingest_profile_social(
        social_profiles(spark, sf_dir), _t(spark, sf_dir, "profile"),
        _t(spark, sf_dir, "url_queue"), url_base=HOST_PREFIX, now=_now())
    return merge.inserted_rows(urls).select(*_FRONTIER_OUT)


_POST_TIME = ("CASE WHEN time IS NOT NULL AND TRY_CAST(time AS TIMESTAMP) IS NULL "
              "THEN '2025-01-01T00:00:00+00:00' ELSE time END")
_POST_KEY = "account_id"
_POST_ACTION = "CASE WHEN account_id IN (SELECT account_id FROM profile) THEN 'update' ELSE 'insert' END"


@register("ingest_profile_pro", with_ctes(
    f"SELECT {_POST_KEY} AS account_id, content, {_POST_TIME} AS time, {_POST_ACTION} AS _action "
    "FROM post WHERE turn % 7 <> 6", "post", "profile"))
def q_ingest_profile_pro(spark, sf_dir):
    """Professional profiles upserted by account; post times checked (one row
    per post of the updated and inserted profiles)."""
    target = _t(spark, sf_dir, "profile").withColumn(
        "posts", F.lit(None).cast("array<struct<content:string,time:string>>"))
    out = ingest.ingest_profile_pro(post_arrays(spark, sf_dir), target, now=_now())
    ins = out.filter(F.col("_action") != "keep")
    return ins.select("account_id", "_action", F.explode("posts").alias("p")).select(
        "account_id", "p.content", "p.time", "_action")


@register("post_time_iso", with_ctes(
    f"SELECT {_POST_KEY} AS account_id, turn, {_POST_TIME} AS time FROM post WHERE turn % 7 <> 6",
    "post"))
def q_post_time_iso(spark, sf_dir):
    """Post times: ISO text kept, other text replaced by the batch time."""
    arr = post_arrays(spark, sf_dir).select(
        "account_id", columns.post_time_iso("posts", _now()).alias("posts"))
    return arr.select("account_id", F.posexplode("posts").alias("i", "p")).filter(
        F.col("p").isNotNull()).select(
        "account_id", F.col("p.time").alias("time"),
        # the turn: its position in the sorted conversation
        F.col("i").cast("long").alias("turn"),
    )


@register("normalize_struct_array", with_ctes(
    f"SELECT {_POST_KEY} AS account_id, COALESCE(content, '') AS content, "
    "COALESCE(time, '') AS time FROM post WHERE turn % 7 <> 6", "post"))
def q_normalize_struct_array(spark, sf_dir):
    """Post arrays: NULL items dropped, missing values as ''."""
    arr = post_arrays(spark, sf_dir).select(
        "account_id", columns.normalize_struct_array("posts", ("content", "time")).alias("p"))
    return arr.select("account_id", F.explode("p").alias("p")).select(
        "account_id", "p.content", "p.time")


@register("compact_string_array", with_ctes(
    "SELECT account_id, f1 AS friend FROM social_profile WHERE f1 IS NOT NULL "
    "UNION ALL SELECT account_id, f2 FROM social_profile WHERE f2 IS NOT NULL", "social_profile"))
def q_compact_string_array(spark, sf_dir):
    """Friend lists with NULL items removed (one row per kept item)."""
    sp = social_profiles(spark, sf_dir)
    return sp.select("account_id",
                     F.explode(columns.compact_string_array("friend_lists")).alias("friend"))


# ---------------------------------------------------------- scalar functions

_LIT_NULLS = "('None', 'null', 'undefined', '')"


@register("nullify_literals", with_ctes(
    "SELECT account_id, username, "
    f"CASE WHEN account_id IN {_LIT_NULLS} THEN NULL ELSE account_id END AS account_id_clean, "
    f"CASE WHEN username IN {_LIT_NULLS} THEN NULL ELSE username END AS username_clean "
    "FROM profile_raw", "profile_raw"))
def q_nullify_literals(spark, sf_dir):
    """Literal 'None'/'null'/'undefined'/'' values become NULL."""
    df = _t(spark, sf_dir, "profile_raw")
    return df.select("account_id", "username",
                     columns.nullify_literals("account_id").alias("account_id_clean"),
                     columns.nullify_literals("username").alias("username_clean"))


@register("text_or_empty", with_ctes(
    "SELECT account_id, COALESCE(gender, '') AS gender FROM profile_raw", "profile_raw"))
def q_text_or_empty(spark, sf_dir):
    """NULL text fields become ''."""
    df = _t(spark, sf_dir, "profile_raw")
    return df.select("account_id", columns.text_or_empty("gender").alias("gender"))


@register("depth_default", with_ctes(
    "SELECT account_id, COALESCE(CAST(crawl_depth AS BIGINT), 1) AS crawl_depth FROM profile_raw",
    "profile_raw"))
def q_depth_default(spark, sf_dir):
    """Text crawl depth as an integer, NULL read as 1."""
    df = _t(spark, sf_dir, "profile_raw")
    return df.select("account_id", columns.depth_default("crawl_depth").alias("crawl_depth"))


@register("flatten_about", with_ctes(
    "SELECT account_id, turn, CASE WHEN about IS NULL THEN '' "
    "WHEN ltrim(about) LIKE '[%' AND json_valid(about) "
    "THEN array_to_string(from_json(about, '[\"VARCHAR\"]'), ' ') "
    "WHEN ltrim(about) LIKE '{%' AND regexp_matches(about, '^\\s*\\{\\s*\\}\\s*$') THEN '' "
    "ELSE about END AS about FROM about_raw", "about_raw"))
def q_flatten_about(spark, sf_dir):
    """Free-form about values (JSON arrays, objects, text, NULL) as text."""
    df = _t(spark, sf_dir, "about_raw")
    return df.select("account_id", "turn", columns.flatten_about("about").alias("about"))


# ------------------------------------------- payloads whose kind changes by row

# A payload's kind; json_valid passes what DuckDB itself can read.
_KIND = ("CASE WHEN payload IS NULL THEN 'missing' WHEN NOT json_valid(payload) THEN 'malformed' "
         "ELSE CASE json_type(payload) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' "
         "WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END")
_KINDS_CTE = f"p AS (SELECT event_id, payload, {_KIND} AS kind FROM payload)"
_ITEMS_CTE = (f"{_KINDS_CTE}, a AS (SELECT event_id, CAST(json_extract(payload, '$[*]') AS JSON[]) AS items FROM p WHERE kind = 'array'), "
              "x AS (SELECT event_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM a)")


def _truthy_sql(field: str) -> str:
    v = f"json_extract_string(item, '$.{field}')"
    return (f"CASE WHEN json_type(item, '$.{field}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({v} AS DOUBLE) = 0 THEN '' "
            f"ELSE COALESCE({v}, '') END")


@register("payload_kinds", with_ctes("SELECT event_id, kind FROM p", "payload", ctes=_KINDS_CTE))
def q_payload_kinds(spark, sf_dir):
    """The JSON kind of every payload, broken and missing ones told apart."""
    return _t(spark, sf_dir, "payload").select("event_id", payloads.payload_kind("payload").alias("kind"))


@register("payload_items", with_ctes(
    "SELECT event_id, CAST(pos AS INTEGER) AS pos, json_extract_string(item, '$') AS text FROM x", "payload", ctes=_ITEMS_CTE))
def q_payload_items(spark, sf_dir):
    """The items of array payloads as text; other kinds have none."""
    items = _t(spark, sf_dir, "payload").select("event_id", F.posexplode(payloads.payload_array("payload")).alias("pos", "item"))
    return items.select("event_id", "pos", payloads.value_text(F.col("item")).alias("text"))


@register("payload_records", with_ctes(
    f"SELECT event_id, {_truthy_sql('title')} AS title, {_truthy_sql('time')} AS time FROM x WHERE json_type(item) = 'OBJECT'",
    "payload", ctes=_ITEMS_CTE))
def q_payload_records(spark, sf_dir):
    """The record items of array payloads, missing and empty fields as ''."""
    rows = _t(spark, sf_dir, "payload").select(
        "event_id", F.explode(payloads.payload_struct_array("payload", ("title", "time"))).alias("r"))
    return rows.select("event_id", "r.title", "r.time")


@register("payload_about", with_ctes(
    "SELECT event_id, CASE kind WHEN 'missing' THEN '' "
    "WHEN 'object' THEN CASE WHEN CAST(json(payload) AS VARCHAR) = '{}' THEN '' ELSE CAST(json(payload) AS VARCHAR) END "
    "WHEN 'array' THEN array_to_string(list_transform(CAST(json_extract(payload, '$[*]') AS JSON[]), "
    "lambda i: CASE WHEN json_type(i) = 'NULL' THEN 'None' ELSE json_extract_string(i, '$') END), ' ') "
    "ELSE payload END AS about FROM p", "payload", ctes=_KINDS_CTE))
def q_payload_about(spark, sf_dir):
    """Free-form text of payloads of every kind."""
    return _t(spark, sf_dir, "payload").select("event_id", payloads.payload_about("payload").alias("about"))


@register("load_nested_checked", with_ctes(
    "SELECT event_id, CASE WHEN kind = 'object' THEN TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) END AS k, "
    "CASE WHEN kind = 'object' THEN json_extract_string(payload, '$.user') END AS user, kind AS _payload_kind, "
    "CASE WHEN kind = 'object' AND json_extract_string(payload, '$.k') IS NOT NULL "
    "AND TRY_CAST(json_extract_string(payload, '$.k') AS BIGINT) IS NULL THEN 'k' ELSE '' END AS bad FROM p",
    "payload", ctes=_KINDS_CTE))
def q_load_nested_checked(spark, sf_dir):
    """Payloads read under a declared schema, with what could not be read."""
    schema = StructType([StructField("k", LongType()), StructField("user", StringType())])
    out = payloads.load_nested_checked(_t(spark, sf_dir, "payload"), schema, "payload", keep=["event_id"])
    return out.withColumn("bad", F.array_join(payloads.BAD_FIELDS_COL, ",")).drop(payloads.BAD_FIELDS_COL)


_ACC = ("CASE WHEN url IS NOT NULL AND url <> '' THEN split_part(split_part("
        "string_split(regexp_replace(url, '/+$', ''), '/')["
        "list_position(string_split(regexp_replace(url, '/+$', ''), '/'), 'en') + 1], '?', 1), '#', 1) END")


@register("account_from_url", with_ctes(
    f"SELECT id, url, {_ACC} AS account_id FROM page_url", "page_url"))
def q_account_from_url(spark, sf_dir):
    """Account token after the 'en' path segment of every page URL."""
    df = _t(spark, sf_dir, "page_url")
    return df.select("id", "url", columns.account_from_url("url", "en").alias("account_id"))


@register("seed_url_valid", with_ctes(
    "SELECT id, url, COALESCE(url LIKE 'https://%' AND url LIKE '%/', false) AS valid FROM page_url",
    "page_url"))
def q_seed_url_valid(spark, sf_dir):
    """Prefix/suffix URL check over every page URL ('https://' ... '/')."""
    df = _t(spark, sf_dir, "page_url")
    ok = F.coalesce(queue_reads.seed_url_valid("url", "https://", "/"), F.lit(False))
    return df.select("id", "url", ok.alias("valid"))


@register("required_fields_ok", with_ctes(
    "SELECT id, (id IS NOT NULL AND created_at IS NOT NULL AND updated_at IS NOT NULL "
    "AND url IS NOT NULL AND status IS NOT NULL) AS ok FROM url_queue", "url_queue"))
def q_required_fields_ok(spark, sf_dir):
    """Required URL columns (id, stamps, url, status) present per row."""
    df = _t(spark, sf_dir, "url_queue")
    return df.select("id", columns.required_fields_ok("urls", df.columns).alias("ok"))


@register("split_valid", with_ctes(
    "SELECT id, 'missing required fields' AS _reject_reason FROM url_queue "
    "WHERE NOT (id IS NOT NULL AND created_at IS NOT NULL AND updated_at IS NOT NULL "
    "AND url IS NOT NULL AND status IS NOT NULL)", "url_queue"))
def q_split_valid(spark, sf_dir):
    """URL rows rejected by the required-field rule, with the reason."""
    df = _t(spark, sf_dir, "url_queue")
    marked = normalize.split_valid(df, {"missing required fields":
                                        columns.required_fields_ok("urls", df.columns)})
    return normalize.rejected_rows(marked).select("id", "_reject_reason")


def _json_field(name: str, kind: str) -> str:
    """DuckDB text of one JSON field as Spark's ``to_json`` writes it."""
    if kind == "ts":
        val = f"'\"' || strftime({name}, '%Y-%m-%dT%H:%M:%S.%f') || '\"'"
    else:
        val = f"to_json({name})::VARCHAR"
    return f"'\"{name}\":' || COALESCE({val}, 'null')"


_PROFILE_JSON = [("id", "s"), ("account_id", "s"), ("username", "s"), ("title", "s"),
                 ("location", "s"), ("profile_image", "s"), ("created_at", "ts"),
                 ("updated_at", "ts")]


@register("json_ready", with_ctes(
    "SELECT '{' || " + " || ',' || ".join(_json_field(n, k) for n, k in _PROFILE_JSON)
    + " || '}' AS json FROM profile", "profile"))
def q_json_ready(spark, sf_dir):
    """Profile rows as JSON text with ISO timestamps and explicit nulls."""
    return columns.json_ready(_t(spark, sf_dir, "profile"))


# -------------------------------------------------------------------- joins

@register("parent_in", with_ctes(
    "SELECT id, account_id, parent_account_id FROM url_queue u WHERE u.parent_account_id IS NOT NULL "
    "AND u.parent_account_id IN (SELECT account_id FROM profile)", "url_queue", "profile"))
def q_parent_in(spark, sf_dir):
    """URL rows whose parent account has a profile (semi join)."""
    urls = _t(spark, sf_dir, "url_queue").select("id", "account_id", "parent_account_id")
    return joins.parent_in(urls, _t(spark, sf_dir, "profile"))


@register("not_exists", with_ctes(
    "SELECT id, account_id FROM profile p WHERE NOT EXISTS "
    "(SELECT 1 FROM url_queue u WHERE u.account_id = p.account_id)", "url_queue", "profile"))
def q_not_exists(spark, sf_dir):
    """Profiles with no URL row (anti join)."""
    prof = _t(spark, sf_dir, "profile").select("id", "account_id")
    return joins.not_exists(prof, _t(spark, sf_dir, "url_queue"), "account_id")


@register("not_exists_batch", with_ctes(
    "SELECT id, account_id FROM url_batch b WHERE NOT EXISTS "
    "(SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id)", "url_batch", "url_queue"))
def q_not_exists_batch(spark, sf_dir):
    """Incoming URL rows of accounts that are not queued yet (anti join; about half of them are)."""
    rows = _t(spark, sf_dir, "url_batch").select("id", "account_id")
    return joins.not_exists(rows, _t(spark, sf_dir, "url_queue"), "account_id")


@register("key_exists", with_ctes(
    "SELECT b.account_id, b.url, EXISTS (SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id) "
    "AS exists FROM (SELECT DISTINCT account_id, url FROM url_batch) b", "url_batch", "url_queue"))
def q_key_exists(spark, sf_dir):
    """Each distinct batch account flagged by whether it is already queued."""
    batch = _t(spark, sf_dir, "url_batch").select("account_id", "url").distinct()
    return joins.key_exists(batch, _t(spark, sf_dir, "url_queue"), "account_id")


# ------------------------------------------------------------- error reports

def _title_sql(expr: str) -> str:
    """DuckDB title-casing of space-separated words (Spark's ``initcap``)."""
    return (f"array_to_string(list_transform(string_split(lower({expr}), ' '), "
            "lambda w: upper(w[1]) || w[2:]), ' ')")


_DETAIL_CTES = """
base AS (SELECT id, 'error_type' AS key, error_type AS value, 1 AS pos FROM error_report
         WHERE error_type IS NOT NULL AND error_type <> ''
         UNION ALL SELECT id, 'url', url, 2 FROM error_report WHERE url IS NOT NULL AND url <> ''),
ctx AS (SELECT id, k AS key, json_extract_string(additional_context, '$."' || k || '"') AS value,
               100 + idx AS pos
        FROM (SELECT id, additional_context, unnest(json_keys(additional_context)) AS k,
                     generate_subscripts(json_keys(additional_context), 1) AS idx FROM error_report) x),
details AS (SELECT b.id, b.key, COALESCE(c.value, b.value) AS value, b.pos FROM base b
            LEFT JOIN ctx c ON b.id = c.id AND b.key = c.key
            UNION ALL SELECT c.id, c.key, c.value, c.pos FROM ctx c
            WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = c.id AND b.key = c.key))"""


def _error_reports(spark, sf_dir):
    return _t(spark, sf_dir, "error_report")


def _details_col():
    return reports.error_details("error_type", "url", F.lit(None).cast("string"),
                                 reports.context_map("additional_context"))


@register("error_subject", with_ctes(
    "SELECT id, title || ' Error' || CASE WHEN platform IS NOT NULL AND platform <> '' "
    f"THEN ' - ' || {_title_sql('platform')} ELSE '' END || "
    "CASE WHEN extension_id IS NOT NULL AND extension_id <> '' THEN ' (' || extension_id || ')' "
    "ELSE '' END AS subject FROM error_report", "error_report"))
def q_error_subject(spark, sf_dir):
    """Mail subject of every error report."""
    df = _error_reports(spark, sf_dir)
    return df.select("id", reports.error_subject("title", "platform", "extension_id")
                     .alias("subject"))


@register("error_details", with_ctes(
    "SELECT id, key, value FROM details", "error_report", ctes=_DETAIL_CTES))
def q_error_details(spark, sf_dir):
    """Detail entries of every report (error type, url, then the context;
    context keys override in place)."""
    df = _error_reports(spark, sf_dir)
    return df.select("id", F.explode(_details_col()).alias("key", "value"))


@register("error_text", with_ctes(
    "SELECT r.id, r.title || ' Error Report\n' || repeat('=', length(r.title) + 13) || "
    "'\n\nError Message:\n' || r.error_message || '\n\nDetails:\n--------\nTimestamp: ' || "
    "strftime(r.reported_at, '%Y-%m-%d %H:%M:%S') || '\n' || "
    "CASE WHEN r.platform IS NOT NULL AND r.platform <> '' THEN 'Platform: ' || "
    f"{_title_sql('r.platform')} || '\n' ELSE '' END || "
    "CASE WHEN r.extension_id IS NOT NULL AND r.extension_id <> '' THEN 'Extension ID: ' || "
    "r.extension_id || '\n' ELSE '' END || "
    "CASE WHEN l.lines IS NOT NULL THEN '\nAdditional Information:\n' || repeat('-', 25) || '\n' "
    "|| l.lines ELSE '' END || "
    "'\n--\nThis error report was automatically generated by the Extension Error.\n"
    "Please investigate and resolve the issue as soon as possible.' AS text "
    "FROM error_report r LEFT JOIN lines l ON r.id = l.id",
    "error_report",
    ctes=_DETAIL_CTES + """,
lines AS (SELECT id, string_agg(""" + _title_sql("replace(key, '_', ' ')") +
    """ || ': ' || COALESCE(value, 'None') || '\n', '' ORDER BY pos) AS lines
          FROM details GROUP BY id)"""))
def q_error_text(spark, sf_dir):
    """Plain-text body of every error report, stamped with its report time."""
    df = _error_reports(spark, sf_dir)
    return df.select("id", reports.error_text("title", "error_message", "extension_id",
                                              "platform", _details_col(),
                                              F.col("reported_at")).alias("text"))


_AGENT = "CASE WHEN CAST({id} AS BIGINT) % 3 = 0 THEN NULL WHEN CAST({id} AS BIGINT) % 3 = 1 THEN '' ELSE 'agent/' || {id} END"
_AGENT_LINE = f"COALESCE('User Agent: ' || NULLIF({_AGENT.format(id='r.id')}, '') || '\n', '') || "


@register("error_text_user_agent", QUERIES["error_text"].oracle.replace(
    "CASE WHEN l.lines IS NOT NULL", _AGENT_LINE + "CASE WHEN l.lines IS NOT NULL"))
def q_error_text_user_agent(spark, sf_dir):
    """Report bodies with the user agent's line, for missing, empty and given agents."""
    df = _error_reports(spark, sf_dir).withColumn("user_agent", F.expr(_AGENT.format(id="id")))
    return df.select("id", reports.error_text("title", "error_message", "extension_id", "platform", _details_col(),
                                              F.col("reported_at"), "user_agent").alias("text"))


# ----------------------------------------------------------------- streaming

def _event_stream(spark, sf_dir):
    # Registered queries run in test harnesses: fall back to a scratch
    # checkpoint folder only when the session names none.
    ensure_checkpoint_dir(spark)
    events = base_table(spark, sf_dir, "events")
    return stream.file_stream(spark, sf_dir, events.schema, glob="events.parquet")


@register("stream_append", with_ctes("SELECT * FROM error_report", "error_report"))
def q_stream_append(spark, sf_dir):
    """Error reports shaped from an event file stream, landed by a streaming
    query (available-now trigger, checkpointed) and read back."""
    reports_stream = spark.sql(ADAPTERS["error_report"], events=_event_stream(spark, sf_dir))
    return stream.stream_append(spark, reports_stream)


@register("stream_upsert", QUERIES["patch_status"].oracle)
def q_stream_upsert(spark, sf_dir):
    """Status patches arriving as a stream, landed, folded in their
    order of arrival and merged into url_queue."""
    patches = spark.sql(ADAPTERS["status_patch"], events=_event_stream(spark, sf_dir))
    return stream.stream_upsert(
        spark, _t(spark, sf_dir, "url_queue"), patches,
        lambda target, p: merge.patch_status(target, p, _now()), key="id")


@register("stream_upsert_repeated", QUERIES["patch_status_repeated"].oracle)
def q_stream_upsert_repeated(spark, sf_dir):
    """Many streamed status patches per id, landed and folded in their order."""
    patches = spark.sql(ADAPTERS["user_patch"], events=_event_stream(spark, sf_dir))
    return stream.stream_upsert(
        spark, _t(spark, sf_dir, "url_queue"), patches,
        lambda target, p: merge.patch_status(target, p, _now()), key="id", order="seq")


@register("stream_patch_log", _LOG_ORACLE)
def q_stream_patch_log(spark, sf_dir):
    """The same patches as a stream, folded in the state store and merged from it."""
    log = spark.sql(ADAPTERS["patch_log"], events=_event_stream(spark, sf_dir))
    return stateful.stream_patch_log(spark, _t(spark, sf_dir, "keyword_queue"), log, "seq", _now())


# ----------------------------------------------------------- sources / sinks

@register("snapshot_merge", with_ctes(
    f"SELECT {', '.join(_URLQ)} FROM ({_PATCHED}) WHERE _action <> 'reject'", "url_queue", "status_patch",
    ctes=f"""p AS (SELECT id, status, CASE WHEN status = 'processing' THEN {NOW_SQL} END AS processed_at,
              {NOW_SQL} AS updated_at FROM status_patch)"""))
def q_snapshot_merge(spark, sf_dir):
    """url_queue written in key buckets, merged with status patches bucket by
    bucket, and the new version read back."""
    root = scratch_path(spark, "url-queue")
    snapshots.create(_t(spark, sf_dir, "url_queue"), root, "id", buckets=16)
    snapshots.merge_into(spark, root, _t(spark, sf_dir, "status_patch"),
                         lambda target, p: merge.patch_status(target, p, _now()))
    return snapshots.read(spark, root)


_URLS_OK = "url IS NOT NULL AND status IS NOT NULL AND created_at IS NOT NULL AND updated_at IS NOT NULL"


@register("append_exactly_once", with_ctes(
    f"SELECT {', '.join(_URLQ)}, CASE WHEN NOT ({_URLS_OK}) THEN 'missing required fields' END AS _reject_reason "
    "FROM url_queue", "url_queue"))
def q_append_exactly_once(spark, sf_dir):
    """URL rows appended as one batch, twice: the table's one copy and the rows
    left out, with their reason, as both are read back."""
    urls, root = _t(spark, sf_dir, "url_queue"), scratch_path(spark, "urls")
    snapshots.create(urls.limit(0), root, "id", buckets=16)
    for _ in range(2):
        done = snapshots.append(spark, root, urls, "requests", 1, "urls")
    left_out = snapshots.read_rejects(spark, root, done)
    return (snapshots.read(spark, root).withColumn("_reject_reason", F.lit(None).cast("string"))
            .unionByName(left_out))


@register("scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def q_scan(spark, sf_dir):
    """Declared-schema scan of a parquet table with a column list."""
    schema = StructType([StructField("o_orderkey", LongType()),
                         StructField("o_orderstatus", StringType()),
                         StructField("o_orderdate", TimestampNTZType())])
    return tables.scan(spark, f"{sf_dir}/orders.parquet", schema, ["o_orderkey", "o_orderstatus"])


@register("load_flat", with_ctes(
    "SELECT id, account_id, url, source_type, status, created_at, updated_at FROM url_batch",
    "url_batch"))
def q_load_flat(spark, sf_dir):
    """Flat batch load keeping the URL-table columns (batch-only ones dropped)."""
    cols = [f.name for f in table_schema("social", "urls").fields]
    return tables.load_flat(_t(spark, sf_dir, "url_batch"), cols)


@register("load_nested", with_ctes(
    "SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS account_id, "
    "CAST(NULL AS STRING) AS url, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, "
    "1 + o_orderkey % 3 AS crawl_depth FROM orders", "url_json"))
def q_load_nested(spark, sf_dir):
    """JSON rows parsed under the declared URL schema: unknown fields ignored,
    missing ones NULL."""
    out = tables.load_nested(_t(spark, sf_dir, "url_json"), table_schema("social", "urls"))
    return out.select("id", "account_id", "url", "status", "crawl_depth")


@register("allowed_patch", with_ctes(
    "SELECT id, extension_id FROM owner_patch", "owner_patch"))
def q_allowed_patch(spark, sf_dir):
    """Seed update payload reduced to the key and the allowed columns
    (status, extension_id)."""
    return queue_reads.allowed_patch(_t(spark, sf_dir, "owner_patch"), ALLOWED_SEED_PATCH)


@register("merge_match", with_ctes(
    "SELECT u.id FROM url_queue u WHERE u.id IN (SELECT id FROM status_patch)",
    "url_queue", "status_patch"))
def q_merge_match(spark, sf_dir):
    """Target keys matched by a merge source (NULL never matches)."""
    patch = _t(spark, sf_dir, "status_patch")
    return merge.matched_keys(_t(spark, sf_dir, "url_queue").select("id"), patch, "id",
                              small=merge.is_small(patch))


@register("drop_null_keys", with_ctes(
    "SELECT count(*) FILTER (WHERE account_id IS NULL) AS n FROM profile_patch", "profile_patch"))
def q_drop_null_keys(spark, sf_dir):
    """Number of merge-source rows dropped for a NULL key."""
    return merge.null_key_count(_t(spark, sf_dir, "profile_patch"), "account_id")


@register("insert_if_absent_sequential", with_ctes(
    f"SELECT {_cols('u', _URLQ)}, 'keep' AS _action FROM url_queue u "
    f"UNION ALL SELECT {_null_cols(_URLQ, _BATCH_GIVEN)}, 'insert' FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY {_SEQ_ORDER}) AS rn FROM b2) b "
    "WHERE (b.rn = 1 OR b.account_id IS NULL) AND NOT EXISTS "
    "(SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id)",
    "url_queue", "url_batch",
    ctes="b2 AS (SELECT id, CASE WHEN seq % 13 = 0 THEN NULL ELSE account_id END AS account_id, url, "
         "source_type, status, seq, created_at, updated_at FROM url_batch)"))
def q_insert_if_absent_sequential(spark, sf_dir):
    """The small-batch path's rule (first row per new key wins, NULL keys
    always go in), applied to the whole batch in one job."""
    b = _t(spark, sf_dir, "url_batch").withColumn(
        "account_id", F.when(F.col("seq") % 13 == 0, F.lit(None)).otherwise(F.col("account_id")))
    return merge.insert_if_absent(_t(spark, sf_dir, "url_queue"), b, "account_id",
                                  dedupe=True, keep_null_keys=True, order="seq")


@register("insert_if_absent_bulk", with_ctes(
    f"SELECT {_cols('u', _URLQ)}, 'keep' AS _action FROM url_queue u "
    f"UNION ALL SELECT {_null_cols(_URLQ, _BATCH_GIVEN)}, 'insert' FROM b2 b "
    "WHERE NOT EXISTS (SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id)",
    "url_queue", "url_batch",
    ctes="b2 AS (SELECT id, CASE WHEN seq % 13 = 0 THEN NULL ELSE account_id END AS account_id, url, "
         "source_type, status, seq, created_at, updated_at FROM url_batch)"))
def q_insert_if_absent_bulk(spark, sf_dir):
    """The bulk path's rule: NULL keys and in-batch repeats all go in."""
    b = _t(spark, sf_dir, "url_batch").withColumn(
        "account_id", F.when(F.col("seq") % 13 == 0, F.lit(None)).otherwise(F.col("account_id")))
    return merge.insert_if_absent(_t(spark, sf_dir, "url_queue"), b, "account_id",
                                  keep_null_keys=True)


_ISO = ("strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microseconds', created_at) "
        "% 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(date_part('microseconds', created_at) % 1000000 "
        "AS VARCHAR), 6, '0') END || '+00:00'")


@register("iso_format", with_ctes(f"SELECT id, {_ISO} AS created_at FROM url_queue", "url_queue"))
def q_iso_format(spark, sf_dir):
    """Creation stamps as ISO-8601 text."""
    df = _t(spark, sf_dir, "url_queue")
    return df.select("id", columns.iso_format("created_at").alias("created_at"))


@register("transform_and_validate", with_ctes(
    "SELECT id, account_id, url, CASE WHEN status IS NULL THEN 'missing required fields' END "
    "AS _reject_reason FROM b2", "url_batch",
    ctes="b2 AS (SELECT id, account_id, url, CASE WHEN seq % 17 = 0 THEN NULL ELSE status END AS status "
         "FROM url_batch)"))
def q_transform_and_validate(spark, sf_dir):
    """URL rows through the table's normaliser, then the required-field check."""
    b = _t(spark, sf_dir, "url_batch").select(
        "id", "account_id", "url",
        F.when(F.col("seq") % 17 == 0, F.lit(None)).otherwise(F.col("status")).alias("status"))
    out = normalize.transform_and_validate(b, "social", "urls", _now())
    return out.select("id", "account_id", "url", "_reject_reason")


@register("ingest_profile_pro_batch", QUERIES["ingest_profile_pro"].oracle.replace(_POST_ACTION, "'insert'"))
def q_ingest_profile_pro_batch(spark, sf_dir):
    """Professional profiles appended as a batch (no key check); one row per
    post of the appended profiles."""
    target = _t(spark, sf_dir, "profile").withColumn(
        "posts", F.lit(None).cast("array<struct<content:string,time:string>>"))
    out = ingest.ingest_profile_pro(post_arrays(spark, sf_dir), target, mode="batch", now=_now())
    ins = out.filter(F.col("_action") == "insert")
    return ins.select("account_id", "_action", F.explode("posts").alias("p")).select(
        "account_id", "p.content", "p.time", "_action")


# -------------------------------------- the same merges on the large-source path
# Broadcasting switched off: the source is materialised into the checkpoint
# folder and joined by shuffles (the plan a cluster-sized source gets).

@register("patch_status_large_source", QUERIES["patch_status"].oracle)
def q_patch_status_large_source(spark, sf_dir):
    """Status patches merged on the shuffle path (no broadcast)."""
    return merge.patch_status(_t(spark, sf_dir, "url_queue"), _t(spark, sf_dir, "status_patch"),
                              _now(), broadcast_max_rows=0)


@register("upsert_large_source", QUERIES["upsert"].oracle)
def q_upsert_large_source(spark, sf_dir):
    """Upsert by account_id on the shuffle path (no broadcast)."""
    return merge.upsert(_t(spark, sf_dir, "profile"), _t(spark, sf_dir, "profile_patch"),
                        "account_id", source_small=False)


@register("insert_if_absent_large_source", QUERIES["insert_if_absent"].oracle)
def q_insert_if_absent_large_source(spark, sf_dir):
    """Insert-if-absent on the shuffle path (no broadcast)."""
    return merge.insert_if_absent(_t(spark, sf_dir, "url_queue"), _t(spark, sf_dir, "url_batch"),
                                  "account_id", source_small=False)


@register("expand_frontier_large_source", QUERIES["expand_frontier"].oracle)
def q_expand_frontier_large_source(spark, sf_dir):
    """Frontier expansion on the shuffle path (no broadcast)."""
    out = frontier.expand_frontier(_edges(spark, sf_dir), _t(spark, sf_dir, "url_queue"),
                                   url_base=HOST_PREFIX, edges=True, now=_now(),
                                   broadcast_max_rows=0)
    return merge.inserted_rows(out).select(*_FRONTIER_OUT)


@register("key_exists_large_source", QUERIES["key_exists"].oracle)
def q_key_exists_large_source(spark, sf_dir):
    """Batch key probe on the shuffle path (no broadcast)."""
    batch = _t(spark, sf_dir, "url_batch").select("account_id", "url").distinct()
    return joins.key_exists(batch, _t(spark, sf_dir, "url_queue"), "account_id", small=False)


@register("insert_counts", with_ctes(
    "SELECT CAST(count(*) AS BIGINT) AS inserted, "
    "CAST((SELECT count(account_id) FROM url_batch) - count(*) AS BIGINT) AS skipped, "
    "CAST((SELECT count(*) FROM url_batch WHERE account_id IS NULL) AS BIGINT) AS null_keys "
    "FROM url_batch b WHERE b.account_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM url_queue u WHERE u.account_id = b.account_id)", "url_queue", "url_batch"))
def q_insert_counts(spark, sf_dir):
    """Inserted / skipped / NULL-key counts of the URL batch insert."""
    batch = _t(spark, sf_dir, "url_batch")
    merged = merge.insert_if_absent(_t(spark, sf_dir, "url_queue"), batch, "account_id")
    return merge.insert_counts(merged, batch, "account_id")
