"""Stand-in crawl tables built from the driver's test tables.

The test data is TPC-H-like (orders, customer, part, events, pages,
conversations).  Each adapter below maps it to one crawl table schema; the
adapters only shape rows, they do none of an operator's work.  The SQL text
is portable: Spark runs it with the base tables bound as DataFrames, and the
DuckDB oracle inlines the very same text as a CTE over its pre-registered
views, so both engines see identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed stamp used as "now" by every registered query, so results are
# deterministic and the oracle can use the same literal.
FIXED_NOW_TEXT = "2025-01-01 00:00:00"

# Parameters of the registered queries over these adapters.
HOST_PREFIX = "https://host.example/"
SEED_SUFFIX = "/followers"
KEYWORD_SUFFIX = " site:host.example"

ADAPTERS: dict[str, str] = {
    # url_queue: one row per order; account_id repeats (1,500 accounts at
    # sf0.01), so joins on it fan out and merges see duplicate keys.
    "url_queue": """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS account_id,
 CASE WHEN o_orderkey%3=0 THEN CAST(o_custkey%25 AS STRING) END AS seed_url_id,
 CASE WHEN o_orderkey%3<>0 THEN CAST((o_orderkey*7)%(SELECT count(*) FROM {customer}) AS STRING) END AS parent_account_id,
 CASE WHEN o_orderkey%17=0 THEN NULL ELSE 1+o_orderkey%3 END AS crawl_depth,
 'https://host.example/' || CAST(o_custkey AS STRING) AS url,
 CASE WHEN o_orderkey%3=0 THEN 'follower' ELSE 'friend' END AS source_type,
 CASE WHEN o_orderkey%11=0 THEN NULL WHEN o_orderkey%13=0 THEN 'failed' WHEN o_orderkey%19=0 THEN 'skipped'
      WHEN o_orderstatus='F' THEN 'completed' WHEN o_orderstatus='O' THEN 'pending' ELSE 'processing' END AS status,
 CASE WHEN o_orderstatus='F' THEN o_orderdate END AS processed_at,
 o_orderdate AS created_at, o_orderdate AS updated_at FROM {orders}""",
    "seed_queue": """
SELECT CAST(c_custkey AS STRING) AS id, 'https://host.example/' || c_name || '/followers' AS url,
 CASE WHEN c_custkey%4=0 THEN NULL WHEN c_custkey%4=1 THEN '' ELSE 'ext_' || CAST(c_nationkey%3 AS STRING) END AS extension_id,
 CASE WHEN c_custkey%5=0 THEN NULL ELSE 100+(c_custkey%3)*50 END AS max_profiles,
 CASE WHEN c_custkey%7=0 THEN NULL WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'pending'
      WHEN c_mktsegment='AUTOMOBILE' THEN 'processing' WHEN c_mktsegment='HOUSEHOLD' THEN 'failed'
      ELSE 'completed' END AS status,
 CASE WHEN c_mktsegment='AUTOMOBILE' THEN d END AS processed_at,
 d AS created_at, d AS updated_at
 FROM {customer} LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM {orders} GROUP BY o_custkey) f ON o_custkey=c_custkey""",
    "keyword_queue": """
SELECT CAST(p_partkey AS STRING) AS id, p_name || ' ' || p_brand || ' site:host.example' AS keyword,
 CASE WHEN p_partkey%4=0 THEN NULL WHEN p_partkey%4=1 THEN '' ELSE 'ext_' || CAST(p_partkey%3 AS STRING) END AS extension_id,
 CASE WHEN p_partkey%6=0 THEN NULL ELSE p_size END AS start,
 CASE WHEN p_partkey%9=0 THEN NULL WHEN p_partkey%5<2 THEN 'pending' WHEN p_partkey%5=2 THEN 'processing'
      ELSE 'completed' END AS status,
 CASE WHEN p_partkey%5=2 THEN d END AS processed_at,
 d AS created_at, d AS updated_at
 FROM {part} LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS d FROM {lineitem} GROUP BY l_partkey) f ON l_partkey=p_partkey""",
    "profile": """
SELECT CAST(c_custkey AS STRING) AS id, CAST(c_custkey AS STRING) AS account_id, c_name AS username, c_mktsegment AS title,
 n_name AS location, 'https://img.example/' || CAST(c_custkey AS STRING) AS profile_image, d AS created_at, d AS updated_at
 FROM {customer} JOIN {nation} ON n_nationkey=c_nationkey
 LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM {orders} GROUP BY o_custkey) f ON o_custkey=c_custkey""",
    # friend_edge: flat (profile, friend) pairs; edge_seq orders them.
    "friend_edge": """
SELECT CAST(o_custkey AS STRING) AS account_id, 1+o_custkey%3 AS crawl_depth, o_orderkey AS edge_seq,
 CASE WHEN o_orderkey%23=0 THEN NULL ELSE CAST((o_orderkey*7)%(SELECT count(*)*2 FROM {customer}) AS STRING) END AS friend_id
 FROM {orders}""",
    "page_url": """
SELECT CAST(page_id AS STRING) AS id, url FROM {pages}""",
    "error_report": """
SELECT CAST(event_id AS STRING) AS id, event_type || ' service' AS title, 'value ' || CAST(user_id AS STRING) AS error_message,
 CASE WHEN user_id%3=0 THEN NULL ELSE 'ext_' || CAST(user_id AS STRING) END AS extension_id,
 CASE WHEN user_id%4=0 THEN NULL WHEN user_id%4=1 THEN 'alpha' ELSE 'beta site' END AS platform,
 CASE WHEN user_id%5=0 THEN '' ELSE 'connection' END AS error_type, CAST(NULL AS STRING) AS url,
 props AS additional_context, ts AS reported_at FROM {events}""",
    # status_patch: about half the ids are unknown to url_queue; ids unique.
    "status_patch": """
SELECT CAST(event_id*3 AS STRING) AS id,
 CASE WHEN event_id%3=0 THEN 'processing' WHEN event_id%3=1 THEN 'completed' ELSE 'failed' END AS status
 FROM {events}""",
    # user_patch: many patches per id, to be applied in the order of seq.
    "user_patch": """
SELECT CAST(user_id AS STRING) AS id, event_id AS seq,
 CASE WHEN event_type='click' THEN 'processing' WHEN event_type='purchase' THEN 'completed'
      WHEN event_type='error' THEN 'failed' ELSE 'pending' END AS status
 FROM {events}""",
    "profile_raw": """
SELECT CASE WHEN c_custkey%31=0 THEN 'undefined' WHEN c_custkey%37=0 THEN '' ELSE CAST(c_custkey AS STRING) END AS account_id,
 CASE WHEN c_custkey%29=0 THEN 'null' ELSE c_name END AS username, CASE WHEN c_custkey%3=0 THEN NULL ELSE c_mktsegment END AS gender,
 CASE WHEN c_custkey%7=0 THEN NULL ELSE CAST(1+c_custkey%3 AS STRING) END AS crawl_depth FROM {customer}""",
    "post": """
SELECT CAST(conv_id AS STRING) AS account_id, turn, CASE WHEN turn%5=4 THEN NULL ELSE text END AS content,
 CASE WHEN turn%4=0 THEN '2024-01-01T10:00:00' WHEN turn%4=1 THEN '2 hrs' WHEN turn%4=2 THEN NULL
      ELSE '2024-02-01T00:00:00' END AS time FROM {conversations}""",
    # payload: JSON text of another kind in each row, some of it broken.  Keys
    # stand in order, as VARIANT keeps them and DuckDB leaves them as written.
    "payload": """
SELECT event_id, CASE WHEN event_id%10=0 THEN NULL WHEN event_id%10=1 THEN '{{"k": ' WHEN event_id%10=2 THEN ' null'
 WHEN event_id%10=3 THEN CAST(user_id AS STRING) WHEN event_id%10=4 THEN '"' || event_type || '"'
 WHEN event_id%10=5 THEN '["' || event_type || '", null, ' || CAST(user_id AS STRING) || ']'
 WHEN event_id%10=6 THEN '[{{"time": ' || CAST(user_id%4 AS STRING) || ', "title": "' || event_type
      || '"}}, "loose", 7, {{"other": 1, "time": "t' || CAST(event_id AS STRING) || '"}}]'
 WHEN event_id%10=7 THEN '{{"k": "' || event_type || '", "user": "' || CAST(user_id AS STRING) || '"}}'
 WHEN event_id%10=8 THEN 'true' ELSE props END AS payload FROM {events}""",
    # profile_patch: upsert source over profile; every account appears once,
    # a quarter under a new key, some keys NULL, location sometimes NULL.
    "profile_patch": """
SELECT CASE WHEN c_custkey%10=5 THEN NULL WHEN c_custkey%4=0 THEN 'n' || CAST(c_custkey AS STRING)
            ELSE CAST(c_custkey AS STRING) END AS account_id,
 upper(c_name) AS username, CASE WHEN c_custkey%3=0 THEN NULL ELSE c_mktsegment END AS location,
 'x' AS not_a_profile_column FROM {customer}""",
    # url_batch: insert source over url_queue; account_id repeats inside the
    # batch, odd lines name queued accounts, even lines new ones.
    "url_batch": """
SELECT CAST(l_orderkey*10+l_linenumber AS STRING) AS id,
 CASE WHEN l_linenumber%2=0 THEN 'n' ELSE '' END || CAST(l_suppkey AS STRING) AS account_id,
 'https://host.example/' || CAST(l_suppkey AS STRING) AS url, 'follower' AS source_type, 'pending' AS status,
 l_orderkey*10+l_linenumber AS seq, l_shipdate AS created_at, l_shipdate AS updated_at FROM {lineitem}""",
    # owner_patch: claims and cursor moves over keyword_queue; ids unique,
    # those above the part count are unknown; some owners / cursors NULL.
    "owner_patch": """
SELECT CAST(event_id AS STRING) AS id,
 CASE WHEN user_id%10=0 THEN NULL ELSE 'ext_' || CAST(user_id%7 AS STRING) END AS extension_id,
 CASE WHEN user_id%9=0 THEN NULL ELSE user_id*10 END AS current_start
 FROM {events}""",
    # patch_log: mixed patches of keyword_queue, many per id, to be replayed in
    # the order of seq; some ids unknown, some owners, cursors, kinds not valid.
    "patch_log": """
SELECT CAST(user_id AS STRING) AS id, event_id AS seq,
 CASE event_id%5 WHEN 0 THEN 'status' WHEN 1 THEN 'owner' WHEN 2 THEN 'claim' WHEN 3 THEN 'cursor'
      ELSE CASE WHEN event_id%7=0 THEN 'other' ELSE 'status' END END AS kind,
 CASE WHEN event_type='click' THEN 'processing' WHEN event_type='purchase' THEN 'completed'
      WHEN event_type='error' THEN NULL ELSE 'failed' END AS status,
 CASE WHEN event_id%11=0 THEN NULL WHEN event_id%13=0 THEN '' ELSE 'ext_' || CAST(event_id%7 AS STRING) END AS extension_id,
 CASE WHEN event_id%9=0 THEN NULL ELSE CAST(event_id%1000 AS INT)*10 END AS start
 FROM {events}""",
    # keyword_batch: one keyword request per order (batch_id); a seventh of
    # the lines name a keyword already queued, some are blank.
    "keyword_batch": """
SELECT l_orderkey AS batch_id,
 CASE WHEN l_partkey%7=0 THEN p_name || ' ' || p_brand WHEN l_linenumber=3 THEN '   '
      ELSE '  ' || p_name || ' ' END AS keyword
 FROM {lineitem} JOIN {part} ON p_partkey=l_partkey""",
    # seed_batch: one seed request per nation; a few URLs are malformed, half
    # are queued already, the rest repeat per market segment.
    "seed_batch": """
SELECT c_nationkey AS batch_id,
 CASE WHEN c_custkey%97=0 THEN 'http://bad.example/' || c_name
      WHEN c_custkey%2=0 THEN 'https://host.example/' || c_name || '/followers'
      ELSE 'https://host.example/' || c_mktsegment || '/followers' END AS url
 FROM {customer}""",
    # social_profile: incoming social profiles (flat); Spark puts f1, f2 in
    # friend_lists.  Literal-null keys and names, text depth, NULL friends.
    "social_profile": """
SELECT CASE WHEN c_custkey%31=0 THEN 'undefined' WHEN c_custkey%37=0 THEN ''
            WHEN c_custkey%2=0 THEN 's' || CAST(c_custkey AS STRING) ELSE CAST(c_custkey AS STRING) END AS account_id,
 CASE WHEN c_custkey%29=0 THEN 'null' WHEN c_custkey%41=0 THEN NULL ELSE c_name END AS username,
 CASE WHEN c_custkey%3=0 THEN NULL ELSE c_mktsegment END AS gender,
 CASE WHEN c_custkey%7=0 THEN NULL ELSE CAST(1+c_custkey%3 AS STRING) END AS crawl_depth,
 CAST((c_custkey*7)%(SELECT count(*)*2 FROM {customer}) AS STRING) AS f1,
 CASE WHEN c_custkey%5=0 THEN NULL ELSE CAST((c_custkey*11)%(SELECT count(*)*2 FROM {customer}) AS STRING) END AS f2,
 c_custkey AS seq
 FROM {customer}""",
    # about_raw: free-form "about" values of every JSON kind.
    "about_raw": """
SELECT CAST(conv_id AS STRING) AS account_id, turn,
 CASE turn%6 WHEN 0 THEN NULL WHEN 1 THEN '["' || role || '", ' || CAST(turn AS STRING) || ']'
      WHEN 2 THEN '{{"role": "' || role || '"}}' WHEN 3 THEN '[]' WHEN 4 THEN '{{}}'
      ELSE role || ' ' || CAST(conv_id AS STRING) END AS about
 FROM {conversations}""",
    # url_json: URL rows as JSON text with an unknown field, one field
    # missing and NULL values, for the declared-schema load.
    "url_json": """
SELECT '{{"id": "' || CAST(o_orderkey AS STRING) || '", "account_id": "' || CAST(o_custkey AS STRING)
 || '", "status": ' || CASE WHEN o_orderkey%11=0 THEN 'null' ELSE '"' || o_orderstatus || '"' END
 || ', "crawl_depth": ' || CAST(1+o_orderkey%3 AS STRING) || ', "junk": [1, 2]}}' AS value
 FROM {orders}""",
}

# Adapter text is a format string: {table} names a base table, {{ and }}
# are literal braces.
_PLACEHOLDER = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def adapter_tables(name: str) -> list[str]:
    """Base tables an adapter reads."""
    return sorted(set(_PLACEHOLDER.findall(ADAPTERS[name])))


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter as a Spark DataFrame over the parquet tables in ``sf_dir``."""
    tables = {t: base_table(spark, sf_dir, t) for t in adapter_tables(name)}
    return spark.sql(ADAPTERS[name], **tables)


def adapter_sql(name: str) -> str:
    """The adapter text with plain table names (DuckDB's registered views)."""
    text = _PLACEHOLDER.sub(lambda m: m.group(1), ADAPTERS[name])
    return text.replace("{{", "{").replace("}}", "}")


def with_ctes(body: str, *names: str, ctes: str = "") -> str:
    """Oracle SQL: ``WITH <adapters>[, <ctes>] <body>``."""
    parts = [f"{n} AS ({adapter_sql(n)}\n)" for n in names]
    if ctes:
        parts.append(ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body


def social_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming social profiles: the ``social_profile`` adapter with its two
    friend columns as ``friend_lists`` (a NULL friend stays a NULL item)."""
    from pyspark.sql import functions as F

    sp = load_adapter(spark, sf_dir, "social_profile")
    return sp.select("account_id", "username", "gender", "crawl_depth",
                     F.array("f1", "f2").alias("friend_lists"), "seq")


def post_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with ``posts`` arrays built from the ``post`` adapter.

    All posts of a conversation are one array, sorted by turn; every seventh
    turn is a NULL item.  The array is a cell of the profile row it stands for.
    """
    from pyspark.sql import functions as F

    p = load_adapter(spark, sf_dir, "post")
    item = F.struct("turn", (F.col("turn") % 7 == 6).alias("gap"),
                    F.struct("content", "time").alias("post"))
    grouped = p.groupBy("account_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    posts = F.transform("items", lambda x: F.when(~x["gap"], x["post"]))
    return grouped.select("account_id", posts.alias("posts"))
