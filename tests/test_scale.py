"""Hot keys on the large-source merge path.

One key holds a third of the rows.  With AQE's skew thresholds lowered to
test size, the executed plans must show the hot partition split
(``SortMergeJoin(skew=true)``), and the results must equal a plain model.
"""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from crawlq.operators import merge

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
N = 30000


@pytest.fixture
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def executed_plan(df):
    rows = df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return rows, buf.getvalue()


def test_hot_target_key_is_split_in_upsert(skew_session):
    spark = skew_session
    # Rows carry a varying payload: AQE measures skew in (compressed) bytes.
    target = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.lit("old").alias("status"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    source = spark.range(0, N, 7).select(
        F.when(F.col("id") == 0, F.lit("hot")).otherwise((F.col("id") + 1).cast("string")).alias("id"),
        F.lit("new").alias("status"))
    rows, plan = executed_plan(merge.upsert(target, source, "id", source_small=False))
    assert "isFinalPlan=true" in plan
    assert "SortMergeJoin(skew=true)" in plan and "LeftOuter" in plan
    assert "FullOuter" not in plan
    hot = [r for r in rows if r["id"] == "hot"]
    assert len(hot) == N // 3 and all(r["status"] == "new" and r["_action"] == "update" for r in hot)
    src_keys = {r["id"] for r in source.collect()}
    tgt_keys = {r["id"] for r in target.collect()}
    assert sum(r["_action"] == "insert" for r in rows) == len(src_keys - tgt_keys)


def test_hot_source_key_is_split_in_insert_if_absent(skew_session):
    spark = skew_session
    target = spark.range(0, N, 2).select(F.col("id").cast("string").alias("id"),
                                         F.lit(None).cast("string").alias("payload"))
    # a third of the candidates name one new account (a popular friend)
    source = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("popular")).otherwise(F.col("id").cast("string")).alias("id"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    rows, plan = executed_plan(merge.insert_if_absent(target, source, "id", source_small=False))
    assert "SortMergeJoin(skew=true)" in plan and "LeftAnti" in plan
    inserted = [r for r in rows if r["_action"] == "insert"]
    expect = sum(1 for i in range(N) if i % 3 == 0) + sum(1 for i in range(N) if i % 3 and i % 2)
    assert len(inserted) == expect


def test_hot_request_is_split_in_keyword_ingest(skew_session):
    from crawlq.operators import ingest

    spark = skew_session
    spark.conf.set(merge.CONF_MAX_ROWS, "0")  # verdicts materialised, not broadcast
    try:
        queue = spark.createDataFrame([("q", "taken sx", None, 0, "pending", None, None, None)],
                                      "id string, keyword string, extension_id string, start bigint, "
                                      "status string, processed_at timestamp, created_at timestamp, "
                                      "updated_at timestamp")
        # request 0 holds a third of all keywords; request 5 names a queued one
        batch = spark.range(N).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("b"),
            F.when(F.col("id") == 5, F.lit("taken"))
            .otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("keyword"))
        out = ingest.create_keywords(batch, queue, suffix=" sx", batch_col="b",
                                     now=F.current_timestamp())
        rows, plan = executed_plan(out)
    finally:
        spark.conf.unset(merge.CONF_MAX_ROWS)
    assert "SortMergeJoin(skew=true)" in plan
    rejected = sum(r["_action"] == "reject" for r in rows)
    inserted = sum(r["_action"] == "insert" for r in rows)
    in_req_5 = sum(1 for i in range(N) if i % 3 and i % 97 + 1 == 6)
    assert rejected == in_req_5 and inserted == N - in_req_5


def test_small_source_never_shuffles_the_target(spark):
    from conftest import SF_SMALL
    from crawlq.sources.fixtures import load_adapter

    target = load_adapter(spark, SF_SMALL, "url_queue")
    patch = spark.createDataFrame([("1", "failed"), ("999999", "failed")], "id string, status string")
    out = merge.patch_status(target, patch, F.current_timestamp())
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    plan = buf.getvalue()
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan
    assert "SortMergeJoin" not in plan
    # the only shuffles are on the patch side and the adapter's one-row subquery
    orders_under_exchange = [l for l in plan.splitlines()
                             if "Exchange hashpartitioning(id" in l]
    assert all("o_orderkey" not in l for l in orders_under_exchange)


def test_hot_account_is_split_in_completed_profiles(skew_session):
    from crawlq.operators import joins

    spark = skew_session
    urls = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string"))
        .alias("account_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("parent_account_id"),
        (F.col("id") % 3 + 1).alias("crawl_depth"), F.lit(None).cast("string").alias("seed_url_id"),
        F.lit("completed").alias("status"))
    profiles = spark.range(500).select(
        F.col("id").cast("string").alias("account_id"), F.lit("u").alias("username"),
        F.lit("i").alias("profile_image"), F.current_timestamp().alias("created_at")).union(
        spark.range(1).select(F.lit("hot"), F.lit("h"), F.lit("i"), F.current_timestamp()))
    rows, plan = executed_plan(joins.completed_profiles(urls, profiles, order=False))
    assert "SortMergeJoin(skew=true)" in plan
    assert len(rows) == N


def _plan(df, mode="simple"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_scans_read_only_needed_columns(spark):
    from conftest import SF_SMALL
    from crawlq.plans.registry import all_queries

    qs = all_queries()
    scan_plan = _plan(qs["scan"].build(spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in scan_plan
    read_plan = _plan(qs["url_pending"].build(spark, SF_SMALL))
    schemas = [l for l in read_plan.splitlines() if "orders.parquet" in l and "ReadSchema" in l]
    assert schemas and all("o_totalprice" not in l and "o_orderpriority" not in l for l in schemas)


def test_read_filters_reach_the_parquet_scan(spark):
    import os
    import tempfile

    from crawlq.operators import queue_reads
    from crawlq.sources import tables
    from crawlq.sources.schemas import table_schema

    root = tempfile.mkdtemp(prefix="crawlq-pushdown-")
    schema = table_schema("social", "urls")
    tables.ensure_tables(spark, root)
    path = tables.table_path(root, "social", "urls")
    df = tables.scan(spark, path, schema)
    plan = _plan(queue_reads.url_pending(df, depth=1, seed="s"), "formatted")
    pushed = [l for l in plan.splitlines() if "PushedFilters" in l]
    assert pushed and "EqualTo(crawl_depth,1)" in pushed[0] and "EqualTo(seed_url_id,s)" in pushed[0]
    assert "TakeOrderedAndProject" in plan
    assert os.path.isdir(path)


def test_hot_parent_is_split_in_lineage_semi_join(skew_session):
    from crawlq.operators import joins

    spark = skew_session
    # a third of the completed rows are children of one direct account
    completed = spark.range(N).select(
        (F.col("id") + 1000).cast("string").alias("account_id"),
        F.when(F.col("id") % 3 == 0, F.lit("root")).otherwise(F.sha2(F.col("id").cast("string"), 256))
        .alias("parent_account_id"),
        F.sha2(F.col("id").cast("string"), 224).alias("payload"))
    parents = spark.range(50).select(
        F.when(F.col("id") == 0, F.lit("root")).otherwise(F.col("id").cast("string"))
        .alias("account_id"))
    rows, plan = executed_plan(joins.parent_in(completed, parents))
    assert "SortMergeJoin(skew=true)" in plan and "LeftSemi" in plan
    assert len(rows) == sum(1 for i in range(N) if i % 3 == 0)
