"""The key bitmap: no match is lost, few others pass, and merges shuffle only what passes."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.operators import key_filter, merge


def _keys(spark, n, step=1, kind="string"):
    return spark.range(0, n * step, step).select(F.col("id").cast(kind).alias("id"))


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_every_match_passes_and_few_others(spark, kind):
    table = _keys(spark, 50_000, kind=kind).unionByName(spark.createDataFrame([(None,)], f"id {kind}"))
    keys = merge.materialize(_keys(spark, 500, 100, "long"))
    keys = keys.select(F.col("id").cast(kind).alias("id"))
    got = key_filter.with_key_filter(table, keys, "id", "may")
    assert got.columns == ["id", "may"] and got.count() == 50_001
    assert got.join(keys, "id", "left_semi").filter("may").count() == 500
    assert got.filter("may").count() < 500 + 50_000 * 0.02


def test_a_full_bitmap_and_too_many_keys_lose_nothing(spark, monkeypatch):
    table, keys = _keys(spark, 20_000), merge.materialize(_keys(spark, 5_000, 4))
    for slots, most in ((1, 10**9), (1 << 20, 10)):
        monkeypatch.setattr(key_filter, "MAX_SLOTS", slots)
        monkeypatch.setattr(key_filter, "MAX_KEYS", most)
        got = key_filter.with_key_filter(table, keys, "id", "may")
        assert got.count() == 20_000 and got.join(keys, "id", "left_semi").filter("may").count() == 5_000
    assert key_filter.with_key_filter(table, keys.limit(0), "id", "may").count() == 20_000


@pytest.mark.parametrize("on_missing", ["insert", "reject"])
def test_large_merges_equal_small_ones(spark, on_missing):
    target = _keys(spark, 3_000).withColumn("v", F.lit(0)).unionByName(
        spark.createDataFrame([("7", 1), ("7", 2), (None, 3)], "id string, v int"))
    source = _keys(spark, 400, 13).withColumn("v", F.lit(9))
    small, large = (merge.upsert(target, source, "id", on_missing=on_missing, source_small=s) for s in (True, False))
    assert rows(large, "id", "v", "_action") == rows(small, "id", "v", "_action")
    small, large = (merge.insert_if_absent(target, source, "id", source_small=s) for s in (True, False))
    assert rows(large, "id", "v", "_action") == rows(small, "id", "v", "_action")


def test_a_large_merge_shuffles_about_the_rows_that_match(spark):
    target = _keys(spark, 200_000).withColumn("v", F.lit(0))
    source = _keys(spark, 300, 500).withColumn("v", F.lit(9))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = merge.upsert(target, source, "id", source_small=False)
        assert merged.filter("_action = 'update'").count() == 300
        # The shuffled side of the plan is the filtered one.
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "_kf_bits" in plan
    passed = key_filter.with_key_filter(target, source, "id", "may").filter("may").count()
    assert passed < 300 + 200_000 * 0.02
