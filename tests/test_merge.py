"""Hand-written merge cases (upsert, insert-if-absent, patches)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.operators import merge

NOW = dt.datetime(2025, 1, 1)
TARGET_DDL = "id string, status string, owner string, processed_at timestamp_ntz, updated_at timestamp_ntz"
OLD = dt.datetime(2024, 6, 1)


@pytest.fixture
def target(spark):
    return spark.createDataFrame(
        [("a", "pending", "x", None, OLD), ("b", "processing", "y", OLD, OLD),
         ("c", "completed", None, OLD, OLD)], TARGET_DDL)


def now():
    return F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")


@pytest.fixture(params=[merge.BROADCAST_MAX_ROWS, 0], ids=["broadcast", "shuffle"])
def bmax(request):
    return request.param


def test_upsert_null_overwrites_and_absent_kept(spark, target, bmax):
    src = spark.createDataFrame([("a", None), ("z", "new")], "id string, status string")
    out = merge.upsert(target, src, "id", broadcast_max_rows=bmax)
    got = {r["id"]: r for r in out.collect()}
    assert got["a"]["status"] is None and got["a"]["owner"] == "x"
    assert got["a"]["_action"] == "update"
    assert got["z"]["status"] == "new" and got["z"]["owner"] is None
    assert got["z"]["_action"] == "insert"
    assert got["b"]["_action"] == "keep" and got["b"]["status"] == "processing"


def test_upsert_drops_null_keys_and_unknown_columns(spark, target, bmax):
    src = spark.createDataFrame([(None, "x", 1), ("b", "failed", 2)], "id string, status string, junk int")
    out = merge.upsert(target, src, "id", broadcast_max_rows=bmax)
    assert "junk" not in out.columns
    assert out.count() == 3
    assert rows(merge.null_key_count(src, "id")) == [(1,)]


def test_upsert_key_only_inserts(spark, target, bmax):
    src = spark.createDataFrame([("a",), ("q",), (None,)], "id string")
    out = merge.upsert(target, src, "id", broadcast_max_rows=bmax)
    assert rows(out.filter("_action = 'insert'"), "id", "status") == [("q", None)]
    assert out.filter("_action = 'update'").count() == 0


def test_upsert_missing_key_raises(spark, target):
    src = spark.createDataFrame([("x",)], "status string")
    with pytest.raises(ValueError):
        merge.upsert(target, src, "id")


def test_upsert_duplicate_source_key_errors(spark, target, bmax):
    src = spark.createDataFrame([("a", "p"), ("a", "q")], "id string, status string")
    with pytest.raises(Exception, match="duplicate source key"):
        merge.upsert(target, src, "id", broadcast_max_rows=bmax).collect()


def test_upsert_latest_per_key(spark, target, bmax):
    src = spark.createDataFrame([("a", "p", 1), ("a", "q", 2)], "id string, status string, seq int")
    out = merge.upsert(target, src, "id", on_duplicate="latest", order="seq",
                       broadcast_max_rows=bmax)
    assert rows(out.filter("id = 'a'"), "status") == [("q",)]


def test_insert_if_absent_keeps_batch_duplicates(spark, target, bmax):
    src = spark.createDataFrame([("n", "1", 2), ("n", "2", 1), ("a", "3", 3), (None, "4", 4)],
                                "id string, status string, seq int")
    out = merge.insert_if_absent(target, src, "id", broadcast_max_rows=bmax)
    assert rows(out.filter("_action = 'insert'"), "id", "status") == [("n", "1"), ("n", "2")]
    dd = merge.insert_if_absent(target, src, "id", dedupe=True, order="seq",
                                broadcast_max_rows=bmax)
    assert rows(dd.filter("_action = 'insert'"), "id", "status") == [("n", "2")]
    assert "seq" not in dd.columns


def test_insert_if_absent_keep_null_keys(spark, target, bmax):
    src = spark.createDataFrame([(None, "1"), (None, "2")], "id string, status string")
    out = merge.insert_if_absent(target, src, "id", keep_null_keys=True, broadcast_max_rows=bmax)
    assert out.filter("_action = 'insert'").count() == 2


def test_insert_if_absent_idempotent(spark, target, bmax):
    src = spark.createDataFrame([("n", "1"), ("a", "3")], "id string, status string")
    once = merge.table_rows(merge.insert_if_absent(target, src, "id", broadcast_max_rows=bmax))
    twice = merge.table_rows(merge.insert_if_absent(once, src, "id", broadcast_max_rows=bmax))
    assert rows(once) == rows(twice)


def test_patch_status_stamps(spark, target, bmax):
    patch = spark.createDataFrame([("a", "processing"), ("b", "completed"), ("zz", "failed"),
                                   (None, "failed")], "id string, status string")
    out = merge.patch_status(target, patch, now(), broadcast_max_rows=bmax)
    got = {r["id"]: r for r in out.collect()}
    assert got["a"]["processed_at"] == NOW and got["a"]["updated_at"] == NOW
    # completed keeps the old processed_at
    assert got["b"]["processed_at"] == OLD and got["b"]["status"] == "completed"
    assert got["zz"]["_action"] == "reject"
    assert got[None]["_action"] == "reject"
    assert got["c"]["_action"] == "keep"
    assert merge.table_rows(out).count() == 3


def test_claim_and_cursor(spark, bmax):
    kw = spark.createDataFrame([("k1", "pending", None, 5, OLD)],
                               "id string, status string, extension_id string, start bigint, updated_at timestamp_ntz")
    kw = kw.withColumn("processed_at", F.lit(None).cast("timestamp_ntz"))
    claim = spark.createDataFrame([("k1", "e1"), ("k2", None)], "id string, extension_id string")
    out = merge.claim_processing(kw, claim, now(), broadcast_max_rows=bmax)
    got = {r["id"]: r for r in out.collect()}
    assert got["k1"]["status"] == "processing" and got["k1"]["extension_id"] == "e1"
    assert got["k1"]["processed_at"] == NOW
    assert got["k2"]["_action"] == "reject"
    cur = spark.createDataFrame([("k1", 0), ("k1x", None)], "id string, current_start int")
    out = merge.advance_cursor(kw, cur, now(), cursor="current_start", broadcast_max_rows=bmax)
    got = {r["id"]: r for r in out.collect()}
    assert got["k1"]["start"] == 0 and got["k1x"]["_action"] == "reject"


def test_affected_rows_inserted_plus_skipped(spark, target, bmax):
    src = spark.createDataFrame([("n", "1"), ("a", "3"), ("m", "3")], "id string, status string")
    out = merge.insert_if_absent(target, src, "id", broadcast_max_rows=bmax)
    counts = dict(rows(merge.affected_rows(out)))
    inserted = counts["insert"]
    skipped = src.count() - inserted
    assert inserted == 2 and skipped == 1
