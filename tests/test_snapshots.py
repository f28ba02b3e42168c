"""Key-bucketed tables: merges that rewrite only changed buckets, appends made once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.operators import merge
from crawlq.sources import snapshots

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "id string, url string, status string, processed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"


def _urls(ids, status="pending"):
    return [(str(i), f"u{i}", status, None, T0, T0) for i in ids]


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.create(spark.createDataFrame(_urls(range(200)), SCHEMA), root, "id", buckets=16)
    return root


def _patch(target, p):
    return merge.patch_status(target, p, F.expr("TIMESTAMP_NTZ '2025-01-02 00:00:00'"))


def _patches(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, status string")


def test_merge_keeps_the_folders_of_untouched_buckets(spark, table):
    before = snapshots.version(spark, table)
    full = _patch(snapshots.read(spark, table), _patches(spark, ("7", "processing"), ("8", "done")))
    want = rows(merge.table_rows(full))
    done = snapshots.merge_into(spark, table, _patches(spark, ("7", "processing"), ("8", "done")), _patch)
    after = snapshots.version(spark, table)
    assert rows(snapshots.read(spark, table)) == want
    assert done.counts["update"] == 2 and 1 <= len(done.changed) <= 2
    for b in before.folders:
        assert (before.folders[b] == after.folders[b]) == (b not in done.changed)
    assert rows(snapshots.read(spark, table, 1)) == sorted(_urls(range(200)), key=repr)  # the old version is whole


def test_unknown_ids_change_no_bucket(spark, table):
    before = snapshots.version(spark, table)
    done = snapshots.merge_into(spark, table, _patches(spark, ("9000", "x"), ("9001", "y")), _patch)
    assert done.changed == [] and done.counts["reject"] == 2
    assert snapshots.version(spark, table).folders == before.folders
    assert rows(snapshots.read_rejects(spark, table, done), "id", "status") == [("9000", "x"), ("9001", "y")]


def test_inserts_into_an_empty_table_and_null_keys(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.create(spark.createDataFrame([], SCHEMA), root, "id", buckets=4)
    assert snapshots.read(spark, root).count() == 0
    batch = spark.createDataFrame([*_urls(range(5)), (None, "n", "pending", None, T0, T0)], SCHEMA)

    def add(target, source):
        return merge.insert_if_absent(target, source, "id", keep_null_keys=True)

    assert snapshots.merge_into(spark, root, batch, add).counts["insert"] == 6
    assert snapshots.merge_into(spark, root, batch, add).counts["insert"] == 1  # NULL equals no NULL
    assert snapshots.read(spark, root).filter("id IS NULL").count() == 2


def test_append_twice_gives_one_copy_and_the_same_rejects(spark, table):
    batch = spark.createDataFrame([*_urls(range(300, 320)), ("400", None, "pending", None, T0, T0)], SCHEMA)
    batch = batch.withColumn("extra", F.lit(1)).withColumn("url", F.when(F.rand() < 2, F.col("url")))
    one = snapshots.append(spark, table, batch, "w", 1, "urls")
    two = snapshots.append(spark, table, batch, "w", 1, "urls")
    assert (one.repeated, two.repeated) == (False, True) and one.version == two.version
    assert one.counts == two.counts and one.counts["insert"] == 20
    assert snapshots.read(spark, table).count() == 220
    for done in (one, two):
        assert rows(snapshots.read_rejects(spark, table, done), "id", "_reject_reason") == [("400", "missing required fields")]
    assert not snapshots.append(spark, table, batch, "other", 1, "urls").repeated  # another writer's batch
    assert not snapshots.append(spark, table, batch, "w", 2, "urls").repeated
    assert snapshots.append(spark, table, batch, "w", 1, "urls").version == one.version
    assert snapshots.read(spark, table).count() == 260


def test_concurrent_append_is_rebased_and_concurrent_merge_raises(spark, table):
    def append_meanwhile(target, p):
        snapshots.append(spark, table, spark.createDataFrame(_urls(range(500, 560)), SCHEMA), "w", 1)
        return _patch(target, p)

    with pytest.raises(snapshots.ConcurrentWrite):
        snapshots.merge_into(spark, table, _patches(spark, ("7", "done")), append_meanwhile)
    assert snapshots.read(spark, table).count() == 260
    assert snapshots.read(spark, table).filter("status = 'done'").count() == 0

    v = snapshots.version(spark, table)
    assert not snapshots._create(spark, table, v)  # a version is committed once


def test_merge_of_other_buckets_is_rebased(spark, table):
    ids = {r["id"]: r["b"] for r in snapshots.read(spark, table).select("id", snapshots.bucket_of("id", 16).alias("b")).collect()}
    mine = "7"
    other = next(i for i, b in ids.items() if b != ids[mine])

    def merge_meanwhile(target, p):
        snapshots.merge_into(spark, table, _patches(spark, (other, "theirs")), _patch)
        return _patch(target, p)

    done = snapshots.merge_into(spark, table, _patches(spark, (mine, "mine")), merge_meanwhile)
    assert done.version == 3
    got = {r["id"]: r["status"] for r in snapshots.read(spark, table).collect()}
    assert (got[mine], got[other], len(got)) == ("mine", "theirs", 200)


def test_compact_and_vacuum(spark, table):
    for n in range(4):
        snapshots.append(spark, table, spark.createDataFrame(_urls(range(1000 + 50 * n, 1050 + 50 * n)), SCHEMA), "w", n)
    want = rows(snapshots.read(spark, table))
    snapshots.compact(spark, table, max_folders=1)
    assert max(len(f) for f in snapshots.version(spark, table).folders.values()) == 1
    assert rows(snapshots.read(spark, table)) == want
    assert snapshots.compact(spark, table, max_folders=1) is None
    assert snapshots.vacuum(spark, table, keep=1) > 0
    assert len(snapshots.versions(spark, table)) == 1
    assert rows(snapshots.read(spark, table)) == want
    assert snapshots.append(spark, table, snapshots.read(spark, table), "w", 3).repeated


def test_a_hot_key_is_written_in_several_files(spark, tmp_path):
    """A third of the rows under one key: its bucket is split by the rebalanced write."""
    root = str(tmp_path / "t")
    hot = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.sha2(F.col("id").cast("string"), 512).alias("url"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size)
    spark.conf.set(size, str(1 << 20))
    try:
        snapshots.create(hot, root, "id", buckets=8)
    finally:
        spark.conf.set(size, old)
    b = spark.range(1).select(F.lit("hot").alias("id")).select(snapshots.bucket_of("id", 8)).first()[0]
    part = snapshots.read(spark, root, buckets=[b])
    assert len(part.inputFiles()) > 2
    assert part.filter("id = 'hot'").count() == 100_000


def test_create_twice_and_missing_table_raise(spark, table, tmp_path):
    with pytest.raises(FileExistsError):
        snapshots.create(spark.createDataFrame([], SCHEMA), table, "id")
    with pytest.raises(FileNotFoundError):
        snapshots.version(spark, str(tmp_path / "nothing"))
