"""Queue reads, stats, joins, frontier, ingest, sinks and streaming."""

import datetime as dt
import os
import tempfile

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.operators import frontier, ingest, joins, merge, queue_reads, stats
from crawlq.sources import tables
from crawlq.sources.schemas import KEYWORD_QUEUE, SCHEMAS, table_schema
from crawlq.streaming import stream

T0 = dt.datetime(2024, 1, 1)


def ts(days):
    return T0 + dt.timedelta(days=days)


def now():
    return F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")


URLS_DDL = ("id string, account_id string, seed_url_id string, parent_account_id string, "
            "crawl_depth bigint, url string, source_type string, status string, "
            "processed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")


def url_row(i, acc, seed=None, parent=None, depth=1, status="pending", day=0):
    return (str(i), acc, seed, parent, depth, f"https://h/{acc}", "friend", status, None,
            ts(day), ts(day))


@pytest.fixture
def urls(spark):
    return spark.createDataFrame([
        url_row(1, "a", seed="s", status="completed", day=1),
        url_row(2, "b", parent="a", depth=2, status="completed", day=2),
        url_row(3, "c", parent="b", depth=3, status="completed", day=3),  # grandchild
        url_row(4, "d", status=None, day=0),
        url_row(5, "e", status="processing", depth=2, day=5),
        url_row(6, "f", status="failed", depth=2, day=4),
        url_row(7, "g", status="pending", depth=None, day=6),
    ], URLS_DDL)


@pytest.fixture
def profiles(spark):
    return spark.createDataFrame(
        [(acc, acc, f"user_{acc}", f"img_{acc}", ts(10)) for acc in "abcdef"],
        "id string, account_id string, username string, profile_image string, created_at timestamp_ntz")


def test_lineage_excludes_grandchildren(urls, profiles):
    got = rows(joins.lineage_profiles(urls, profiles, "s"), "account_id")
    assert got == [("a",), ("b",)]


def test_completed_profiles(urls, profiles):
    out = joins.completed_profiles(urls, profiles)
    assert [r["account_id"] for r in out.collect()] == ["a", "b", "c"]
    assert set(out.columns) >= {"processed_at", "status", "username"}


def test_url_reads_precedence(spark):
    df = spark.createDataFrame([
        url_row(1, "a", seed="x", depth=2, status="pending"),
        url_row(2, "b", seed="y", depth=1, status=None),
        url_row(3, "c", seed="y", depth=1, status="pending"),
    ], URLS_DDL)
    intended = rows(queue_reads.url_pending(df, depth=1, seed="y"), "id")
    written = rows(queue_reads.url_pending_as_written(df, depth=1, seed="y"), "id")
    assert intended == [("2",), ("3",)]
    assert written == [("1",), ("2",), ("3",)]


def test_url_resumable_priority(urls):
    got = [r["id"] for r in queue_reads.url_resumable(urls, depth=2).collect()]
    assert got == ["5", "6"]  # processing before failed; completed excluded


def test_read_bounds():
    with pytest.raises(ValueError):
        queue_reads.check_bounds(0, 0, (10, 100))
    with pytest.raises(ValueError):
        queue_reads.check_bounds(101, 0, (10, 100))
    with pytest.raises(ValueError):
        queue_reads.check_bounds(5, -1, (10, 100))


def test_keyword_reads(spark):
    kw = spark.createDataFrame([
        ("1", "k1", None, None, "pending", None, ts(2), ts(2)),
        ("2", "k2", "", 5, "pending", None, ts(1), ts(1)),
        ("3", "k3", "me", 7, "processing", None, ts(3), ts(3)),
        ("4", "k4", "other", 7, "processing", None, ts(0), ts(0)),
        ("5", "k5", None, None, None, None, ts(0), ts(0)),
    ], KEYWORD_QUEUE.simpleString().replace("struct<", "").rstrip(">").replace(":", " ")
        .replace("timestamp", "timestamp_ntz").replace(",", ", "))
    un = queue_reads.queue_pending_unowned(kw)
    assert [(r["id"], r["start"]) for r in un.collect()] == [("2", 5), ("1", 0)]
    mine = [r["id"] for r in queue_reads.queue_pending_or_owned(kw, "me").collect()]
    assert mine == ["3", "2", "1"]


def test_seed_page_offset(spark):
    df = spark.createDataFrame([(str(i), f"u{i}", None, 100, "pending", ts(i), ts(i)) for i in range(5)],
                               "id string, url string, extension_id string, max_profiles bigint, "
                               "status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    page = [r["id"] for r in queue_reads.seed_page(df, limit=2, offset=1).collect()]
    assert page == ["3", "2"]


def test_stats_fold_null_and_pending(spark):
    df = spark.createDataFrame([("pending", None), (None, ""), (None, "x"), ("done", "x")],
                               "status string, extension_id string")
    got = rows(stats.stats_owner_rollup(df))
    assert got == [("done", "x", 1), ("pending", "unassigned", 2), ("pending", "x", 1)]


def test_stats_depth_rollup_zero_depth(spark):
    df = spark.createDataFrame([(0, "a"), (None, "a"), (1, None)], "crawl_depth bigint, status string")
    assert rows(stats.stats_depth_rollup(df)) == [(1, "a", 2), (1, "pending", 1)]


def test_stats_profile_by_depth_counts_pairs(spark, urls):
    prof = spark.createDataFrame([("a",), ("a",), ("e",)], "account_id string")
    got = rows(stats.stats_profile_by_depth(prof, urls))
    assert got == [("completed", 1, 2), ("processing", 2, 1)]


def test_frontier_depth_limit(spark):
    prof = spark.createDataFrame([("p2", 2, ["x", None, "y"]), ("p3", 3, ["z"]), ("p0", None, ["w"])],
                                 "account_id string, crawl_depth bigint, friend_lists array<string>")
    queue = spark.createDataFrame([url_row(1, "y")], URLS_DDL)
    out = merge.inserted_rows(frontier.expand_frontier(prof, queue, url_base="https://h/", now=now()))
    got = rows(out, "account_id", "parent_account_id", "crawl_depth", "url", "source_type", "status")
    assert got == [("w", "p0", 2, "https://h/w", "friend", "pending"),
                   ("x", "p2", 3, "https://h/x", "friend", "pending")]
    assert out.filter(F.col("seed_url_id").isNotNull()).count() == 0


def test_frontier_dedupe_first_wins(spark):
    prof = spark.createDataFrame([("p1", 1, ["x"], 2), ("p2", 1, ["x"], 1)],
                                 "account_id string, crawl_depth bigint, friend_lists array<string>, seq int")
    queue = spark.createDataFrame([], URLS_DDL)
    dup = merge.inserted_rows(frontier.expand_frontier(prof, queue, now=now()))
    assert dup.count() == 2
    one = merge.inserted_rows(frontier.expand_frontier(prof, queue, dedupe=True, order="seq", now=now()))
    assert rows(one, "parent_account_id") == [("p2",)]


def test_keywords_batch_rejected_on_conflict(spark):
    queue = spark.createDataFrame([("1", "old site:s", None, 0, "pending", None, ts(0), ts(0))],
                                  "id string, keyword string, extension_id string, start bigint, "
                                  "status string, processed_at timestamp_ntz, created_at timestamp_ntz, "
                                  "updated_at timestamp_ntz")
    batch = spark.createDataFrame([(1, "a"), (1, " a "), (1, ""), (1, None), (2, "old"), (2, "new")],
                                  "b int, keyword string")
    verdicts = rows(ingest.keyword_conflicts(batch, queue, suffix=" site:s", batch_col="b"))
    assert verdicts == [(1, 0, 1, "all_new"), (2, 1, 1, "some_exist")]
    out = ingest.create_keywords(batch, queue, suffix=" site:s", batch_col="b", now=now())
    got = rows(out.filter("_action != 'keep'"), "keyword", "status", "start", "_action")
    assert got == [("a site:s", "pending", 0, "insert"), ("new site:s", None, None, "reject"),
                   ("old site:s", None, None, "reject")]
    single = ingest.create_keywords(batch.filter("b = 1"), queue, suffix=" site:s", now=now())
    assert single.filter("_action = 'insert'").count() == 1


def test_seeds_all_or_nothing(spark):
    queue = spark.createDataFrame([], "id string, url string, extension_id string, max_profiles bigint, "
                                      "status string, processed_at timestamp_ntz, "
                                      "created_at timestamp_ntz, updated_at timestamp_ntz")
    ok = spark.createDataFrame([("https://s/a/followers",), ("https://s/a/followers",)], "url string")
    out = ingest.create_seeds(ok, queue, prefix="https://s/", suffix="/followers", now=now())
    assert out.filter("_action = 'insert'").count() == 2
    bad = ok.union(spark.createDataFrame([("ftp://x",)], "url string"))
    out = ingest.create_seeds(bad, queue, prefix="https://s/", suffix="/followers", now=now())
    assert out.filter("_action = 'insert'").count() == 0
    assert out.filter("_action = 'reject'").count() == 3
    v1 = ingest.create_seeds(bad, queue, prefix="https://s/", suffix="/followers", check=False,
                             v1=True, now=now())
    assert v1.filter("_action = 'insert'").count() == 3


def test_ensure_tables_and_write_merged(spark):
    root = tempfile.mkdtemp(prefix="crawlq-tables-")
    first = {r["status"] for r in tables.ensure_tables(spark, root).collect()}
    again = {r["status"] for r in tables.ensure_tables(spark, root).collect()}
    assert first == {"created"} and again == {"existing"}
    path = tables.table_path(root, "pro", "keywords")
    empty = tables.scan(spark, path, table_schema("pro", "keywords"))
    assert empty.count() == 0 and len(SCHEMAS) == 8
    src = spark.createDataFrame([("k1 s",)], "keyword string")
    merged = merge.insert_if_absent(empty, ingest_rows(src), "keyword")
    out = os.path.join(root, "keywords_v2")
    counts = tables.write_merged(merged, out)
    assert counts == {"keep": 0, "update": 0, "insert": 1, "reject": 0}
    with pytest.raises(ValueError):
        tables.write_merged(merge.insert_if_absent(spark.read.parquet(out), src, "keyword"), out,
                            mode="overwrite")


def ingest_rows(df):
    from crawlq.plans.normalize import normalize_keyword_rows

    return normalize_keyword_rows(df, now())


def test_to_batch(spark):
    assert tables.to_batch(spark, []) is None
    assert tables.to_batch(spark, {"a": 1}).count() == 1
    with pytest.raises(TypeError):
        tables.to_batch(spark, 42)


def test_append_rows_rejects_missing_required(spark):
    root = tempfile.mkdtemp(prefix="crawlq-append-")
    path = os.path.join(root, "urls")
    schema = table_schema("social", "urls")
    good = spark.createDataFrame([("1", "a", "u", "pending", ts(0), ts(0), "junk")],
                                 "id string, account_id string, url string, status string, "
                                 "created_at timestamp_ntz, updated_at timestamp_ntz, extra string")
    bad = good.withColumn("status", F.lit(None).cast("string")).withColumn("id", F.lit("2"))
    rejected = tables.append_rows(good.unionByName(bad), path, schema, "urls")
    assert rows(rejected, "id") == [("2",)]
    assert spark.read.parquet(path).count() == 1


def test_stream_append_and_upsert(spark):
    root = tempfile.mkdtemp(prefix="crawlq-stream-")
    src = os.path.join(root, "in")
    spark.createDataFrame([("1", "completed"), ("9", "processing")], "id string, status string") \
        .write.parquet(src)
    schema = spark.read.parquet(src).schema
    landed = stream.stream_append(spark, stream.file_stream(spark, src, schema),
                                  os.path.join(root, "landed"), os.path.join(root, "ck1"))
    assert landed.count() == 2
    target = spark.createDataFrame([url_row(1, "a"), url_row(2, "b")], URLS_DDL)
    out = stream.stream_upsert(spark, target, stream.file_stream(spark, src, schema),
                               lambda t, p: merge.patch_status(t, p, now()), key="id",
                               path=os.path.join(root, "landed2"),
                               checkpoint=os.path.join(root, "ck2"))
    got = {r["id"]: (r["status"], r["_action"]) for r in out.collect()}
    assert got == {"1": ("completed", "update"), "2": ("pending", "keep"),
                   "9": ("processing", "reject")}


def test_stream_upsert_latest_arrival_wins(spark):
    import time

    root = tempfile.mkdtemp(prefix="crawlq-stream2-")
    src = os.path.join(root, "in")
    first = spark.createDataFrame([("1", "processing"), ("2", "failed")], "id string, status string")
    first.coalesce(1).write.parquet(os.path.join(src, "a"))
    time.sleep(1.1)  # the file source orders files by modification time
    second = spark.createDataFrame([("1", "completed")], "id string, status string")
    second.coalesce(1).write.parquet(os.path.join(src, "b"))
    schema = first.schema
    patches = (spark.readStream.schema(schema).option("maxFilesPerTrigger", "1")
               .option("recursiveFileLookup", "true").parquet(src))
    target = spark.createDataFrame([url_row(1, "a"), url_row(2, "b")], URLS_DDL)
    out = stream.stream_upsert(spark, target, patches,
                               lambda t, p: merge.patch_status(t, p, now()), key="id",
                               path=os.path.join(root, "landed"), checkpoint=os.path.join(root, "ck"))
    got = {r["id"]: (r["status"], r["processed_at"]) for r in out.collect()}
    assert got == {"1": ("completed", dt.datetime(2025, 1, 1)), "2": ("failed", None)}  # the stamp of the first patch stays
    arrivals = spark.read.parquet(os.path.join(root, "landed")).select(stream.ARRIVAL_COL).distinct()
    assert arrivals.count() == 2  # two micro-batches


def test_merge_landed_since_picks_only_new_arrivals(spark):
    import time

    root = tempfile.mkdtemp(prefix="crawlq-stream3-")
    src, landed, ck = (os.path.join(root, d) for d in ("in", "landed", "ck"))
    schema = "id string, status string"
    spark.createDataFrame([("1", "processing")], schema).coalesce(1).write.parquet(os.path.join(src, "a"))

    def patches():
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)

    stream.land(patches(), landed, ck).awaitTermination()
    first_arrival = spark.read.parquet(landed).agg(F.max(stream.ARRIVAL_COL)).first()[0]
    time.sleep(1.1)
    spark.createDataFrame([("2", "failed")], schema).coalesce(1).write.parquet(os.path.join(src, "b"))
    stream.land(patches(), landed, ck).awaitTermination()  # same checkpoint: only the new file
    target = spark.createDataFrame([url_row(1, "a"), url_row(2, "b")], URLS_DDL)
    apply = lambda t, p: merge.patch_status(t, p, now())
    new_only = stream.merge_landed(spark, target, landed, apply, "id", since=first_arrival)
    got = {r["id"]: (r["status"], r["_action"]) for r in new_only.collect()}
    assert got == {"1": ("pending", "keep"), "2": ("failed", "update")}
    everything = stream.merge_landed(spark, target, landed, apply, "id")
    assert {r["id"]: r["status"] for r in everything.collect()} == {"1": "processing", "2": "failed"}


def test_patches_of_one_id_fold_in_order(spark):
    target = spark.createDataFrame([url_row(1, "a"), url_row(2, "b")], URLS_DDL)
    patch = spark.createDataFrame(
        [("1", "completed", 2), ("1", "processing", 1), ("2", "failed", 1), ("2", "pending", 5)],
        "id string, status string, seq int")
    out = merge.patch_status(target, patch, now(), order="seq")
    got = {r["id"]: (r["status"], r["processed_at"], r["_action"]) for r in out.collect()}
    assert got == {"1": ("completed", dt.datetime(2025, 1, 1), "update"), "2": ("pending", None, "update")}
    one_by_one = target
    for s in (1, 2, 5):
        one_by_one = merge.table_rows(merge.patch_status(one_by_one, patch.filter(f"seq = {s}"), now()))
    assert {r["id"]: (r["status"], r["processed_at"]) for r in one_by_one.collect()} == \
        {k: v[:2] for k, v in got.items()}


def test_claims_of_one_id_last_wins(spark):
    target = spark.createDataFrame([("1", "k", None, "pending", 0)],
                                   "id string, keyword string, extension_id string, status string, start bigint")
    patch = spark.createDataFrame([("1", "x", 1, 7), ("1", "y", 2, 9), ("1", "", 3, None)],
                                  "id string, extension_id string, seq int, start int")
    owner = merge.claim_owner(target, patch, now(), order="seq")
    assert sorted((r["extension_id"], r["_action"]) for r in owner.collect()) == [("", "reject"), ("y", "update")]
    cursor = merge.advance_cursor(target, patch, now(), order="seq")
    assert sorted((str(r["start"]), r["_action"]) for r in cursor.collect()) == [("9", "update"), ("None", "reject")]


def test_keyset_page_equals_offset_page(spark):
    days = [dt.datetime(2024, 1, d) for d in (3, 3, 2, 1)] + [None, None]
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(days)], "id string, created_at timestamp_ntz")
    df = df.selectExpr("id", "'u' AS url", "'pending' AS status", "'' AS extension_id", "created_at",
                       "created_at AS updated_at")
    whole = [(r["id"], r["created_at"]) for r in queue_reads.seed_page(df, limit=10).collect()]
    for k, (i, at) in enumerate(whole):
        page = queue_reads.seed_page(df, limit=10, after=(at, i)).collect()
        assert [r["id"] for r in page] == [x for x, _ in whole[k + 1:]]


def test_keyword_conflict_list(spark):
    batch = spark.createDataFrame([(1, " a "), (1, "b"), (2, "b"), (2, "")], "b int, keyword string")
    queue = spark.createDataFrame([("a s",)], "keyword string")
    got = rows(ingest.keyword_conflict_list(batch, queue, suffix=" s", batch_col="b"), "b", "original", "exists")
    assert got == [(1, "a", True), (1, "b", False), (2, "b", False)]


def test_profile_social_single_writes_an_account_once(spark):
    batch = spark.createDataFrame([("a", "ann", 2), ("a", "amy", 1), ("b", "bob", 3)],
                                  "account_id string, username string, seq int")
    profiles = spark.createDataFrame([], "id string, account_id string, username string, "
                                         "created_at timestamp_ntz, updated_at timestamp_ntz")
    urls = spark.createDataFrame([], "id string, account_id string")
    prof, _ = ingest.ingest_profile_social(batch, profiles, urls, now=now(), order="seq")
    assert rows(prof, "account_id", "username", "_action") == [("a", "amy", "insert"), ("b", "bob", "insert")]


# ------------------------------------------------------- requests in their order

def _one_by_one(items, queued=()):
    taken, out = set(queued), {}
    for r in sorted({r for r, _ in items if r is not None}):
        keys = {k for x, k in items if x == r and k is not None}
        if keys:
            out[r] = not keys & taken
            taken |= keys if out[r] else set()
    return out


@pytest.mark.parametrize("seed, small", [(0, 0), (1, 30), (1, 200_000)])
def test_decide_in_order_equals_one_by_one(spark, monkeypatch, seed, small):
    """``small``: rounds to the end, rounds and then one task, one task."""
    monkeypatch.setattr(merge, "BROADCAST_MAX_ROWS", small)
    from crawlq.operators.request_order import decide_in_order

    rnd = random.Random(seed)
    items = [(rnd.randrange(60), f"k{rnd.randrange(40) if rnd.random() < 0.7 else 0}") for _ in range(60 + 90 * seed)]
    items += [(None, "k1"), (7, None)] + [(100 + i + d, f"chain{i}") for i in range(4) for d in (0, 1)]
    got = decide_in_order(spark.createDataFrame(items, "r int, k string"), "r", "k")
    assert {r.r: r.accepted for r in got.collect()} == _one_by_one(items)


def test_decide_in_order_of_nothing(spark):
    from crawlq.operators.request_order import decide_in_order

    got = decide_in_order(spark.createDataFrame([(None, "a")], "r int, k string"), "r", "k")
    assert got.collect() == [] and got.columns == ["r", "accepted"]


def test_keyword_requests_in_order(spark):
    """2 names a keyword of 1, 3 one of 2: 2 goes, so 3 stays; 4 names a queued one, so 5 stays."""
    queue = spark.createDataFrame([("1", "old s", None, 0, "pending", None, ts(0), ts(0))],
                                  "id string, keyword string, extension_id string, start bigint, status string, "
                                  "processed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz")
    asked = [(1, "a"), (1, " a "), (2, "a"), (2, "b"), (3, "b"), (3, ""), (4, "old"), (4, "c"), (5, "c"), (None, "z")]
    batch = spark.createDataFrame(asked, "b int, keyword string")
    out = ingest.create_keywords(batch, queue, suffix=" s", batch_col="b", now=now(), in_order=True)
    out = out.collect()
    assert sorted((r.keyword, r._action) for r in out) == [
        ("a s", "insert"), ("a s", "reject"), ("b s", "insert"), ("b s", "reject"), ("c s", "insert"), ("c s", "reject"),
        ("old s", "keep"), ("old s", "reject"), ("z s", "reject")]
    ids = [r.id for r in out if r._action == "insert"]
    assert len(set(ids)) == 3 and None not in ids
    got = ingest.keyword_conflicts_in_order(batch.where("b is not null"), queue, "b", suffix=" s")
    assert rows(got) == [(1, 0, 1, "all_new"), (2, 1, 1, "some_exist"), (3, 0, 1, "all_new"), (4, 1, 1, "some_exist"), (5, 0, 1, "all_new")]
    with pytest.raises(ValueError):
        ingest.create_keywords(batch, queue, in_order=True)


def test_large_batch_of_few_keys_meets_them_without_a_shuffle(spark):
    batch = spark.range(200).select(F.col("id").alias("b"), F.when(F.col("id") % 5 < 4, F.concat(F.lit("k"), F.col("id") % 5)).alias("k"))
    got = joins.key_exists(batch, spark.createDataFrame([("k1",), ("k1",), ("k3",), (None,)], "k string"), "k", small=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.b for r in got.collect() if r.exists) == [i for i in range(200) if i % 5 in (1, 3)] and got.count() == 200
