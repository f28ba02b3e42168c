"""Edge cases of operators otherwise covered only by the oracle queries."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.constants import ALLOWED_KEYWORD_PATCH, ALLOWED_STATUS_PATCH
from crawlq.functions import columns as C
from crawlq.operators import frontier, ingest, joins, merge, queue_reads, stats
from crawlq.plans import normalize as N
from crawlq.sources import tables
from crawlq.sources.schemas import table_schema

T0 = dt.datetime(2024, 1, 1)
SEED_DDL = ("id string, url string, extension_id string, max_profiles bigint, status string, "
            "created_at timestamp_ntz, updated_at timestamp_ntz")


def now():
    return F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")


def seed(i, status, owner, day, maxp=None):
    return (str(i), f"u{i}", owner, maxp, status, T0 + dt.timedelta(days=day), T0)


def test_seed_pending_mine_first_and_null_status(spark):
    df = spark.createDataFrame([
        seed(1, "pending", "other", 1), seed(2, None, None, 0), seed(3, "processing", "me", 5),
        seed(4, "processing", "other", 0), seed(5, "completed", "me", 0)], SEED_DDL)
    got = [(r["id"], r["max_profiles"]) for r in queue_reads.seed_pending(df, "me").collect()]
    assert got == [("3", None), ("2", None), ("1", None)]


def test_urls_by_keyword_and_profile_page(spark):
    df = spark.createDataFrame([("1", "u1", "pending", "k", T0), ("2", "u2", "done", "k", T0 - dt.timedelta(1)),
                                ("3", "u3", "done", "z", T0)],
                               "id string, url string, status string, keyword_id string, created_at timestamp_ntz")
    assert [r["id"] for r in queue_reads.urls_by_keyword(df, "k").collect()] == ["2", "1"]
    prof = spark.createDataFrame([(str(i), f"n{i}", "t", "l", T0 + dt.timedelta(i)) for i in range(4)],
                                 "id string, username string, title string, location string, updated_at timestamp_ntz")
    page = queue_reads.profile_page(prof, limit=2, offset=1)
    assert [r["id"] for r in page.collect()] == ["2", "1"] and page.columns == ["id", "username", "title", "location"]


def test_allowed_patch(spark):
    p = spark.createDataFrame([("1", "done", 5, "x")], "id string, status string, start int, junk string")
    assert queue_reads.allowed_patch(p, ALLOWED_KEYWORD_PATCH).columns == ["id", "status", "start"]
    assert queue_reads.allowed_patch(p, ALLOWED_STATUS_PATCH).columns == ["id", "status"]
    with pytest.raises(ValueError):
        queue_reads.allowed_patch(p.select("id", "junk"), ALLOWED_STATUS_PATCH)


def test_semi_anti_and_key_probe(spark):
    urls = spark.createDataFrame([("1", "a", "p"), ("2", "b", None), ("3", "c", "q"), ("4", "a", "p")],
                                 "id string, account_id string, parent_account_id string")
    parents = spark.createDataFrame([("p",), ("p",), (None,)], "account_id string")
    assert rows(joins.parent_in(urls, parents), "id") == [("1",), ("4",)]
    prof = spark.createDataFrame([("a",), ("z",), (None,)], "account_id string")
    assert rows(joins.not_exists(prof, urls, "account_id")) == [("z",), (None,)] or \
        rows(joins.not_exists(prof, urls, "account_id")) == [(None,), ("z",)]
    for small in (True, False):
        flagged = joins.key_exists(prof, urls, "account_id", small=small)
        assert rows(flagged) == sorted([("a", True), ("z", False), (None, False)], key=repr)
        keys = merge.matched_keys(urls, prof, "account_id", small)
        assert rows(keys) == [("a",)]


def test_stats_by_owner_keeps_nulls_and_report_sections(spark):
    seeds = spark.createDataFrame([("pending", None), ("pending", None), (None, "x")],
                                  "status string, extension_id string")
    assert rows(stats.stats_by_owner(seeds)) == sorted([("pending", None, 2), (None, "x", 1)], key=repr)
    urls = spark.createDataFrame([("a", "done", 2), ("b", None, None)],
                                 "account_id string, status string, crawl_depth bigint")
    prof = spark.createDataFrame([("a",)], "account_id string")
    rep = stats.stats_report(seeds, urls, prof, seeds, urls)
    got = rows(rep)
    assert ("profiles", "2", "done", 1) in got
    assert ("profile_urls", "1", "pending", 1) in got
    assert ("seed_urls_v1", "pending", "unassigned", 2) in got
    assert {r[0] for r in got} == {"seed_urls", "profile_urls", "profiles", "seed_urls_v1",
                                   "profile_urls_v1"}


def test_claim_owner_requires_owner(spark):
    kw = spark.createDataFrame([("k1", None, T0)], "id string, extension_id string, updated_at timestamp_ntz")
    p = spark.createDataFrame([("k1", "e1"), ("k1", ""), ("k2", "e2")], "id string, extension_id string")
    out = merge.claim_owner(kw, p, now())
    got = sorted((r["id"], r["extension_id"], r["_action"]) for r in out.collect())
    assert got == [("k1", "", "reject"), ("k1", "e1", "update"), ("k2", "e2", "reject")]


def test_enqueue_urls_pro_derives_account(spark):
    queue = spark.createDataFrame([("1", "old", "u", "pending", T0, T0)],
                                  "id string, account_id string, url string, status string, "
                                  "created_at timestamp_ntz, updated_at timestamp_ntz")
    batch = spark.createDataFrame([("https://x/in/old/",), ("https://x/in/new?a=1",),
                                   ("https://x/in/new#b",), ("https://x/other",)], "url string")
    out = merge.inserted_rows(ingest.enqueue_urls(batch, queue, platform="pro", now=now()))
    assert rows(out, "account_id", "status") == [("new", "pending"), ("new", "pending")]
    social = ingest.enqueue_urls(batch.withColumn("account_id", F.lit("s")), queue, now=now())
    assert merge.inserted_rows(social).count() == 4


def test_ingest_profile_pro_single_and_batch(spark):
    ddl = "account_id string, username string, posts array<struct<content:string,time:string>>"
    target = spark.createDataFrame([("a", "old", None)], ddl).withColumn("created_at", F.lit(T0)) \
        .withColumn("updated_at", F.lit(T0)).withColumn("id", F.lit("pid"))
    batch = spark.createDataFrame([("a", "new", [("c", "2 hrs"), None]), ("b", "bee", None)], ddl)
    single = {r["account_id"]: r for r in ingest.ingest_profile_pro(batch, target, now=now()).collect()}
    assert single["a"]["username"] == "new" and single["a"]["_action"] == "update"
    assert [tuple(p) for p in single["a"]["posts"]] == [("c", "2025-01-01T00:00:00+00:00")]
    assert single["a"]["created_at"] == dt.datetime(2025, 1, 1)  # batch value overwrites
    appended = ingest.ingest_profile_pro(batch, target, mode="batch", now=now())
    assert appended.filter("_action = 'insert'").count() == 2 and appended.count() == 3


def test_ingest_profile_social_frontier(spark):
    batch = spark.createDataFrame([
        ("a", "ann", 1, ["f1", None, "f2"]), ("b", "null", 1, ["f3"]), ("c", "cat", 3, ["f4"])],
        "account_id string, username string, crawl_depth bigint, friend_lists array<string>")
    profiles = spark.createDataFrame([], "id string, account_id string, username string, "
                                         "created_at timestamp_ntz, updated_at timestamp_ntz")
    urls = spark.createDataFrame([("1", "f2", "u", 1, "pending", T0, T0)],
                                 "id string, account_id string, url string, crawl_depth bigint, "
                                 "status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    prof, new_urls = ingest.ingest_profile_social(batch, profiles, urls, url_base="h/", now=now())
    assert rows(prof, "account_id", "_action") == [("a", "insert"), ("b", "reject"), ("c", "insert")]
    got = rows(merge.inserted_rows(new_urls), "account_id", "url", "crawl_depth")
    assert got == [("f1", "h/f1", 2)]  # f2 queued, b rejected, c at max depth


def test_friend_edges_default_depth(spark):
    prof = spark.createDataFrame([("p", [1, 2])], "account_id string, friend_lists array<int>")
    got = rows(frontier.friend_edges(prof), "parent_account_id", "account_id", "parent_depth")
    assert got == [("p", "1", 1), ("p", "2", 1)]


def test_json_ready_and_iso(spark):
    df = spark.createDataFrame([("a", [None, "x"], dt.datetime(2024, 1, 2, 3, 4, 5))],
                               "id string, tags array<string>, ts timestamp_ntz")
    doc = json.loads(C.json_ready(df).first()["json"])
    assert doc["tags"] == ["x"] and doc["ts"].startswith("2024-01-02T03:04:05")
    nulls = spark.createDataFrame([(None,)], "id string")
    assert json.loads(C.json_ready(nulls).first()["json"]) == {"id": None}


def test_transform_and_validate_keywords(spark):
    df = spark.createDataFrame([("kw",)], "keyword string")
    out = N.transform_and_validate(df, "pro", "keywords", now(), F.lit("id-1"))
    r = out.first()
    assert (r["id"], r["status"], r["start"], r["_reject_reason"]) == ("id-1", "pending", 0, None)
    url = spark.createDataFrame([("i", None)], "id string, url string")
    bad = N.transform_and_validate(url, "social", "urls", now())
    assert bad.first()["_reject_reason"] == "missing required fields"


def test_loads(spark):
    schema = table_schema("social", "urls")
    text = spark.createDataFrame([('{"id": "1", "crawl_depth": 2, "junk": true}',)], "value string")
    r = tables.load_nested(text, schema).first()
    assert r["id"] == "1" and r["crawl_depth"] == 2 and r["url"] is None
    flat = spark.createDataFrame([("1", 7, "x")], "id string, parent_account_id int, junk string")
    out = tables.load_flat(flat, [f.name for f in schema.fields])
    assert out.columns == ["id", "parent_account_id"] and out.first()["parent_account_id"] == "7"


def test_empty_batch_is_a_no_op(spark):
    target = spark.createDataFrame([("a", "x")], "id string, status string")
    empty = spark.createDataFrame([], "id string, status string")
    for out in (merge.upsert(target, empty, "id"), merge.insert_if_absent(target, empty, "id")):
        assert rows(out) == [("a", "x", "keep")]


NESTED_PROFILE = json.dumps({
    "account_id": "acc1", "username": "u", "title": "eng",
    "experiences": [{
        "company": {"name": "Co", "employees": {"start": 10, "end": 50}},
        "date": {"start": {"year": 2020, "month": 1}, "end": None},
        "profile_positions": [{"title": "dev", "date": {"start": {"year": 2021}}}],
    }],
    "skills": ["spark", None],
    "posts": [{"content": "hi", "time": "2 hrs", "num_reactions": 3}],
    "unknown_field": {"ignored": True},
})


def test_nested_profile_load_and_ingest(spark):
    schema = table_schema("pro", "profiles")
    raw = spark.createDataFrame([(NESTED_PROFILE,)], "value string")
    batch = tables.load_nested(raw, schema).drop("id", "created_at", "updated_at")
    r = batch.first()
    pos = r["experiences"][0]["profile_positions"][0]
    assert pos["title"] == "dev" and pos["date"]["start"]["year"] == 2021
    assert r["experiences"][0]["company"]["employees"]["end"] == 50
    empty = spark.createDataFrame([], schema)
    out = ingest.ingest_profile_pro(batch, empty, now=now(), id_expr=F.lit("pid"))
    got = out.first()
    assert got["_action"] == "insert" and got["id"] == "pid"
    assert got["posts"][0]["time"] == "2025-01-01T00:00:00+00:00"
    assert got["posts"][0]["num_reactions"] == 3


def test_seed_claim_accepts_empty_owner(spark):
    seeds = spark.createDataFrame([("s1", "old", T0)], "id string, extension_id string, updated_at timestamp_ntz")
    p = spark.createDataFrame([("s1", None)], "id string, extension_id string")
    out = merge.claim_owner(seeds, p, now(), require_owner=False)
    r = out.first()
    assert r["_action"] == "update" and r["extension_id"] is None


def test_patch_status_with_extra_owner_column(spark):
    seeds = spark.createDataFrame([("s1", "pending", "a", None, T0)],
                                  "id string, status string, extension_id string, "
                                  "processed_at timestamp_ntz, updated_at timestamp_ntz")
    p = spark.createDataFrame([("s1", "processing", "b")], "id string, status string, extension_id string")
    r = merge.patch_status(seeds, p, now(), extra=("extension_id",)).first()
    assert (r["status"], r["extension_id"], r["_action"]) == ("processing", "b", "update")
    assert r["processed_at"] == dt.datetime(2025, 1, 1)


def test_json_ready_drops_nested_null_items(spark):
    ddl = "id string, exp array<struct<title:string,pos:array<string>>>, meta struct<tags:array<int>>"
    df = spark.createDataFrame([("a", [("t", ["x", None]), None], ({"tags": [1, None]}))], ddl)
    doc = json.loads(C.json_ready(df).first()["json"])
    assert doc["exp"] == [{"title": "t", "pos": ["x"]}] and doc["meta"] == {"tags": [1]}
    nulls = spark.createDataFrame([("b", None, None)], ddl)
    assert json.loads(C.json_ready(nulls).first()["json"]) == {"id": "b", "exp": None, "meta": None}


def test_nested_rollup_map_form(spark):
    df = spark.createDataFrame([("pending", None), (None, ""), ("done", "x"), ("done", "x")],
                               "status string, extension_id string")
    rows = stats.nested_rollup(stats.stats_owner_rollup(df), "status", "extension_id").collect()
    assert {r["status"]: r["counts"] for r in rows} == {"done": {"x": 2}, "pending": {"unassigned": 2}}


def test_iso_time_forms(spark):
    texts = ["2024-01-01", "2024-01-01T10", "2024-01-01T10:00:00", "2024-01-01 10:00:00.5+01:00", "2024", "2024-1-5", "12:30", " 2024-01-01 ", "2 hrs", "2024-13-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["ok"] for r in df.select("t", C.is_iso_time("t").alias("ok")).collect()}
    assert [got[t] for t in texts] == [True] * 4 + [False] * 6


def test_keyword_requests_share_one_row_and_ids_differ(spark):
    from crawlq.operators import ingest, merge

    batch = spark.createDataFrame([(1, "new one"), (2, "new one"), (2, "new two")], "b long, keyword string")
    queue = spark.createDataFrame([("id0", "old" + ingest.KEYWORD_SITE_SUFFIX, "pending")], "id string, keyword string, status string")
    out = merge.inserted_rows(ingest.create_keywords(batch, queue, batch_col="b")).collect()
    assert len(out) == 2 and len({r["keyword"] for r in out}) == 2 and len({r["id"] for r in out}) == 2


def test_patch_without_status_and_v1_seed_reads(spark):
    from crawlq.operators import merge, queue_reads

    t = spark.createDataFrame([("a", "pending", 5, None, None)], "id string, status string, start long, processed_at timestamp, updated_at timestamp")
    out = merge.patch_status(t, spark.createDataFrame([("a", 9)], "id string, start long"), extra=["start"]).first()
    assert (out["status"], out["start"], out["processed_at"]) == ("pending", 9, None)
    seeds = spark.createDataFrame([("s", "u", "pending", None, None, None)], "id string, url string, status string, extension_id string, created_at timestamp, updated_at timestamp")
    assert queue_reads.seed_pending(seeds, "me").count() == 1 and queue_reads.seed_page(seeds).count() == 1
