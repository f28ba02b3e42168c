"""Row numbers by ranges, pages at any offset, dealt work, maintained roll-ups."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.operators import counts, dealing, merge, ranks, stats
from crawlq.sources import pages

T0 = dt.datetime(2025, 1, 1)
KW = "id string, status string, extension_id string, created_at timestamp_ntz, processed_at timestamp_ntz, updated_at timestamp_ntz"


def test_ranked_equals_sorted_position(spark):
    rng = random.Random(1)
    data = [(str(i), rng.choice([None, 1, 1, 1, 2, 3])) for i in range(3000)]  # one value holds half the rows
    df = spark.createDataFrame(data, "id string, v int").repartition(7)
    got = ranks.ranked(df, [F.col("v").asc_nulls_first(), F.col("id")])
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [(r["id"], r["v"]) for r in got.orderBy("rank").collect()] == want
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(3000))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_ranked_of_an_empty_table(spark):
    assert ranks.ranked(spark.createDataFrame([], "id string"), [F.col("id")]).count() == 0


@pytest.mark.parametrize("offset", [0, 1, 499, 1990, 1999, 2000, 10_000_000])
def test_page_at_any_offset_reads_few_ranges(spark, tmp_path_factory, offset):
    path = str(tmp_path_factory.getbasetemp() / "pages")
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 50).alias("v"))
    order = [F.col("v").desc(), F.col("id").asc()]
    try:
        spark.read.parquet(f"{path}/index")
    except Exception:  # first case: store it
        old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        pages.write_pages(df, path, order)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    got = pages.read_page(spark, path, df.schema, 30, offset)
    want = sorted(((str(i), i % 50) for i in range(2000)), key=lambda r: (-r[1], r[0]))[offset:offset + 30]
    assert [tuple(r) for r in got.collect()] == want
    used = spark.read.parquet(f"{path}/rows").select("_part").distinct().count()
    assert used == 8
    read = {r[0] for r in got.select(F.input_file_name()).collect()}
    assert len(read) <= 2


def _queue(rng, n):
    out = []
    for i in range(n):
        status = rng.choice(["pending"] * 5 + ["processing"] * 3 + ["completed", None])
        owner = rng.choice([None, "", "a", "b", "hot", "hot", "hot", "gone"])
        at = rng.choice([None, T0, T0 + dt.timedelta(days=rng.randrange(9))])
        out.append((str(i), status, owner, at, None, None))
    return out


def _serial_deal(queue, workers, limit):
    age = lambda r: (r[3] is not None, r[3] or T0, r[0])
    names = sorted({w for w in workers if w})
    got = {w: [r[0] for r in sorted(queue, key=age) if r[1] == "processing" and r[2] == w][:limit] for w in names}
    out = {(k, w, i, False) for w, ids in got.items() for i, k in enumerate(ids)}
    pending = [r[0] for r in sorted(queue, key=age) if r[1] == "pending" and not r[2]]
    open_ = {w: limit - len(ids) for w, ids in got.items()}
    for turn in range(limit):
        for w in names:
            if turn < open_[w] and pending:
                out.add((pending.pop(0), w, len(got[w]) + turn, True))
    return out


@pytest.mark.parametrize("seed,limit", [(0, 3), (1, 20), (2, 400)])
def test_deal_equals_serving_the_workers_in_turn(spark, seed, limit):
    queue = _queue(random.Random(seed), 500)
    workers = ["a", "b", "hot", "idle", "a", None, ""]
    got = dealing.deal(spark.createDataFrame(queue, KW), spark.createDataFrame([(w,) for w in workers], "extension_id string"), limit)
    out = [tuple(r) for r in got.collect()]
    assert set(out) == _serial_deal(queue, workers, limit)
    assert len({r[0] for r in out}) == len(out)  # no row twice


def test_claimed_rows_are_the_dealt_ones_and_a_second_deal_keeps_them(spark):
    queue = spark.createDataFrame(_queue(random.Random(4), 300), KW)
    workers = spark.createDataFrame([("a",), ("idle",)], "extension_id string")
    dealt, merged = dealing.deal_and_claim(queue, workers, 4, F.expr("TIMESTAMP_NTZ '2025-02-01 00:00:00'"))
    after = merge.table_rows(merged)
    again = dealing.deal(after, workers, 4)
    assert {(r["id"], r["extension_id"]) for r in again.collect()} == {(r["id"], r["extension_id"]) for r in dealt.collect()}
    assert again.filter("fresh").count() == 0


def test_deal_without_workers_or_rows(spark):
    queue, none = spark.createDataFrame(_queue(random.Random(4), 50), KW), spark.createDataFrame([], "extension_id string")
    assert dealing.deal(queue, none, 5).count() == 0
    one = spark.createDataFrame([("a",)], "extension_id string")
    assert dealing.deal(queue.limit(0), one, 5).count() == 0


URLS = "id string, account_id string, status string, crawl_depth int, processed_at timestamp_ntz, updated_at timestamp_ntz"


def test_three_merges_maintain_the_report(spark):
    rng = random.Random(3)
    urls = spark.createDataFrame([(str(i), rng.choice(["x", "x", "y", "z", None]), rng.choice([None, "", "pending", "completed"]),
                                   rng.choice([None, 0, 1, 2]), None, None) for i in range(200)], URLS)
    profiles = spark.createDataFrame([(str(i), rng.choice(["x", "y", "w"])) for i in range(30)], "id string, account_id string")
    seeds = spark.createDataFrame([(str(i), rng.choice([None, "failed"]), rng.choice([None, "", "e1"])) for i in range(40)],
                                  "id string, status string, extension_id string")
    now = F.expr("TIMESTAMP_NTZ '2025-02-01 00:00:00'")
    report = stats.stats_report(seeds, urls, profiles)
    for step in range(3):
        patch = spark.createDataFrame([(str(i), rng.choice(["completed", "failed"])) for i in rng.sample(range(250), 60)], "id string, status string")
        m_urls = merge.patch_status(counts.tracked(urls, *counts.URL_COLS), patch, now, on_missing="insert")
        claims = spark.createDataFrame([(str(i), f"e{step}") for i in range(0, 40, 3)], "id string, extension_id string")
        m_seeds = merge.upsert(counts.tracked(seeds, *counts.SEED_COLS), claims, "id")
        more = spark.createDataFrame([(str(100 + 10 * step + i), rng.choice(["x", "z"])) for i in range(5)], "id string, account_id string")
        m_prof = merge.upsert(counts.tracked(profiles, *counts.PROFILE_COLS), more, "id")
        after = merge.table_rows(m_urls).drop("_before")
        report = counts.maintained(report, counts.seed_changes(m_seeds), counts.url_changes(m_urls),
                                   counts.profile_changes(m_urls, profiles, m_prof, after))
        urls, seeds, profiles = (merge.materialize(d) for d in (
            after, merge.table_rows(m_seeds).drop("_before"), merge.table_rows(m_prof).drop("_before")))
        report = merge.materialize(report)
        assert rows(report, "section", "dim1", "dim2", "n") == rows(
            stats.stats_report(seeds, urls, profiles), "section", "dim1", "dim2", "n")


def test_changes_of_another_report_fail(spark):
    report = spark.createDataFrame([("seed_urls", "a", "b", 1)], "section string, dim1 string, dim2 string, n long")
    wrong = spark.createDataFrame([("seed_urls", "a", "b", -2)], "section string, dim1 string, dim2 string, n long")
    with pytest.raises(Exception, match="negative count"):
        counts.maintained(report, wrong).collect()
