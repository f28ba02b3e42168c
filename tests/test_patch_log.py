"""Mixed patch logs: replay in batch and in a state store against one-by-one application."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.operators import merge, patch_log
from crawlq.streaming import stateful, stream

QUEUE = "id string, keyword string, extension_id string, start int, status string, processed_at timestamp_ntz, updated_at timestamp_ntz"
LOG = "id string, seq long, kind string, status string, extension_id string, start int, at timestamp_ntz"
T0 = dt.datetime(2025, 1, 1)


def make_log(rng, n, ids):
    out = []
    for seq in range(n):
        out.append((rng.choice(ids), seq, rng.choice(["status", "owner", "claim", "cursor", "other", None]),
                    rng.choice(["pending", "processing", "failed", None]),
                    rng.choice(["ext_1", "ext_2", "", None]), rng.choice([0, 10, 20, None]),
                    T0 + dt.timedelta(seconds=seq)))
    return out


def one_by_one(queue, log):
    """The queue after each patch applied by itself, and the number of rejects."""
    table, unknown, bad = {r[0]: list(r) for r in queue}, set(), 0
    for key, _seq, kind, status, owner, start, at in sorted(log, key=lambda r: r[1]):
        ok = bool(key) and (kind == "status" or (kind in ("owner", "claim") and owner)
                            or (kind == "cursor" and start is not None))
        if not ok:
            bad += 1
            continue
        if key not in table:
            unknown.add(key)
            continue
        row = table[key]
        if kind == "claim":
            status = "processing"
        if kind in ("status", "claim"):
            row[4] = status
            if status == "processing":
                row[5] = at
        if kind in ("owner", "claim"):
            row[2] = owner
        if kind == "cursor":
            row[3] = start
        row[6] = at
    return sorted(map(tuple, table.values()), key=repr), len(unknown) + bad


QUEUE_ROWS = [(str(i), f"k{i}", None, i, "pending", None, None) for i in range(12)]
IDS = [str(i) for i in range(15)] + ["", None, "3", "3", "3", "3"]  # a hot id, unknown and missing ones


@pytest.mark.parametrize("seed", range(3))
def test_replay_of_a_shuffled_log_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    log = make_log(rng, 1000, IDS)
    want, n_reject = one_by_one(QUEUE_ROWS, log)
    rng.shuffle(log)
    merged = patch_log.replay(spark.createDataFrame(QUEUE_ROWS, QUEUE),
                              spark.createDataFrame(log, LOG), "seq", stamp="at")
    assert rows(merge.table_rows(merged)) == want
    assert merged.filter("_action = 'reject'").count() == n_reject


def test_empty_log_and_table_without_cursor(spark):
    queue = spark.createDataFrame(QUEUE_ROWS, QUEUE)
    out = patch_log.replay(queue, spark.createDataFrame([], LOG), "seq", stamp="at")
    assert rows(merge.table_rows(out)) == rows(queue)
    log = spark.createDataFrame([("1", 1, "claim", None, "e", None, T0), ("1", 2, "cursor", None, None, 7, T0)], LOG)
    out = patch_log.replay(queue.drop("start"), log, "seq", stamp="at").filter("id = '1'").first()
    assert (out["status"], out["extension_id"], out["_action"]) == ("processing", "e", "update")


def test_explicit_null_status_overwrites(spark):
    log = spark.createDataFrame([("1", 1, "status", None, "x", 3, T0)], LOG)
    out = patch_log.replay(spark.createDataFrame(QUEUE_ROWS, QUEUE), log, "seq", stamp="at").filter("id = '1'").first()
    assert (out["status"], out["extension_id"], out["start"]) == (None, None, 1)


def test_refold_of_parts_is_the_fold(spark):
    log = spark.createDataFrame(make_log(random.Random(5), 300, IDS), LOG)
    parts = [patch_log.fold(log.filter(F.col("seq") % 3 == r), "seq", stamp="at") for r in range(3)]
    both = patch_log.refold(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert rows(both) == rows(patch_log.fold(log, "seq", stamp="at"))


def _write(spark, log, path):
    spark.createDataFrame(log, LOG).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_any_cut_into_micro_batches_gives_the_same_table(spark, tmp_path, files_per_batch):
    log = make_log(random.Random(9), 400, IDS)
    want, n_reject = one_by_one(QUEUE_ROWS, log)
    src = str(tmp_path / "in")
    for part in (log[200:300], log[:200], log[300:]):  # the first files hold later patches
        _write(spark, part, src)
    merged = stateful.stream_patch_log(
        spark, spark.createDataFrame(QUEUE_ROWS, QUEUE),
        stream.file_stream(spark, src, spark.createDataFrame([], LOG).schema, max_files_per_trigger=files_per_batch),
        "seq", stamp="at", checkpoint=str(tmp_path / "ckpt"))
    assert rows(merge.table_rows(merged)) == want
    assert merged.filter("_action = 'reject'").count() == n_reject


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    log = make_log(random.Random(11), 400, IDS)
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    schema = spark.createDataFrame([], LOG).schema
    queue = spark.createDataFrame(QUEUE_ROWS, QUEUE)

    def run():
        return stateful.stream_patch_log(spark, queue, stream.file_stream(spark, src, schema), "seq",
                                         stamp="at", checkpoint=ckpt)

    _write(spark, log[250:], src)
    assert rows(merge.table_rows(run())) == one_by_one(QUEUE_ROWS, log[250:])[0]
    _write(spark, log[:250], src)  # late: older than what the state holds
    merged = run()
    want, n_reject = one_by_one(QUEUE_ROWS, log)
    assert rows(merge.table_rows(merged)) == want
    assert merged.filter("_action = 'reject'").count() == n_reject
    assert rows(merge.table_rows(run())) == want  # nothing new: the same again
