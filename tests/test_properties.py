"""Property tests of the merge operators against a plain-Python model."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from crawlq.operators import merge

KEYS = st.sampled_from(["a", "b", "c", "d", "e", None])
STATUS = st.sampled_from(["pending", "done", None])
ROWS = st.lists(st.tuples(KEYS, STATUS), max_size=6)
DDL = "id string, status string"
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def table(spark, rows):
    return spark.createDataFrame(rows, DDL)


def as_set(df):
    return sorted((tuple(r) for r in merge.table_rows(df).collect()), key=repr)


def unique_keys(rows):
    seen, out = set(), []
    for k, v in rows:
        if k not in seen:
            seen.add(k)
            out.append((k, v))
    return out


@SETTINGS
@given(target=ROWS, source=ROWS, bmax=st.sampled_from([0, 1000]))
def test_upsert_matches_model_and_is_idempotent(spark, target, source, bmax):
    target = [r for r in unique_keys(target) if r[0] is not None]
    source = unique_keys(source)
    once = merge.upsert(table(spark, target), table(spark, source), "id", broadcast_max_rows=bmax)
    model = dict(target)
    model.update({k: v for k, v in source if k is not None})
    assert as_set(once) == sorted(model.items(), key=repr)
    twice = merge.upsert(merge.table_rows(once), table(spark, source), "id", broadcast_max_rows=bmax)
    assert as_set(twice) == as_set(once)


@SETTINGS
@given(target=ROWS, source=ROWS, bmax=st.sampled_from([0, 1000]))
def test_insert_if_absent_counts_and_idempotence(spark, target, source, bmax):
    tgt = table(spark, target)
    src = table(spark, source)
    out = merge.insert_if_absent(tgt, src, "id", broadcast_max_rows=bmax)
    existing = {k for k, _ in target}
    with_key = [r for r in source if r[0] is not None]
    expect_new = [r for r in with_key if r[0] not in existing]
    counts = {r[0]: r[1] for r in merge.affected_rows(out).collect()}
    inserted = counts.get("insert", 0)
    assert inserted == len(expect_new)
    assert inserted + (len(with_key) - len(expect_new)) == len(with_key)
    assert counts.get("keep", 0) == len(target)
    again = merge.insert_if_absent(merge.table_rows(out), src, "id", broadcast_max_rows=bmax)
    assert as_set(again) == as_set(out)


WS_TEXT = st.lists(st.text(alphabet=st.sampled_from(list(" \t\n\x0b\x0c\r\x85\xa0 　ab_é")),
                           max_size=8), min_size=1, max_size=40)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=WS_TEXT)
def test_strip_text_matches_python_strip(spark, texts):
    from crawlq.functions.columns import strip_text

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", strip_text("t").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [t.strip() for t in texts]
