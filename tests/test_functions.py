"""Column functions, normalisers and error-report rendering (hand-written cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from crawlq.functions import columns as C
from crawlq.functions import reports as R
from crawlq.plans import normalize as N


def now():
    return F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")


def one(spark, expr, ddl, *values):
    df = spark.createDataFrame([values], ddl)
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("url,expect", [
    ("https://x.example/in/name/?x=1#y", "name"),
    ("https://x.example/in/name?x=1#y", "name"),
    ("https://x.example/in/name#frag", "name"),
    ("https://x.example/in", None),
    ("https://x.example/in/", None),
    ("https://x.example/people/name", None),
    ("", None),
    (None, None),
])
def test_account_from_url(spark, url, expect):
    assert one(spark, C.account_from_url("u"), "u string", url) == expect


def test_account_from_url_python_split_rule(spark):
    # the token after the FIRST marker segment
    assert one(spark, C.account_from_url("u"), "u string", "https://a/in/in/x") == "in"


def test_normalize_keyword(spark):
    df = spark.createDataFrame([("a",), (" a ",), ("",), (None,), ("\t\n",)], "k string")
    got = rows(df.select(C.normalize_keyword("k", " site:s").alias("v")).distinct())
    assert got == [("a site:s",), (None,)] or got == [(None,), ("a site:s",)]


def test_strip_matches_python(spark):
    text = "　  x y \t\n "
    assert one(spark, C.strip_text("s"), "s string", text) == text.strip()


def test_nullify_literals(spark):
    df = spark.createDataFrame([("None",), ("null",), ("undefined",), ("",), ("x",), (None,)],
                               "a string")
    got = [r[0] for r in df.select(C.nullify_literals("a")).collect()]
    assert got == [None, None, None, None, "x", None]


def test_compact_string_array(spark):
    assert one(spark, C.compact_string_array("a"), "a array<string>", ["1", None, "2"]) == ["1", "2"]


def test_normalize_struct_array_json(spark):
    text = '[{"title": null, "time": "t", "x": 1}, "junk"]'
    got = one(spark, C.normalize_struct_array("a", ("title", "time"), json=True), "a string", text)
    assert [tuple(r) for r in got] == [("", "t")]


def test_normalize_struct_array_typed_with_null_item(spark):
    ddl = "a array<struct<title:string,time:string,description:string>>"
    got = one(spark, C.normalize_struct_array("a", ("title", "time"), ("description",),
                                              present=("title", "time", "description")),
              ddl, [("x", None, "d"), None])
    assert [tuple(r) for r in got] == [("x", "", None)]


@pytest.mark.parametrize("about,expect", [
    (None, ""), ('["a", "b", 3]', "a b 3"), ("[]", ""), ('{"k": 1}', '{"k": 1}'),
    ("{}", ""), ("plain text", "plain text"),
])
def test_flatten_about(spark, about, expect):
    assert one(spark, C.flatten_about("a"), "a string", about) == expect


def test_depth_default(spark):
    df = spark.createDataFrame([("2",), (None,)], "d string")
    assert [r[0] for r in df.select(C.depth_default("d")).collect()] == [2, 1]


def test_post_time_iso(spark):
    ddl = "p array<struct<content:string,time:string>>"
    posts = [("a", "2024-01-01T10:00:00.000Z"), ("b", "2 hrs"), ("c", None)]
    got = one(spark, C.post_time_iso("p", now()), ddl, posts)
    assert [r["time"] for r in got] == ["2024-01-01T10:00:00.000Z",
                                        "2025-01-01T00:00:00+00:00", None]


def test_iso_format_of_a_zoned_stamp_is_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark.sql("SELECT TIMESTAMP'2025-01-01 00:00:00Z' a, TIMESTAMP'2024-03-10 02:30:00.5Z' b, "
                        "TIMESTAMP_NTZ'2024-03-10 02:30:00' c, CAST(NULL AS TIMESTAMP) d").select(
            *[C.iso_format(x).alias(x) for x in "abcd"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == ("2025-01-01T00:00:00+00:00", "2024-03-10T02:30:00.500000+00:00",
                          "2024-03-10T02:30:00+00:00", None)


def test_iso_format_micros(spark):
    ts = dt.datetime(2025, 1, 2, 3, 4, 5, 678)
    assert one(spark, C.iso_format("t"), "t timestamp_ntz", ts) == "2025-01-02T03:04:05.000678+00:00"


def test_with_defaults_only_when_absent(spark):
    df = spark.createDataFrame([(None,)], "status string")
    out = C.with_defaults(df, {"status": F.lit("pending"), "start": F.lit(0)})
    assert out.first().asDict() == {"status": None, "start": 0}


def test_stable_id_is_deterministic(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    ids = [r[0] for r in df.select(C.stable_id("k")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 36


def test_required_fields_ok(spark):
    df = spark.createDataFrame([("1", "u", None)], "id string, url string, status string")
    df = df.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    assert df.select(C.required_fields_ok("urls", df.columns)).first()[0] is False
    assert df.select(C.required_fields_ok("keywords", df.columns)).first()[0] is True


def test_social_normaliser(spark):
    ddl = ("account_id string, username string, gender string, about string, crawl_depth string, "
           "friend_lists array<string>, experiences string")
    df = spark.createDataFrame([
        ("1", "ann", None, '["x", "y"]', None, ["1", None, "2"],
         '[{"title": null, "time": "t", "x": 1}, "junk"]'),
        ("undefined", "bob", "m", None, "2", None, None),
        ("3", "null", "f", None, "3", [], None),
    ], ddl)
    out = N.normalize_profile_social(N.clean_profile_social(df), now())
    got = {r["username"]: r for r in out.collect()}
    ann = got["ann"]
    assert ann["_reject_reason"] is None and ann["gender"] == "" and ann["about"] == "x y"
    assert ann["crawl_depth"] == 1 and ann["friend_lists"] == ["1", "2"]
    assert [tuple(e) for e in ann["experiences"]] == [("", "t", None)]
    assert ann["posts"] == [] and ann["educations"] == []
    assert got["bob"]["_reject_reason"] == "account_id is required"
    assert got[""]["_reject_reason"] == "username is required"
    assert N.valid_rows(out).count() == 1


def test_clean_rejects_missing_account(spark):
    df = spark.createDataFrame([("", "x"), (None, "y"), ("7", "z")], "account_id string, username string")
    out = N.clean_profile_social(df)
    assert N.rejected_rows(out).count() == 2


def test_transform_registry(spark):
    with pytest.raises(ValueError):
        N.transform_for("pro", "seed_urls")
    df = spark.createDataFrame([("https://x/in/bob/",)], "url string")
    out = N.transform_batch(df, "pro", "urls", now(), F.lit("id1"))
    r = out.first()
    assert r["account_id"] == "bob" and r["status"] == "pending" and r["id"] == "id1"
    seeds = N.transform_batch(spark.createDataFrame([("u",)], "url string"), "social", "seed_urls", now())
    assert seeds.first()["max_profiles"] == 100
    v1 = N.transform_batch(spark.createDataFrame([("u",)], "url string"), "social", "seed_urls_v1", now())
    assert "max_profiles" not in v1.columns


def test_error_subject(spark):
    df = spark.createDataFrame([("API", "beta site", "ext_1"), ("API", None, ""), ("API", "", None)],
                               "t string, p string, e string")
    got = [r[0] for r in df.select(R.error_subject("t", "p", "e")).collect()]
    assert got == ["API Error - Beta Site (ext_1)", "API Error", "API Error"]


def test_error_details_override_in_place(spark):
    df = spark.createDataFrame([("conn", "http://u", None, '{"url": "ctx", "browser": "b"}')],
                               "et string, url string, st string, ctx string")
    m = df.select(F.map_entries(R.error_details("et", "url", "st", R.context_map("ctx")))).first()[0]
    assert [tuple(e) for e in m] == [("error_type", "conn"), ("url", "ctx"), ("browser", "b")]


EXPECTED_FULL = (
    "Serp API Error Report\n"
    "=====================\n"
    "\n"
    "Error Message:\n"
    "boom\n"
    "\n"
    "Details:\n"
    "--------\n"
    "Timestamp: 2025-01-01 00:00:00\n"
    "Platform: Alpha\n"
    "Extension ID: ext_9\n"
    "\n"
    "Additional Information:\n"
    "-------------------------\n"
    "Error Type: parse\n"
    "Stack Info: s\n"
    "\n"
    "--\n"
    "This error report was automatically generated by the Extension Error.\n"
    "Please investigate and resolve the issue as soon as possible."
)

EXPECTED_BARE = (
    "Serp API Error Report\n"
    "=====================\n"
    "\n"
    "Error Message:\n"
    "boom\n"
    "\n"
    "Details:\n"
    "--------\n"
    "Timestamp: 2025-01-01 00:00:00\n"
    "\n"
    "--\n"
    "This error report was automatically generated by the Extension Error.\n"
    "Please investigate and resolve the issue as soon as possible."
)


def test_error_text_layout(spark):
    df = spark.createDataFrame([("Serp API", "boom", "ext_9", "alpha", "parse")],
                               "t string, m string, e string, p string, et string")
    det = R.error_details("et", F.lit(None).cast("string"), F.lit(None).cast("string"),
                          F.create_map(F.lit("stack_info"), F.lit("s")))
    got = df.select(R.error_text("t", "m", "e", "p", det, now())).first()[0]
    assert got == EXPECTED_FULL
    bare = df.select(R.error_text("t", "m", F.lit(None).cast("string"), F.lit(""),
                                  F.create_map().cast("map<string,string>"), now())).first()[0]
    assert bare == EXPECTED_BARE
