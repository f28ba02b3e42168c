"""Payloads of changing kind: arrays, objects, scalars, broken JSON in one column."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from crawlq.functions import payloads as P

MIXED = ['{"k": 69, "z": {"q": [1, 2]}}', ' ["a", null, 1, true, {"b": 1}]', '"t"', "17", "-1.50", "true", "null",
         '{"k": ', "", " ", "[]", "{}", None, '{"k": 1, "k": 2}', "plain words"]


def values(spark, col, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    return [r.v for r in df.select("i", col.alias("v")).orderBy("i").collect()]


def test_kind_of_every_row(spark):
    assert values(spark, P.payload_kind("p"), MIXED) == [
        "object", "array", "string", "number", "number", "boolean", "null", "malformed", "malformed", "malformed",
        "array", "object", "missing", "malformed", "malformed"]


def test_items_only_of_arrays(spark):
    sizes = values(spark, F.size(P.payload_array("p")), MIXED)
    assert sizes == [0, 5] + [0] * 13


def test_about_of_every_kind(spark):
    assert values(spark, P.payload_about("p"), MIXED) == [
        '{"k":69,"z":{"q":[1,2]}}', 'a None 1 true {"b":1}', '"t"', "17", "-1.50", "true", "null", '{"k": ', "", " ",
        "", "", "", '{"k": 1, "k": 2}', "plain words"]


def test_records_of_arrays(spark):
    text = ('[{"title": "t", "time": 0, "x": 1}, {"title": []}, "loose", null, 3, '
            '{"title": {"a": "b"}, "time": false}, {"title": "0", "time": 2.5}, {"title": "false", "time": 0.0}]')
    got = values(spark, P.payload_struct_array("p", ("title", "time"), ("description",)), [text, *MIXED])
    assert [tuple(r) for r in got[0]] == [
        ("t", "", None), ("", "", None), ('{"a":"b"}', "", None), ("0", "2.5", None), ("false", "", None)]
    assert [tuple(r) for r in got[2]] == [("", "", None)]      # the one object in MIXED's array
    assert all(r == [] for i, r in enumerate(got[1:]) if i != 1)


SCHEMA = StructType([StructField("k", LongType()), StructField("it's", StringType())])


def test_load_reports_what_it_cannot_read(spark):
    texts = ['{"k": 1, "it\'s": "x", "more": 2}', '{"k": "12"}', '{"k": "twelve", "it\'s": [1]}', '{"k": null}', "[1]", '{"k"', None]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, value string, extra int")
    loaded = P.load_nested_checked(df, SCHEMA, keep=["id"])
    assert loaded.columns == ["id", "k", "it's", "_payload_kind", "_bad_fields"]
    got = [tuple(r) for r in loaded.orderBy("id").collect()]
    assert got == [(0, 1, "x", "object", []), (1, 12, None, "object", []), (2, None, "[1]", "object", ["k"]),
                   (3, None, None, "object", []), (4, None, None, "array", []), (5, None, None, "malformed", []),
                   (6, None, None, "missing", [])]
    assert [r.id for r in P.loaded_rows(loaded).orderBy("id").collect()] == [0, 1, 2, 3]
    assert sorted(r.id for r in P.rejected_payloads(loaded).collect()) == [2, 4, 5, 6]


def test_load_of_an_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "k long, value string, _kind string, _v string")
    with pytest.raises(ValueError, match="clash"):
        P.load_nested_checked(df, SCHEMA, keep=["k"])
    assert P.load_nested_checked(df, SCHEMA, keep=["_kind", "_v"]).collect() == []


def test_a_very_long_payload(spark):
    text = "[" + ",".join('{"title": "%d"}' % i for i in range(60_000)) + "]"
    got = values(spark, P.payload_struct_array("p", ("title",)), [text])[0]
    assert len(got) == 60_000 and got[-1].title == "59999"


def test_a_text_is_parsed_once_for_all_fields(spark):
    schema = StructType([StructField(f"f{i}", LongType()) for i in range(30)])
    df = spark.createDataFrame([('{"f1": 1}',)], "value string")
    plan = P.load_nested_checked(df, schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
