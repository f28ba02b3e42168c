"""Payloads whose JSON kind changes from row to row, read as VARIANT.

One text column may hold arrays, objects, scalars and broken JSON.  Each text
is parsed once (``try_parse_json``); what a row lacks or has in another kind
than asked for is a defined value, and malformed rows are told apart from
missing ones instead of turning into NULL with them.

A text is malformed if it is no JSON, is empty, or names a key of one object
twice.  Where a value is turned into text, strings count as they are, all else
as JSON text (object keys in order, numbers in their shortest form).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What ``payload_kind`` returns for JSON values, by their first character.
_KIND_OF_FIRST = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
MISSING = "missing"
MALFORMED = "malformed"

KIND_COL = "_payload_kind"
BAD_FIELDS_COL = "_bad_fields"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _path(field: str) -> str:
    quote = '"' if "'" in field else "'"
    if quote in field or "\\" in field:
        raise ValueError(f"field name {field!r} cannot be written in a variant path")
    return f"$[{quote}{field}{quote}]"


def parse_payload(col: Column | str) -> Column:
    """The text as a VARIANT; NULL where it is missing or malformed."""
    return F.try_parse_json(_c(col))


def value_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null: the kind of a VARIANT (NULL for none)."""
    first = F.substring(F.to_json(value), 1, 1)
    kind = F.when(value.isNull(), F.lit(None).cast("string"))
    for char, name in _KIND_OF_FIRST.items():
        kind = kind.when(first == char, F.lit(name))
    return kind.otherwise(F.lit("number"))


def payload_kind(col: Column | str) -> Column:
    """The kind of a payload text; ``missing`` for NULL, ``malformed`` for what is no JSON."""
    return _kind_of(_c(col), parse_payload(col))


def _kind_of(text: Column, value: Column) -> Column:
    # The first character of a text that parses tells its kind; only JSON's own white space stands before it.
    first = F.substring(F.regexp_replace(text, r"^[ \t\r\n]+", ""), 1, 1)
    kind = F.when(text.isNull(), F.lit(MISSING)).when(value.isNull(), F.lit(MALFORMED))
    for char, name in _KIND_OF_FIRST.items():
        kind = kind.when(first == char, F.lit(name))
    return kind.otherwise(F.lit("number"))


def payload_array(col: Column | str) -> Column:
    """The items of a payload that is an array, as ``array<variant>``; ``[]`` for any other."""
    return F.coalesce(F.try_variant_get(parse_payload(col), "$", "array<variant>"), F.array().cast("array<variant>"))


def value_text(value: Column) -> Column:
    """A VARIANT as text; NULL for none and for JSON null."""
    return F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))


def _truthy_text(value: Column) -> Column:
    """A VARIANT as text; "" for none, null, false, zero, "" and empty arrays and objects."""
    kind = value_kind(value)
    zero = (kind == "number") & (F.try_variant_get(value, "$", "double") == 0)
    empty = zero | ((kind != "string") & F.to_json(value).isin("false", "[]", "{}"))
    return F.when(F.coalesce(empty, F.lit(False)), F.lit("")).otherwise(F.coalesce(value_text(value), F.lit("")))


def payload_struct_array(col: Column | str, fields: Sequence[str], null_fields: Sequence[str] = ()) -> Column:
    """The object items of an array payload as ``struct(fields...)`` of text.

    Missing, null and empty values are ""; items that are no objects and other
    fields are dropped; any other payload gives ``[]``.  ``null_fields`` are
    appended as NULL.
    """
    objects = F.filter(payload_array(col), lambda x: value_kind(x) == "object")

    def record(x: Column) -> Column:
        given = [_truthy_text(F.try_variant_get(x, _path(f), "variant")).alias(f) for f in fields]
        return F.struct(*given, *[F.lit(None).cast("string").alias(f) for f in null_fields])

    return F.transform(objects, record)


def payload_about(col: Column | str) -> Column:
    """Free-form text of a payload of any kind.

    An array: its items joined by one space, null items as ``None``.  An
    object: its JSON text, "" if it has no fields.  Missing: "".  Any other
    text, malformed JSON included, stays as it was given.
    """
    c = _c(col)
    kind = payload_kind(c)
    items = F.transform(payload_array(c), lambda x: F.coalesce(value_text(x), F.lit("None")))
    return (F.when(kind == MISSING, F.lit(""))
            .when(kind == "array", F.array_join(items, " "))
            .when(kind == "object", F.regexp_replace(F.to_json(parse_payload(c)), r"^\{\}$", ""))
            .otherwise(c))


def load_nested_checked(df: DataFrame, schema: StructType, json_col: str = "value",
                        keep: Sequence[str] = ()) -> DataFrame:
    """Payload texts read under the declared schema, nothing lost unnoticed.

    Returns the ``keep`` columns of ``df``, the fields of ``schema``, and

    - ``_payload_kind``: the kind of the payload; rows that are no ``object``
      have NULL in every field;
    - ``_bad_fields``: the declared fields whose value is neither missing nor
      null but does not convert to the declared type; they read as NULL.

    Unknown fields are ignored, missing ones are NULL.  ``keep`` may not name
    a field of the schema.
    """
    clash = set(keep) & {*schema.fieldNames(), KIND_COL, BAD_FIELDS_COL}
    if clash:
        raise ValueError(f"columns to keep clash with loaded ones: {sorted(clash)}")
    # The parsed value is a column of its own, so that a text is parsed once, not once for each field.
    names = [f"_keep{i}" for i in range(len(keep))]
    parsed = df.select(*[F.col(k).alias(n) for k, n in zip(keep, names)],
                       F.col(json_col).alias("_text"), parse_payload(json_col).alias("_v"))
    parsed = parsed.select(*names, _kind_of(F.col("_text"), F.col("_v")).alias("_kind"), "_v")
    value = F.when(F.col("_kind") == "object", F.col("_v"))
    out, bad = [], []
    for f in schema.fields:
        raw = F.try_variant_get(value, _path(f.name), "variant")
        typed = F.try_variant_get(value, _path(f.name), f.dataType.simpleString())
        out.append(typed.alias(f.name))
        bad.append(F.when(raw.isNotNull() & ~F.is_variant_null(raw) & typed.isNull(), F.lit(f.name)))
    return parsed.select(*[F.col(n).alias(k) for k, n in zip(keep, names)], *out, F.col("_kind").alias(KIND_COL),
                         F.array_compact(F.array(*bad)).cast("array<string>").alias(BAD_FIELDS_COL))


def loaded_rows(loaded: DataFrame) -> DataFrame:
    """The rows of ``load_nested_checked`` that were objects, without its two report columns."""
    return loaded.filter(F.col(KIND_COL) == "object").drop(KIND_COL, BAD_FIELDS_COL)


def rejected_payloads(loaded: DataFrame) -> DataFrame:
    """The rows that gave no record, or lost a field, with the reason (the report columns)."""
    return loaded.filter((F.col(KIND_COL) != "object") | (F.size(BAD_FIELDS_COL) > 0))
