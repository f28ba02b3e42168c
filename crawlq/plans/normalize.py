"""Composite normalisers and the transform registry.

Each normaliser is ``DataFrame -> DataFrame`` built by chaining column
functions; all rows of a batch are handled in one pass.  Instead of raising
on the first bad record, a normaliser marks it in ``_reject_reason`` (NULL
when the row is valid); :func:`valid_rows` and :func:`rejected_rows` split
the result with two filters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from crawlq.constants import (
    DEFAULT_MAX_PROFILES, DEFAULT_START, PENDING, REASON_COL, SOCIAL_ARRAY_FIELDS,
    SOCIAL_TEXT_FIELDS,
)
from crawlq.functions import columns as C


# ------------------------------------------------------------ valid / reject

def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``_reject_reason`` = the first rule (reason -> ok-condition)
    that fails; NULL when every rule holds.  A NULL condition fails."""
    reason = F.lit(None).cast("string")
    for why, ok in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)).otherwise(reason)
    if REASON_COL in df.columns:
        reason = F.coalesce(F.col(REASON_COL), reason)
    return df.select(*[c for c in df.columns if c != REASON_COL], reason.alias(REASON_COL))


def valid_rows(df: DataFrame) -> DataFrame:
    if REASON_COL not in df.columns:
        return df
    return df.filter(F.col(REASON_COL).isNull()).drop(REASON_COL)


def rejected_rows(df: DataFrame) -> DataFrame:
    if REASON_COL not in df.columns:
        return df.limit(0)
    return df.filter(F.col(REASON_COL).isNotNull())


def _truthy(col: str) -> Column:
    c = F.col(col)
    return c.isNotNull() & (c.cast("string") != "")


# ------------------------------------------------------------------ defaults

def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def _row_id(df: DataFrame, now: Column) -> Column:
    """Default id: a new UUID per row, so equal rows get different ids.  Writers
    store the rows once (:func:`crawlq.operators.merge.materialize`) before use."""
    return F.expr("uuid()")


def _stamps(df: DataFrame, now: Column | None, id_expr: Column | None,
            extra: Mapping[str, Column] | None = None) -> DataFrame:
    ts = _now(now)
    defaults = {"id": id_expr if id_expr is not None else _row_id(df, ts)}
    defaults.update(extra or {})
    defaults.update({"created_at": ts, "updated_at": ts})
    return C.with_defaults(df, defaults)


def normalize_keyword_rows(df: DataFrame, now: Column | None = None,
                           id_expr: Column | None = None) -> DataFrame:
    """Keyword rows get id, ``pending``, start 0 and stamps when absent."""
    return _stamps(df, now, id_expr, {"status": F.lit(PENDING),
                                      "start": F.lit(DEFAULT_START).cast("long")})


def normalize_seed_rows(df: DataFrame, now: Column | None = None,
                        id_expr: Column | None = None, v1: bool = False) -> DataFrame:
    """P5: seed rows get id (as text), ``pending``, max_profiles 100 (not for
    v1) and stamps when absent."""
    extra = {"status": F.lit(PENDING)}
    if not v1:
        extra["max_profiles"] = F.lit(DEFAULT_MAX_PROFILES).cast("long")
    out = _stamps(df, now, id_expr, extra)
    return out.withColumn("id", C.id_to_string("id"))


def url_defaults(df: DataFrame, now: Column | None = None, id_expr: Column | None = None,
                 derive_account: bool = False, marker: str = "in") -> DataFrame:
    """URL rows get id, ``pending`` and stamps when absent; with
    ``derive_account`` (first platform) a missing account_id column is
    derived from the URL (:func:`crawlq.functions.columns.account_from_url`)."""
    if derive_account and "account_id" not in df.columns and "url" in df.columns:
        df = df.withColumn("account_id", C.account_from_url("url", marker))
    return _stamps(df, now, id_expr, {"status": F.lit(PENDING)})


# ------------------------------------------------------------------ profiles

def normalize_profile_pro(df: DataFrame, now: Column | None = None,
                          id_expr: Column | None = None) -> DataFrame:
    """Id and stamps when absent; ``posts[].time`` checked as ISO text.

    NULL post items are dropped, as the JSON load of the original drops
    ``None`` list items.
    """
    ts = _now(now)
    out = _stamps(df, ts, id_expr)
    if "posts" in out.columns:
        posts = F.filter(C.post_time_iso("posts", ts), lambda x: x.isNotNull())
        out = out.withColumn("posts", posts)
    return out


def clean_profile_social(df: DataFrame) -> DataFrame:
    """Reject rows without an account_id; literal nulls ('None', 'null',
    'undefined', '') in account_id / parent_account_id / username become
    NULL; NULL arrays become ``[]``."""
    if "account_id" not in df.columns:
        raise ValueError("account_id is required")
    out = split_valid(df, {"account_id is required": _truthy("account_id")})
    fixes = {c: C.nullify_literals(c) for c in ("parent_account_id", "account_id", "username")
             if c in out.columns}
    for c in SOCIAL_ARRAY_FIELDS:
        if c in out.columns and isinstance(out.schema[c].dataType, ArrayType):
            fixes[c] = C.array_or_empty(c)
    return out.withColumns(fixes) if fixes else out


_STRUCT_FIELDS = {
    "experiences": (("title", "time"), ("description",)),
    "educations": (("title", "time"), ()),
    "posts": (("content", "time"), ()),
}
_STRING_ARRAYS = ("friend_lists", "languages", "websites")


def normalize_profile_social(df: DataFrame, now: Column | None = None,
                             id_expr: Column | None = None) -> DataFrame:
    """The social-profile transform.

    ids as text; record arrays reduced to their (title, time) / (content,
    time) fields with ``""`` for missing values (non-record items skipped,
    JSON text accepted); string arrays without NULL items; all six arrays
    present (``[]`` when absent or NULL); account_id and username required;
    NULL text fields -> ``""``; ``about`` flattened; crawl_depth NULL -> 1;
    id and stamps when absent.
    """
    ts = _now(now)
    out = df
    fixes: dict[str, Column] = {}
    for c in ("account_id", "parent_account_id"):
        if c in out.columns:
            fixes[c] = C.id_to_string(c)
    for c, (fields, nulls) in _STRUCT_FIELDS.items():
        if c in out.columns:
            dt = out.schema[c].dataType
            json = isinstance(dt, StringType)
            present = None if json else [f.name for f in dt.elementType.fields]
            fixes[c] = C.normalize_struct_array(c, fields, nulls, json=json, present=present)
        else:
            empty = StructType.fromJson({"type": "struct", "fields": [
                {"name": f, "type": "string", "nullable": True, "metadata": {}}
                for f in (*fields, *nulls)]})
            fixes[c] = F.array().cast(ArrayType(empty))
    for c in _STRING_ARRAYS:
        if c in out.columns:
            src = out.schema[c].dataType
            arr = (C.array_or_empty(c, ArrayType(StringType())) if isinstance(src, StringType)
                   else F.coalesce(F.col(c), F.array()))
            fixes[c] = C.compact_string_array(arr)
        else:
            fixes[c] = F.array().cast(ArrayType(StringType()))
    out = out.withColumns(fixes)
    out = split_valid(out, {
        "account_id is required": _truthy("account_id") if "account_id" in out.columns else F.lit(False),
        "username is required": _truthy("username") if "username" in out.columns else F.lit(False),
    })
    text = {c: C.text_or_empty(c) for c in SOCIAL_TEXT_FIELDS if c in out.columns}
    if "about" in out.columns:
        text["about"] = C.flatten_about(F.col("about").cast("string"))
    if "crawl_depth" in out.columns:
        text["crawl_depth"] = C.depth_default("crawl_depth")
    out = out.withColumns(text) if text else out
    return _stamps(out, ts, id_expr)


# ------------------------------------------------------------------ registry

Transform = Callable[..., DataFrame]

TRANSFORMS: dict[tuple[str, str], Transform] = {
    ("pro", "profiles"): normalize_profile_pro,
    ("pro", "urls"): lambda df, now=None, id_expr=None: url_defaults(df, now, id_expr, True),
    ("pro", "keywords"): normalize_keyword_rows,
    ("social", "profiles"): normalize_profile_social,
    ("social", "urls"): url_defaults,
    ("social", "seed_urls"): normalize_seed_rows,
    ("social", "urls_v1"): url_defaults,
    ("social", "seed_urls_v1"): lambda df, now=None, id_expr=None: normalize_seed_rows(
        df, now, id_expr, v1=True),
}


def transform_for(platform: str, table_type: str) -> Transform:
    """The normaliser of a table; an unknown pair raises ``ValueError``."""
    try:
        return TRANSFORMS[(platform, table_type)]
    except KeyError:
        raise ValueError(f"unsupported table: platform={platform!r}, type={table_type!r}") from None


def transform_batch(df: DataFrame, platform: str, table_type: str,
                    now: Column | None = None, id_expr: Column | None = None) -> DataFrame:
    """Normalise a whole batch (one stamp for the batch)."""
    return transform_for(platform, table_type)(df, now=now, id_expr=id_expr)


def transform_and_validate(df: DataFrame, platform: str, table_type: str,
                           now: Column | None = None,
                           id_expr: Column | None = None) -> DataFrame:
    """Normalise, then mark rows missing a required field (I16)."""
    out = transform_batch(df, platform, table_type, now, id_expr)
    ok = C.required_fields_ok(table_type, out.columns)
    return split_valid(out, {"missing required fields": ok})
