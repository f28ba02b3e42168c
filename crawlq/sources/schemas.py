"""Declared schemas of the eight crawl tables (operator A1 ``table_schema``).

Tables are keyed by (platform, table_type).  ``pro`` is the first platform
(keywords, profile URLs, nested professional profiles); ``social`` is the
second (seed URLs, friend-list URLs, social profiles, and the ``_v1``
copies).  REQUIRED columns are declared ``nullable=False``; Spark does not
enforce that on parquet reads, so :mod:`crawlq.plans.normalize` checks it.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, LongType, MapType, StringType, StructField, StructType,
    TimestampType,
)

S, L, TS = StringType(), LongType(), TimestampType()


def _f(name, dtype, nullable=True):
    return StructField(name, dtype, nullable)


def _struct(*fields):
    return StructType(list(fields))


DATE_PARTS = _struct(_f("year", L), _f("month", L), _f("day", L))
DATE_SPAN = _struct(_f("start", DATE_PARTS), _f("end", DATE_PARTS))

_STAMPS = (_f("created_at", TS, False), _f("updated_at", TS, False))

PROFILE_PRO = _struct(
    _f("id", S, False), _f("account_id", S, False), _f("username", S, False),
    _f("title", S, False), _f("about", S), _f("location", S),
    _f("profile_image", S),
    _f("birthday", _struct(_f("month", L), _f("day", L), _f("year", L))),
    _f("websites", ArrayType(_struct(_f("url", S), _f("type", S)))),
    _f("experiences", ArrayType(_struct(
        _f("company", _struct(
            _f("id", S), _f("name", S), _f("logo", S), _f("url", S),
            _f("employees", _struct(_f("start", L), _f("end", L))))),
        _f("date", DATE_SPAN),
        _f("profile_positions", ArrayType(_struct(
            _f("location", S), _f("date", DATE_SPAN), _f("company", S),
            _f("title", S), _f("description", S), _f("employment_type", S)))),
    ))),
    _f("skills", ArrayType(S)),
    _f("educations", ArrayType(_struct(
        _f("date", DATE_SPAN),
        _f("school", _struct(_f("name", S), _f("logo", S), _f("url", S))),
        _f("degree_name", S), _f("description", S), _f("field_of_study", S),
        _f("grade", S)))),
    _f("languages", ArrayType(_struct(_f("name", S), _f("proficiency", S)))),
    _f("posts", ArrayType(_struct(
        _f("content", S), _f("time", S), _f("num_reactions", L),
        _f("num_comments", L)))),
    *_STAMPS,
)

PROFILE_SOCIAL = _struct(
    _f("id", S, False), _f("account_id", S, False),
    _f("friend_lists", ArrayType(S)), _f("username", S, False),
    _f("profile_image", S), _f("about", S), _f("websites", ArrayType(S)),
    _f("experiences", ArrayType(_struct(
        _f("title", S), _f("time", S), _f("description", S)))),
    _f("educations", ArrayType(_struct(_f("title", S), _f("time", S)))),
    _f("languages", ArrayType(S)), _f("gender", S), _f("birthday", S),
    _f("current_city", S), _f("hometown", S), _f("email", S),
    _f("phone_number", S),
    _f("posts", ArrayType(_struct(_f("content", S), _f("time", S)))),
    *_STAMPS,
)

URL_QUEUE_PRO = _struct(
    _f("id", S, False), _f("account_id", S, False), _f("keyword_id", S, False),
    _f("url", S, False), _f("status", S), _f("processed_at", TS), *_STAMPS,
)

URL_QUEUE = _struct(
    _f("id", S, False), _f("account_id", S, False), _f("seed_url_id", S),
    _f("parent_account_id", S), _f("crawl_depth", L), _f("url", S, False),
    _f("source_type", S), _f("status", S), _f("processed_at", TS), *_STAMPS,
)

KEYWORD_QUEUE = _struct(
    _f("id", S, False), _f("keyword", S, False), _f("extension_id", S),
    _f("start", L), _f("status", S), _f("processed_at", TS), *_STAMPS,
)

SEED_QUEUE = _struct(
    _f("id", S, False), _f("url", S, False), _f("extension_id", S),
    _f("max_profiles", L), _f("status", S), _f("processed_at", TS), *_STAMPS,
)

SEED_QUEUE_V1 = _struct(
    *[f for f in SEED_QUEUE.fields if f.name != "max_profiles"]
)

ERROR_REPORT = _struct(
    _f("title", S, False), _f("error_message", S, False), _f("extension_id", S),
    _f("platform", S), _f("error_type", S), _f("url", S), _f("stack_trace", S),
    _f("additional_context", MapType(S, S)),
)

# (platform, table_type) -> schema.  Table types follow the original routes.
SCHEMAS: dict[tuple[str, str], StructType] = {
    ("pro", "profiles"): PROFILE_PRO,
    ("pro", "urls"): URL_QUEUE_PRO,
    ("pro", "keywords"): KEYWORD_QUEUE,
    ("social", "profiles"): PROFILE_SOCIAL,
    ("social", "urls"): URL_QUEUE,
    ("social", "seed_urls"): SEED_QUEUE,
    ("social", "urls_v1"): URL_QUEUE,
    ("social", "seed_urls_v1"): SEED_QUEUE_V1,
}

# Merge / write keys per table type.
KEYS = {
    "profiles": "account_id", "urls": "account_id", "urls_v1": "account_id",
    "keywords": "keyword", "seed_urls": "url", "seed_urls_v1": "url",
}


def table_schema(platform: str, table_type: str) -> StructType:
    """Declared schema of a table; an unknown pair raises ``ValueError``."""
    try:
        return SCHEMAS[(platform, table_type)]
    except KeyError:
        raise ValueError(
            f"no table for platform={platform!r}, table_type={table_type!r}"
        ) from None


def required_columns(schema: StructType) -> list[str]:
    """Top-level columns declared REQUIRED (``nullable=False``)."""
    return [f.name for f in schema.fields if not f.nullable]
