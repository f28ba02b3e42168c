"""Registry of named queries: a Spark builder and its DuckDB oracle SQL.

Each entry reads the driver's test tables in ``sf_dir`` through the adapters
of :mod:`crawlq.sources.fixtures` and runs one library operator over the
whole tables.  ``oracle`` is the equivalent SQL over the same tables, or
``None`` for operators with no SQL form (then only row counts are checked).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from crawlq.session import ensure_checkpoint_dir

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    doc: str = ""


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Registered queries run in test harnesses: some materialise
            # inputs, so make sure a checkpoint folder exists (the session's
            # own setting wins; a scratch folder only when it is unset).
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # Importing the modules fills the registry.
    from crawlq.plans import queries  # noqa: F401

    return dict(QUERIES)
