"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
(set ORACLE_TZ / ORACLE_ANSI to run the Spark side under another session time zone
or ANSI mode)

Compares row count, column names, column types and the multiset of row
values (order insensitive), as the driver's correctness gate does.  Exit status 1 on any
mismatch.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from crawlq.plans.registry import all_queries  # noqa: E402
from crawlq.session import local_session  # noqa: E402
from crawlq.sources.fixtures import BASE_TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tzinfo else pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.floating, float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    if isinstance(v, (np.bool_, bool)):
        return bool(v)
    if isinstance(v, np.ndarray):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v


# Spark type name -> DuckDB type name, for the schema comparison.
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
          "boolean": "BOOLEAN", "double": "DOUBLE"}


def _rows(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()]
    return sorted(rows, key=repr)


def check(spark, con, q, sf_dir):
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if q.oracle is None:
        return dict(name=q.name, ok=None, rows=len(spdf), spark_s=round(t1 - t0, 2))
    opdf = con.sql(q.oracle).df()
    res = dict(name=q.name, rows=len(spdf), oracle_rows=len(opdf), spark_s=round(t1 - t0, 2))
    if sorted(spdf.columns) != sorted(opdf.columns):
        res.update(ok=False, why=f"columns {sorted(spdf.columns)} vs {sorted(opdf.columns)}")
        return res
    spark_types = {c: _TYPES.get(t, t) for c, t in sdf.dtypes}
    rel = con.sql(q.oracle)
    oracle_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if spark_types != oracle_types:
        res.update(ok=False, why=f"types {spark_types} vs {oracle_types}")
        return res
    a, b = _rows(spdf), _rows(opdf)
    if a != b:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res.update(ok=False, why=f"values differ; spark-only {diff_a} oracle-only {diff_b}")
        return res
    res.update(ok=True)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    if os.environ.get("ORACLE_TZ"):
        # Results must not depend on the session time zone.
        spark.conf.set("spark.sql.session.timeZone", os.environ["ORACLE_TZ"])
    if os.environ.get("ORACLE_ANSI"):
        spark.conf.set("spark.sql.ansi.enabled", os.environ["ORACLE_ANSI"])
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs = all_queries()
    bad = 0
    for name in names or sorted(qs):
        try:
            r = check(spark, con, qs[name], sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"{len(names or qs) - bad} ok / {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
