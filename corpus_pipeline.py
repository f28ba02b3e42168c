"""The corpus pipeline: quality, near-duplicates, decontamination, mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all the rows that the one
before it kept.  Between stages the documents are written as Parquet to the
shared folder and read again; what a stage stored for itself, and its input,
are deleted once its output is written.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlq.llm import queries
from crawlq.llm.common import drop_stored, scratch, scratch_path, stored_at, table

STAGES = [
    ("quality", queries.stage_quality),
    ("near_dedup", queries.stage_near_dedup),
    ("decontaminate", queries.stage_decontaminate),
    ("mix", queries.stage_mix),
    ("token_ids", queries.stage_token_ids),
]

# A fitted classifier, sketches and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the last one's rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = stored_at(stage(spark, docs, sf_dir), path)
        # The stage's own tables are gone; now nothing reads its input any more.
        if before:
            drop_stored(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
