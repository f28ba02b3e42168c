"""Bounded samples of labelled documents for fitting the classifiers."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_mod(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo ``mod`` (null id: null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % mod


def py_crc_mod(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, mod: int, held_out: int,
                    per_class: int) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of at most ``per_class`` documents of each label, and the share of label 1.

    The share is counted over all labelled ids of the fold (0.5 if there are none).

    Rows whose crc32 remainder is ``held_out`` are never read.  The sample is
    the documents with the smallest hash of the id, so it does not depend on
    the order of the rows.  An id with several labels counts with its lowest,
    one with several texts with its least; null ids, labels and texts are left
    out.  The bound on the sample is ``per_class`` documents of each label,
    whatever the size of the corpus.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_mod(F.col("doc_id"), mod) != held_out))
             .groupBy("doc_id").agg(F.min("y").alias("y")))
    counts = known.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    share = counts["ones"] / counts["n"] if counts["n"] else 0.5
    key = F.xxhash64("doc_id", F.lit(label))
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(key, "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # At most 2 * per_class rows: a proven bound for the broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    rows = (texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
            .orderBy("doc_id").collect())
    return [(r["text"], r["y"]) for r in rows], share


def prior_shift(sample: list[tuple[str, int]], share: float) -> float:
    """What a logit fitted on the sample needs for labels that occur with ``share``; 0 if either side is one-sided."""
    inside = sum(y for _, y in sample) / len(sample) if sample else 0.0
    if not 0 < inside < 1 or not 0 < share < 1:
        return 0.0
    return math.log(share / (1 - share)) - math.log(inside / (1 - inside))
