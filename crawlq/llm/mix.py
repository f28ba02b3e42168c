"""Mixing sources to target weights by Pareto order sampling (operator 7).

Each source gets a target number of words.  A document's expected number of
copies is ``target / source size``; its whole part is allocated to every
document as certain copies, its fraction ``p`` is an inclusion probability.
Documents are ranked by Pareto's ratio

    q = (u / (1 - u)) / (p / (1 - p)),    u uniform from a hash of the row,

and the lowest ranks of each source are taken until its remaining words are
filled.  The size of the sample is thus fixed (in words), not random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlq.llm.common import WORD, maybe_broadcast, stored

WEIGHTS = (5, 2, 1)      # by source in code-point order, repeating; null is last
SHARE = (3, 2)           # the mix holds 3/2 of all words
CAP = 2                  # copies of a document at most
SEED = "mix-1"
LEVELS, BITS = 4, 12     # the rank's 48 bits, 12 at a time
_SCALE = float(2 ** (LEVELS * BITS))


PLAN = ("source", "source_size", "target", "whole", "p", "cut", "cut_h", "k", "n")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(id_col: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from the row's id and text; rows equal in both get the same."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")),
                               F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(_SCALE)


def targets(sizes: DataFrame, *, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """Targets per source from ``sizes`` (source, source_size): one row per source.

    Water filling: sources stop at ``cap`` times their size and the excess is
    shared by weight among the others until none is above.  Sources ordered by
    size / weight stop in that order, so one running sum decides each.  The
    windows run over the per-source rows, not over documents.
    """
    dec = "decimal(38,0)"
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("pos", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("pos") % n + 1).cast("int")))
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("pos").asc()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    a, b = share
    w = (w.withColumn("all_size", F.sum("source_size").over(whole))
         .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("weight_left", F.sum("weight").over(after))
         # weight * (share * all - cap * before) / weight_left > cap * size, in whole numbers
         .withColumn("capped", F.col("weight").cast(dec) * (a * F.col("all_size") - b * cap * F.col("size_before")).cast(dec)
                     > (b * cap * F.col("source_size")).cast(dec) * F.col("weight_left").cast("decimal(18,0)"))
         .withColumn("capped_size", F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(whole), F.lit(0)))
         .withColumn("free_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)))
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * (a * F.col("all_size") - b * cap * F.col("capped_size"))).cast("double")
        / (b * F.col("free_weight")).cast("double"))
    return w.select("source", "source_size", target.alias("target"))


def _rank(u: Column, p: Column) -> Column:
    """Pareto's ratio mapped to (0, 1) by q / (1 + q), in 48 bits."""
    p = F.when(p > 0, p)      # null where nothing is drawn
    q = (u / (1 - u)) / (p / (1 - p))
    return F.floor(q / (1 + q) * F.lit(_SCALE)).cast("long")


def _same(id_col: Column, text: Column) -> Column:
    """A number that rows equal in id and text share."""
    return F.xxhash64(id_col.cast("string"), id_col.isNull(), F.coalesce(text, F.lit("")))


def plan_mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source",
             weights=WEIGHTS, share=SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per source: source, source_size, target, whole, p, cut, cut_h, k, n.

    A document of the source is taken ``whole`` times, and once more if its
    rank is below ``cut``.  The cut is found by radix selection: each level
    sums the sizes by the next 12 bits of the rank (partial sums before the
    shuffle), and only the bucket in which the words run out goes on.  Rows of
    rank ``cut`` are ordered by the hash of their id and text: those below
    ``cut_h`` go in, and of the ``n`` rows equal to it ``k``, as many as come
    nearest to the words that are left.
    """
    slim = stored(docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
                              _uniform(F.col(id_col), F.col(text_col), seed).alias("u"),
                              _same(F.col(id_col), F.col(text_col)).alias("h")), "mix-slim")
    t = stored(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")),
                       weights=weights, share=share, cap=cap), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = (t.withColumn("whole", F.floor(ratio).cast("long"))
         .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
         .withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)))
    ranked = slim.join(maybe_broadcast(t.where("p > 0").select(F.col("source").alias("s"), "p")),
                       F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "h", _rank(F.col("u"), F.col("p")).alias("rank"))
    ranked = stored(ranked, "mix-ranked")
    cut = t.where("p > 0").select("source", "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        small = maybe_broadcast(cut.withColumnRenamed("source", "s"))
        inside = ranked.join(small, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("rank", shift + BITS) == F.col("prefix")))
        sums = (inside.groupBy("source", "rest", "base", F.shiftright("rank", shift).alias("bucket"))
                .agg(F.sum("size").alias("size"))
                .withColumn("upto", F.col("base") + F.sum("size").over(running)))
        # The bucket in which the words run out; the last one that has rows if they never do.
        cross = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("size")).alias("base"), "upto")))
        last = F.max(F.struct("bucket", (F.col("upto") - F.col("size")).alias("base"), "upto"))
        cut = (sums.groupBy("source", "rest").agg(F.coalesce(cross, last).alias("x"))
               .select("source", "rest", F.col("x.base").alias("base"), F.col("x.bucket").alias("prefix")))
        cut = stored(cut, "mix-cut")
    # Rows of the last rank: mostly one, or rows equal in id and text, counted before the shuffle.
    edge = ranked.join(maybe_broadcast(cut.withColumnRenamed("source", "s")),
                       F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("prefix")))
    by_hash = Window.partitionBy("source").orderBy("h", "size")
    edge = (edge.groupBy("source", "rest", "base", "prefix", "h", "size").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("upto", F.col("base") + F.sum(F.col("size") * F.col("n")).over(by_hash.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    group = F.struct("h", "size", "n", (F.col("upto") - F.col("size") * F.col("n")).alias("base"))
    edge = (edge.groupBy("source", "rest", "prefix")
            .agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), group)), F.max(group)).alias("x")))
    room = F.when(F.col("x.size") > 0, (F.col("rest") - F.col("x.base")) / F.col("x.size")).otherwise(F.col("x.n"))
    k = F.least(F.greatest(F.floor(room + 0.5).cast("long"), F.lit(0).cast("long")), F.col("x.n"))
    cuts = edge.select(F.col("source").alias("s"), F.col("prefix").alias("cut"), F.col("x.h").alias("cut_h"), k.alias("k"), F.col("x.n").alias("n"))
    return t.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(*PLAN)


def _first_k(rows: DataFrame, k: str) -> DataFrame:
    """``more`` = 1 for ``k`` of the rows of each source, else 0.

    The rows are equal in id and text, so which ones count makes no difference.
    They are numbered as they lie in their stored partitions, from the counts
    of the partitions before: no task holds a source's rows.
    """
    place = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)), "mix-ties")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and partition.
    at = (rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
          .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
          .select(F.col("source").alias("_s"), F.col("_part").alias("_q"), "_before", "_n", "_first"))
    rows = rows.join(maybe_broadcast(at), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_q")))
    # Inside a partition that holds the k-th row, the place counts from its first one.
    inside = Window.partitionBy("source", "_part").orderBy("_place")
    number = F.col("_before") + F.row_number().over(inside)
    return (rows.withColumn("more", F.when(number <= F.col(k), 1).otherwise(0))
            .drop("_place", "_part", "_s", "_q", "_before", "_n", "_first"))


def mix_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", keep: bool = False, **how) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs``.

    ``keep=True`` returns instead the rows of ``docs``, each as often as the
    mix takes it, with their own columns only (whatever their names).

    Null or empty texts have size 0 and take no words; a null source is a
    source of its own, the last in order; null ids and repeated rows are rows
    like others.  Rows equal in id and text share one rank; where the words of
    a source run out among them, as many of them are taken as fit.
    """
    plan = stored(plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how), "mix-plan")
    seed = how.get("seed", SEED)
    rows = docs.select(*([F.struct(*docs.columns).alias("doc")] if keep else []),
                       F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       words(F.col(text_col)).alias("size"), _uniform(F.col(id_col), F.col(text_col), seed).alias("u"),
                       _same(F.col(id_col), F.col(text_col)).alias("h"))
    rows = rows.join(maybe_broadcast(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("rank", _rank(F.col("u"), F.col("p")))
    at_cut = (F.col("rank") == F.col("cut")) & (F.col("h") == F.col("cut_h"))
    below = (F.col("rank") < F.col("cut")) | ((F.col("rank") == F.col("cut")) & (F.col("h") < F.col("cut_h")))
    more = F.when(below | (at_cut & (F.col("k") >= F.col("n"))), 1).otherwise(0)
    torn = F.coalesce(at_cut & (F.col("k") > 0) & (F.col("k") < F.col("n")), F.lit(False))
    # One row per source; most plans tear no group of equal rows.
    if plan.where("k > 0 and k < n").take(1):
        rows = rows.where(~torn).withColumn("more", more).unionByName(_first_k(rows.where(torn), "k"))
    else:
        rows = rows.withColumn("more", more)
    rows = rows.withColumn("copies", F.col("whole") + F.col("more"))
    if keep:
        return (rows.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
                .select("doc.*"))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 12)) AS BIGINT) + 0.5::DOUBLE)
           / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM s),
w2 AS (SELECT *, CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM w),
w3 AS (SELECT *, sum(source_size) OVER () AS all_size,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
         sum(weight) OVER (ORDER BY source_size / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM w2),
w4 AS (SELECT *, weight * (3 * all_size - 4 * size_before) > 4 * source_size * weight_left AS capped FROM w3),
w5 AS (SELECT *, coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0) AS capped_size,
         sum(CASE WHEN NOT capped THEN weight END) OVER () AS free_weight FROM w4),
t AS (SELECT source, source_size,
         CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(weight * (3 * all_size - 4 * capped_size) AS DOUBLE) / CAST(2 * free_weight AS DOUBLE) END AS target FROM w5),
t2 AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM t),
t3 AS (SELECT *, target - whole * source_size AS rest,
         CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM t2),
q AS (SELECT d.doc_id, d.size, t3.*  EXCLUDE (source), d.source,
         CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM d JOIN t3 ON d.source IS NOT DISTINCT FROM t3.source),
r AS (SELECT *, CAST(floor(q / (1 + q) * 281474976710656.0::DOUBLE) AS BIGINT) AS rank FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY source, rank) AS peers FROM r),
e AS (SELECT *, whole + CASE WHEN p > 0 AND (upto - peers) + upto <= 2 * rest THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken FROM e
"""
