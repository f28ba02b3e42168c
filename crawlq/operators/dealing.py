"""Work dealt to many workers in one call (B1/B2 for all owners, with M9).

Asking one owner at a time, two workers that read before either claims get
the same keywords.  Here all workers are served together: every worker keeps
its own rows in processing, oldest first, up to the limit, and its open places are
filled from the oldest unowned pending rows, one place of each worker in
turn.  No row goes to two workers, and unless the queue runs out every
worker has ``limit`` rows.

Rows and places are numbered by range prefix sums
(:func:`crawlq.operators.ranks.ranked`) and meet in an equality join on the
number, so no task holds the queue and none holds a worker's share of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlq.constants import LIMIT_KEYWORDS, PENDING, PROCESSING
from crawlq.operators import merge
from crawlq.operators.queue_reads import check_bounds
from crawlq.operators.ranks import ranked


def deal(queue: DataFrame, workers: DataFrame, limit: int = LIMIT_KEYWORDS[0], *,
         owner: str = "extension_id") -> DataFrame:
    """The rows of every worker: id, ``owner``, ``place`` (from 0), ``fresh``.

    ``workers`` names them in the column ``owner``; repeats, NULL and empty
    names are left out.  ``fresh`` rows are newly dealt, the others were the
    worker's own already (they come first).  Rows of equal age are ordered by
    id; the i-th open place of every worker is filled before the next, workers
    in the order of their names.
    """
    check_bounds(limit, 0, LIMIT_KEYWORDS)
    names = merge.materialize(
        workers.filter(F.col(owner).isNotNull() & (F.col(owner) != "")).select(owner).distinct())
    age = [F.col("created_at").asc_nulls_first(), F.col("id").asc_nulls_first()]
    unowned = F.coalesce(F.col(owner), F.lit("")) == ""

    own = (queue.filter((F.col("status") == PROCESSING) & F.col(owner).isNotNull())
           .select("id", owner, "created_at").join(names, owner, "left_semi"))
    own = merge.materialize(ranked(own, [F.col(owner), *age], "_n"))
    held = own.groupBy(owner).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_held"))
    # One row per worker on both sides; the owner's rows are numbered in one stretch.
    state = merge.materialize(names.join(held, owner, "left"))
    kept = (own.join(state.filter(F.col("_first").isNotNull()).select(owner, "_first"), owner)
            .withColumn("place", F.col("_n") - F.col("_first")).filter(F.col("place") < limit)
            .select("id", owner, "place", F.lit(False).alias("fresh")))

    first_open = F.least(F.coalesce(F.col("_held"), F.lit(0)), F.lit(limit))
    places = (state.filter(first_open < limit)
              .select(owner, F.explode(F.sequence(first_open, F.lit(limit - 1).cast("long"))).alias("place"),
                      first_open.alias("_open"))
              .select(owner, "place", (F.col("place") - F.col("_open")).alias("_round")))
    places = ranked(places, [F.col("_round"), F.col(owner)], "_n").select(owner, "place", "_n")
    pending = queue.filter((F.col("status") == PENDING) & unowned).select("id", "created_at")
    dealt = (ranked(pending, age, "_n").select("id", "_n").join(places, "_n")
             .select("id", owner, "place", F.lit(True).alias("fresh")))
    return kept.unionByName(dealt)


def deal_and_claim(queue: DataFrame, workers: DataFrame, limit: int = LIMIT_KEYWORDS[0],
                   now: Column | None = None, *, owner: str = "extension_id") -> tuple[DataFrame, DataFrame]:
    """:func:`deal` and the queue after the freshly dealt rows are claimed (M9).

    The deal is stored, so what the workers are told is what the queue says.
    """
    dealt = merge.materialize(deal(queue, workers, limit, owner=owner))
    claims = dealt.filter("fresh").select("id", owner)
    return dealt, merge.claim_processing(queue, claims, now)
