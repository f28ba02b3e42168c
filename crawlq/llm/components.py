"""Connected components of a link table by alternating stars, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlq.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _to_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least neighbour m of u, u itself included.

    The minima are stored first, so that both inputs of the join are plain
    shuffles and a node with a third of the edges is split at run time.
    """
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "cc-min")
    return edges.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root: the component's least node.

    Large-star hooks every greater neighbour of a node to the least one,
    small-star the lesser ones; the edges end as one star per component after
    a logarithmic number of rounds.  Self links and null ends are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    edges = stored(edges, "cc-edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "cc-large")
        small = _to_min(large)
        hooked = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(hooked, "cc-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
