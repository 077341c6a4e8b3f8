"""Connected components by alternating large-star and small-star steps.

Edges are replaced by edges to smaller neighbours until every node points at
its component's smallest one; each step is two shuffles with partial
aggregation, nothing is collected, and every step is a table in the shared
folder. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import table


def _sum(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node go to the least of its neighbourhood; small: neighbours below it and itself do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    to_least = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (bigint, not null). Returns node, component for all nodes but those that are their component's least."""
    now = table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = _sum(now)
    while before.n:
        step = table(_star(now, True).filter("u <> v").distinct(), "components")
        now = table(_star(step, False).filter("u <> v").distinct(), "components")
        after = _sum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
