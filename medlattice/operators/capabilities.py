"""What the engine offers: parameters of types, loaded code systems, and the card of a decision-support hook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.operators.search import REGISTRY


def parameters(spark: SparkSession, registry: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """kind, code, type of every search parameter."""
    rows = [(k, c, t) for k, known in (registry or REGISTRY).items() for c, t in known.items()]
    return spark.createDataFrame(rows, "kind string, code string, type string")


def statement(spark: SparkSession, tables: dict[str, DataFrame | None], registry: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """kind, parameters, resources: each type with how many parameters it can be searched by and how many live resources it has."""
    from functools import reduce

    own = parameters(spark, registry).groupBy("kind").agg(F.count("*").alias("parameters"))
    live = [df.filter("is_current and not deleted").agg(F.count("*").alias("resources")).select(F.lit(k).alias("kind"), "resources") for k, df in tables.items() if df is not None]
    if not live:
        return own.withColumn("resources", F.lit(0).cast("bigint"))
    return own.join(reduce(DataFrame.unionByName, live), "kind", "full").fillna(0)


def terminology(concepts: DataFrame) -> DataFrame:
    """uri of every loaded code system."""
    return concepts.filter("system is not null and system <> ''").select(F.col("system").alias("uri")).distinct()


def cards(requests: DataFrame) -> DataFrame:
    """id, indicator, summary of the card for each signed set of orders (id, orders: how many)."""
    text = F.when(F.col("orders") > 0, "Coverage requirements: prior authorization may be required for one or more orders").otherwise("Coverage requirements discovery available")
    return requests.select("id", F.lit("info").alias("indicator"), text.alias("summary"))
