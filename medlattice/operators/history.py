"""Versions of resources: current state, reads and histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mark_current(df: DataFrame) -> DataFrame:
    """is_current from the versions themselves; idempotent."""
    newest = F.max("version_id").over(Window.partitionBy("id"))
    return df.withColumn("is_current", F.col("version_id") == newest)


def newest(df: DataFrame) -> DataFrame:
    """One row an id, the highest version, tombstones included; of equal versions the greatest row.

    Rows are shuffled before they are sorted: a partial aggregation of whole rows would sort what a task reads, and a file's rows
    are many. The window's order serves the aggregation too.
    """
    own = [c for c in df.columns if c not in ("id", "version_id")]
    if not own:
        return df.groupBy("id").agg(F.max("version_id").alias("version_id"))
    tops = df.withColumn("_top", F.max("version_id").over(Window.partitionBy("id"))).filter(F.col("version_id").eqNullSafe(F.col("_top")))
    best = tops.groupBy("id").agg(F.max(F.struct("version_id", *own)).alias("r"))
    return best.select("id", "r.version_id", *[f"r.{c}" for c in own])


def point_read(df: DataFrame, ids: DataFrame) -> DataFrame:
    """id, version_id, status: ok, gone or not-found for each wanted id."""
    got = ids.join(newest(df), "id", "left")
    status = F.when(F.col("version_id").isNull(), "not-found").when(F.col("deleted"), "gone").otherwise("ok")
    return got.select("id", "version_id", status.alias("status"))


def vread(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, version_id, status of exact versions."""
    got = wanted.join(df.select("id", "version_id", "deleted"), ["id", "version_id"], "left")
    return got.select("id", "version_id", F.when(F.col("deleted").isNull(), "not-found").when(F.col("deleted"), "gone").otherwise("ok").alias("status"))


def instance_history(df: DataFrame, id_: str) -> DataFrame:
    return df.filter(F.col("id") == id_).orderBy(F.desc("version_id"))


def type_history(df: DataFrame, count: int = 50, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc("last_updated"), F.desc("version_id"), F.desc("id")).offset(offset).limit(count)


def system_history(tables: dict[str, DataFrame], count: int = 50, offset: int = 0) -> DataFrame:
    parts = [df.select(F.lit(t).alias("type"), "id", "version_id", "last_updated", "deleted") for t, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.orderBy(F.desc("last_updated"), F.desc("id"), F.desc("type"), F.desc("version_id")).offset(offset).limit(count)


def write_versions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with new versions and flags set anew; an (id, version_id) that is there already is an error."""
    if not new.join(stored, ["id", "version_id"], "left_semi").isEmpty():
        raise ValueError("version conflict")
    return mark_current(stored.unionByName(new))


def ingest(stored: DataFrame, new: DataFrame, expected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(next versions, rejects) of a batch of updates; `expected` names a column with the version the writer has seen."""
    now = newest(stored).select("id", F.col("version_id").alias("_now"))
    joined = new.join(now, "id", "left")
    stale = (F.col(expected) != F.col("_now")) if expected else F.lit(False)
    why = F.when(F.col("_now").isNull(), "not-found").when(stale, "version-conflict")
    rows = joined.withColumn("reason", why)
    return rows.filter("reason is null").withColumn("version_id", F.col("_now") + 1).drop("_now", "reason"), rows.filter("reason is not null").drop("_now")
