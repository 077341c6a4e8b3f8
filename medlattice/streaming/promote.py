"""Incremental promotion: a stream over appended versions keeps the serving table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.operators.history import newest
from medlattice.sources.store import Table, retry


def apply_batch(serving: Table, batch: DataFrame) -> None:
    """Newer versions win, so a batch that is replayed changes nothing; only parts that may hold its ids are rewritten."""

    def once() -> None:
        fresh, at = newest(batch), serving.version()
        old = serving.read(at)
        if old is not None:
            known = old.select("id", F.col("version_id").alias("_v"))
            fresh = fresh.select(*old.columns).join(known, "id", "left").filter(F.col("_v").isNull() | (F.col("_v") < F.col("version_id"))).drop("_v")
        serving.upsert(fresh, at)

    retry(once)


def start(spark: SparkSession, bronze: str, schema, serving: Table, checkpoint: str, files: int = 1000):
    """A query that promotes what is there and ends; run it again, or with another trigger, for what comes."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(bronze)
    return stream.writeStream.foreachBatch(lambda df, _: apply_batch(serving, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions_per_minute(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ingest monitoring: versions in tumbling windows of a minute, with a watermark for late rows."""
    return stream.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", "1 minute")).agg(F.count("*").alias("n"))
