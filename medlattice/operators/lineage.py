"""Cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written once to the folder of spark.checkpoint.dir and read back; only where that is unset and the master is local, to a
    temporary one. A checkpoint would run the last stage twice, and later uses read the columns that they need only."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: the cluster needs a shared folder")
        sc.setCheckpointDir(shared or f"file://{tempfile.mkdtemp(prefix='medlattice-')}")
    path = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
