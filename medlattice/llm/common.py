"""What several operators share: scratch tables, text batches, column hygiene."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Only where it is unset and the master is local, as in tests on one machine,
    a temporary folder of the driver is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: the cluster needs a shared folder")
        root = f"file://{tempfile.mkdtemp(prefix='medlattice-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session ended first; the cluster's own cleaning takes over
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_root(spark)}/medlattice/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


class _Made(threading.local):
    """Paths that the tables of each open `temporary` lie at, in this thread."""

    def __init__(self):
        self.stack: list[list[str]] = []


_MADE = _Made()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at the end; those made with keep belong to the `temporary` around it, if any.
    What a query inside has shuffled is deleted when the query ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    _MADE.stack.append([])
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        for path in _MADE.stack.pop():
            delete_path(spark, path)


def table(df: DataFrame, name: str, *by: str, keep: bool = False) -> DataFrame:
    """Write df once to the shared folder, partitioned by these columns, and
    read it back: lineage ends here, so a lost executor costs a re-read and no
    recomputation."""
    path = scratch_path(df.sparkSession, name)
    if len(_MADE.stack) > keep:
        _MADE.stack[-1 - keep].append(path)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator, chars: int = 4_000_000, column: str = "text") -> Iterator:
    """Arrow batches cut so that each holds about `chars` bytes of text: what a
    task keeps in memory doesn't follow the session's rows per batch."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at, total = sizes.cumsum(), 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(ends.searchsorted(total + chars, side="right")))
            yield batch.slice(at, to - at)
            total, at = int(ends[to - 1]), to


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with these columns; columns of the same name, in any case, go."""
    names = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in new.items()])


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
