"""Versioned tables of Parquet parts behind a pointer.

A version is a pointer file that lists part folders. A write makes new parts and
then the next pointer, by a rename that fails if it is there; readers see the
old or the new version. Rows lie in parts by a hash of their id, so an upsert
rewrites only the parts that may hold its ids, and an append adds parts and
rewrites none. Paths go through Hadoop's file systems, so any store that Spark
reaches will do, if its rename is atomic.

A write is tied to the version that it has read: who comes second gets a
Conflict, and `retry` runs it again. Writes of one process to one table wait for
each other; an append that conflicts needs a new pointer only.
"""

from __future__ import annotations

import random
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCKS: dict[str, threading.RLock] = {}
BUCKETS = 8
SPREAD = 256
FILE_BYTES = 256 << 20
KEY = "id"
TIERS = ("bronze", "silver", "gold", "pending", "audit", "deadletter", "security")


class Conflict(RuntimeError):
    pass


class Catalog:
    """Names and places of tables: bronze ones by their type, others with the tier behind it."""

    def __init__(self, base: str, mode: str = "single"):
        self.base, self.mode, self.found = base.rstrip("/"), mode, set()

    def path(self, kind: str, tier: str = "bronze") -> str:
        if not kind.replace("_", "").isalnum() or tier not in TIERS:
            raise ValueError("bad table name")
        return f"{self.base}/{tier}/{kind.lower()}"

    def name(self, kind: str, tier: str = "bronze") -> str:
        return kind.lower() if tier == "bronze" else f"{kind.lower()}_{tier}"

    def serve_tier(self) -> str:
        return "gold" if self.mode == "medallion" else "bronze"

    def serve(self, spark: SparkSession, kind: str) -> DataFrame | None:
        """The serving table of a type; one that was found once is not looked for again."""
        t = Table(spark, self.path(kind, self.serve_tier()))
        if kind not in self.found and not t.exists():
            return None
        self.found.add(kind)
        return t.read()

    def tables(self, spark: SparkSession) -> list[tuple[str, str]]:
        """(name, path) of every table below the base, in order."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = []
        for tier in TIERS:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{tier}")
            for s in fs.listStatus(folder) if fs.exists(folder) else ():
                t = Table(spark, f"{self.base}/{tier}/{s.getPath().getName()}")
                if t.exists():
                    out.append((self.name(s.getPath().getName(), tier), t.path))
        return sorted(out)

    def optimize(self, spark: SparkSession, by: list[str] | str | None = KEY, vacuum_hours: float | None = None) -> list[tuple[str, str]]:
        """(name, "ok" or the error) of every table, compacted and, if wanted, vacuumed; one that fails doesn't stop the others."""
        out = []
        for name, path in self.tables(spark):
            try:
                t = Table(spark, path)
                retry(lambda t=t: t.compact(by))
                if vacuum_hours is not None:
                    t.vacuum(vacuum_hours)
                out.append((name, "ok"))
            except Exception as e:  # reported, not raised
                out.append((name, str(e).splitlines()[0]))
        return out


class Table:
    def __init__(self, spark: SparkSession, path: str, key: str = KEY, buckets: int = BUCKETS):
        if ".." in path.split("/") or "\\" in path:
            raise ValueError("path leaves the store")
        if not key.isidentifier():
            raise ValueError("bad key")
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.lock = _LOCKS.setdefault(self.path, threading.RLock())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._p("_pointers")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._p("_pointers")) if s.getPath().getName().isdigit())

    def parts(self, version: int) -> list[str]:
        """Part folders of a version; version 0 has none."""
        if not version:
            return []
        stream = self._fs.open(self._p(f"_pointers/{version:08d}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def version(self) -> int:
        return (self.versions() or [0])[-1]

    def exists(self) -> bool:
        return bool(self.versions())

    def _open(self, parts: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{x}" for x in parts])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version, or an older one; None without a table."""
        at = self.version() if version is None else version
        parts = self.parts(at)
        return self._open(parts) if parts else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> list[str]:
        """New parts that hold df: one folder for each bucket of ids."""
        folder = f"snapshot-{uuid.uuid4().hex}"
        if self.key in df.columns:
            spread = F.pmod(F.xxhash64(F.lit(1), F.col(self.key).cast("string")), F.lit(SPREAD))  # a large bucket is written by many tasks
            rows = df.withColumn("_bucket", self._bucket()).repartition("_bucket", spread)
            rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            got = [s.getPath().getName() for s in self._fs.listStatus(self._p(folder))]
            if own := sorted(f"{folder}/{x}" for x in got if x.startswith("_bucket=")):
                return own
            self._fs.delete(self._p(folder), True)  # no rows: a part that holds the schema
        df.write.parquet(f"{self.path}/{folder}")
        return [folder]

    def _commit(self, parts: list[str], expected: int) -> int:
        """The pointer of version expected + 1 is made once; who comes second gets a conflict."""
        new = self._p(f"_pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray("\n".join(parts).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(new, self._p(f"_pointers/{expected + 1:08d}"), none)
        except Exception as e:
            self._fs.delete(new, False)
            if self.version() > expected:
                raise Conflict(f"version {expected + 1} is there") from e
            raise
        return expected + 1

    def overwrite(self, df: DataFrame, expected: int | None = None) -> int:
        """The table's rows, and schema, become df's; `expected`: only if the table is still at that version."""
        with self.lock:
            at = self.version() if expected is None else expected
            return self._commit(self._write(df), at)

    def append(self, df: DataFrame, attempts: int = 100) -> int:
        """Add rows; nothing is rewritten, so a conflict only asks for the next pointer. No rows change nothing."""
        if df.isEmpty():
            return self.version()
        new = self._write(df)

        def commit() -> int:
            at = self.version()
            return self._commit([*self.parts(at), *new], at)

        with self.lock:
            return retry(commit, attempts)

    def upsert(self, df: DataFrame, expected: int | None = None) -> int:
        """Rows of df replace those with the same key, all others stay; only parts that may hold a key of df are rewritten."""
        with self.lock:
            at = self.version() if expected is None else expected
            parts = self.parts(at)
            if not parts:
                return self._commit(self._write(df), at)
            touched = {r[0] for r in df.select(self._bucket()).distinct().collect()}  # as many as buckets at most
            hit = [x for x in parts if "/_bucket=" not in x or int(x.rsplit("=", 1)[1]) in touched]
            old = self._open(hit).join(df.select(self.key).distinct(), self.key, "left_anti") if hit else None
            rows = df if old is None else old.unionByName(df, allowMissingColumns=True)
            return self._commit([*[x for x in parts if x not in hit], *self._write(rows)], at)

    def delete(self, where: Column, expected: int | None = None) -> int | None:
        """Delete rows; None where there is no table."""
        with self.lock:
            at = self.version() if expected is None else expected
            old = self.read(at)
            return None if old is None else self._commit(self._write(old.filter(~F.coalesce(where, F.lit(False)))), at)

    def compact(self, by: list[str] | str | None = KEY, files: int | None = None, expected: int | None = None) -> int:
        """Rewritten into `files` files, by default as many as FILE_BYTES ask for: sorted by a column, so that row groups can be
        skipped, or by the interleaved bits of several."""
        with self.lock:
            at = self.version() if expected is None else expected
            if files is None:
                files = 1 + sum(self._fs.getContentSummary(self._p(x)).getLength() for x in self.parts(at)) // FILE_BYTES
            old, folder = self.read(at), f"snapshot-{uuid.uuid4().hex}"
            keys = [c for c in ([by] if isinstance(by, str) else by or []) if c in old.columns]
            if len(keys) == 1:
                out = old.repartitionByRange(files, keys[0]).sortWithinPartitions(keys[0])
            elif keys:
                out = interleaved(old, keys).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
            else:
                out = old.coalesce(files)
            out.write.parquet(f"{self.path}/{folder}")
            return self._commit([folder], at)

    def vacuum(self, hours: float = 168, force: bool = False) -> int:
        """Delete snapshots that only older versions point at, once they are older than `hours`."""
        if hours < 168 and not force:
            raise ValueError("less than the least retention")
        live = {x.split("/")[0] for x in self.parts(self.version())}
        limit, gone = (time.time() - hours * 3600) * 1000, 0
        for s in self._fs.listStatus(self._p("")):
            name = s.getPath().getName()
            if name.startswith("snapshot-") and name not in live and s.getModificationTime() <= limit:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone


def interleaved(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with _z: the bits of each key's rank among 256 quantiles, interleaved; the quantiles come from a mergeable sketch."""
    steps = [k / (1 << 8) for k in range(1, 1 << 8)]
    codes = []
    for k in keys:
        text = F.conv(F.substring(F.rpad(F.hex(F.col(k).cast("string")), 14, "0"), 1, 14), 16, 10).cast("double")
        number = F.col(k).cast("double") if dict(df.dtypes)[k] in ("bigint", "int", "double", "float", "smallint") else text
        cuts = sorted(set(df.select(F.percentile_approx(number, steps).alias("q")).first()[0] or []))
        codes.append(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c, number=number: c < F.coalesce(number, F.lit(float("-inf"))))).cast("bigint") if cuts else F.lit(0).cast("bigint"))
    z = F.lit(0).cast("bigint")
    for b in range(8):
        for n, c in enumerate(codes):
            z = z + F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), b * len(codes) + n)
    return df.withColumn("_z", z)


def retry(action, attempts: int = 5, first: float = 0.05, most: float = 1.0):
    """Again after a conflict, with growing waits; other errors pass."""
    for k in range(attempts):
        try:
            return action()
        except Conflict:
            if k + 1 == attempts:
                raise
            time.sleep(min(most, first * 2**k) * (0.5 + random.random() / 2))


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame | None], args: dict | None = None) -> DataFrame:
    """SQL over named tables; those that don't exist are left out."""
    for name, df in tables.items():
        if df is not None:
            df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})
