from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from medlattice.sources.store import Catalog, Conflict, Table, retry
from medlattice.streaming import promote


def rows(spark, ids, v):
    return spark.createDataFrame([(i, v) for i in ids], "id string, v int")


def test_parallel_writes_all_land(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.overwrite(rows(spark, ["base"], 0))

    def create(k):
        return retry(lambda: t.upsert(rows(spark, [f"c{k}"], 1), t.version()), 50)

    def append(k):
        return Table(spark, t.path).append(rows(spark, [f"a{k}"], 2))

    with ThreadPoolExecutor(8) as pool:
        done = [pool.submit(create, k) for k in range(24)] + [pool.submit(append, k) for k in range(12)]
        versions = [d.result() for d in done]
    assert sorted(r.id for r in t.read().collect()) == sorted(["base", *[f"c{k}" for k in range(24)], *[f"a{k}" for k in range(12)]])
    assert len(set(versions)) == 36 and t.version() == 37


def test_writes_are_tied_to_what_they_read(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    assert t.read() is None and t.delete(F.col("v") == 1) is None
    assert t.append(rows(spark, [], 1)) == 0 and not t.exists()
    t.append(rows(spark, ["a"], 1))
    at = t.version()
    t.append(rows(spark, ["b"], 1))
    for action in (lambda: t.overwrite(rows(spark, ["x"], 1), at), lambda: t.upsert(rows(spark, ["a"], 3), at), lambda: t.delete(F.col("v") == 1, at), lambda: t.compact(expected=at)):
        with pytest.raises(Conflict):
            action()
    assert {r.id for r in t.read().collect()} == {"a", "b"} and [r.id for r in t.read(at).collect()] == ["a"]


def test_upsert_keeps_parts_of_other_ids(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.overwrite(rows(spark, [str(k) for k in range(200)], 0))
    before = set(t.parts(t.version()))
    t.upsert(rows(spark, ["7"], 9).withColumn("more", F.lit("x")))
    assert len(before & set(t.parts(t.version()))) == t.buckets - 1
    got = {r.id: (r.v, r.more) for r in t.read().collect()}
    assert len(got) == 200 and got["7"] == (9, "x") and got["8"] == (0, None)
    with pytest.raises(ValueError):
        Table(spark, t.path, key="id; drop")


def test_catalog_discovery_compaction_and_vacuum(spark, tmp_path):
    c = Catalog(f"file://{tmp_path}")
    assert c.tables(spark) == [] and c.serve(spark, "Patient") is None
    for kind, tier in (("Patient", "bronze"), ("Patient", "gold"), ("Encounter", "silver")):
        Table(spark, c.path(kind, tier)).overwrite(rows(spark, ["b", "a", "c"], 1))
    assert [n for n, _ in c.tables(spark)] == ["encounter_silver", "patient", "patient_gold"]
    (tmp_path / "gold" / "broken" / "_pointers").mkdir(parents=True)
    (tmp_path / "gold" / "broken" / "_pointers" / "00000001").write_text("nothing")
    done = dict(c.optimize(spark, ["id", "v"]))
    assert done["patient"] == done["encounter_silver"] == "ok" != done["broken_gold"]
    t = Table(spark, c.path("Patient"))
    assert sorted(r.id for r in t.read().collect()) == ["a", "b", "c"] and len(t.parts(t.version())) == 1
    with pytest.raises(ValueError):
        t.vacuum(1)
    assert t.vacuum(0, force=True) == 1 and t.read().count() == 3
    assert c.serve(spark, "Patient").count() == 3 and Catalog(c.base, "medallion").serve_tier() == "gold"
    for bad in (lambda: c.path("../x"), lambda: c.path("x", "up"), lambda: Table(spark, "/a/../b")):
        with pytest.raises(ValueError):
            bad()


def test_streaming_promotion(spark, tmp_path):
    schema = "id string, version_id bigint, deleted boolean"
    bronze, serving = f"{tmp_path}/bronze", Table(spark, f"file://{tmp_path}/gold")

    def run(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(bronze)
        q = promote.start(spark, bronze, schema, serving, f"{tmp_path}/checkpoint")
        q.awaitTermination()
        return sorted(map(tuple, serving.read().select("id", "version_id", "deleted").collect()))

    assert run([("a", 1, False), ("a", 2, False), ("b", 1, False)]) == [("a", 2, False), ("b", 1, False)]
    assert run([("b", 2, True), ("a", 1, False), ("c", 1, False)]) == [("a", 2, False), ("b", 2, True), ("c", 1, False)]
    promote.apply_batch(serving, spark.createDataFrame([("b", 1, False)], schema))
    assert len(serving.read().collect()) == 3


def test_versions_per_minute(spark):
    rows = spark.sql("select * from values (timestamp'2026-01-01 00:00:01'), (timestamp'2026-01-01 00:00:59'), (timestamp'2026-01-01 00:01:00') t(ingested_at)")
    assert sorted((r.window.start.minute, r.n) for r in promote.versions_per_minute(rows).collect()) == [(0, 2), (1, 1)]
