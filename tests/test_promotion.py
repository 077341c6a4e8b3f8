import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.operators import history, mpi, promotion
from medlattice.plans.operations import NOW, SCHEMAS

IDX = "array<struct<code:string,system:string,value:string>>"


def counted(spark, df, column):
    """df whose rows are counted each time they are made."""
    n = spark.sparkContext.accumulator(0)

    def same(x):
        n.add(1)
        return x

    return df.withColumn(column, F.udf(same, T.StringType())(column)), n


def test_newest_sorts_after_the_shuffle(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "u"), ("b", None, "v"), ("c", 0, None)]
    got = history.newest(spark.createDataFrame(rows, "id string, version_id bigint, body_json string"))
    assert sorted(map(tuple, got.collect())) == [("a", 2, "z"), ("b", None, "v"), ("c", 0, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[plan.rindex("Exchange") :]  # what a task reads isn't sorted


def test_links_are_made_once(spark):
    people = spark.createDataFrame([(f"{k:02}",) for k in range(20)], "id string")
    edges, n = counted(spark, spark.createDataFrame([(f"{k + 1:02}", f"{k:02}") for k in range(9)] + [("15", "12")], "u string, v string"), "u")
    got = {r.id: r.component for r in mpi.components(people, edges).collect()}
    assert got == {f"{k:02}": "00" if k < 10 else "12" if k == 15 else f"{k:02}" for k in range(20)}
    assert n.value == 10
    assert all(r.id == r.component for r in mpi.components(people, edges.limit(0)).collect())


def test_silver_reads_its_rows_once(spark):
    rows = [(str(k), 1, False, json.dumps({"id": str(k), "gender": "x"})) for k in range(7)]
    current, n = counted(spark, spark.createDataFrame(rows, "id string, version_id bigint, deleted boolean, body_json string"), "body_json")
    got = promotion.silver(current, SCHEMAS, "Patient", NOW)
    assert got.count() == 7 and "gender" in got.columns and "contact" not in got.columns and [r.gender for r in got.collect()] == ["x"] * 7
    assert n.value == 7


def test_references_are_looked_up_in_one_pass(spark):
    ref = lambda x: json.dumps({"subject": {"reference": x}}, separators=(",", ":"))
    entry = lambda *xs: [("subject", "", x) for x in xs]
    rows = [("1", 1, ref("Patient/old"), entry("Patient/old", "Patient/a")), ("1", 2, ref("Patient/b/_history/1"), entry("Patient/b")), ("2", 1, ref("x/Patient/a/_history/2"), entry("Patient/a", "Group/a", "Patient/b", "Patient/c")), ("3", 1, ref("Patient/c"), entry("Patient/c")), ("4", 1, None, None), ("5", 1, "{}", entry("Patient/a"))]
    bronze, n = counted(spark, spark.createDataFrame(rows, f"id string, version_id bigint, body_json string, idx {IDX}"), "body_json")
    got = promotion.promote_others(bronze, spark.createDataFrame([("a", "A"), ("b", "B")], "merged string, survivor string"))
    assert {r.id: (r.body_json, [e.value for e in r.idx] if r.idx else r.idx) for r in got.collect()} == {
        "1": (ref("Patient/B/_history/1"), ["Patient/B"]), "2": (ref("x/Patient/A/_history/2"), ["Patient/A", "Group/a", "Patient/B", "Patient/c"]), "3": (ref("Patient/c"), ["Patient/c"]), "4": (None, None), "5": ("{}", ["Patient/A"]),
    }
    assert n.value <= 2 * len(rows)  # for the look-up and for the result
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [merged") == 1
