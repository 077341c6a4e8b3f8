import json

import pytest
from pyspark.sql import functions as F

from medlattice.functions import fhirpath
from medlattice.functions.schema import Schemas
from medlattice.operators import graph, lifecycle, mpi, search, structure, terminology
from medlattice.operators.maintenance import Maintenance
from medlattice.plans import operations
from medlattice.plans.operations import DEFINITIONS, SCHEMAS
from medlattice.sources import loaders


def test_search_parse_modes():
    conditions, _ = search.parse("Encounter", "status:below=F&nothing=1&_filter=x")
    assert [(c.code, c.value, c.modifier) for c in conditions] == [("status", "F", "")]
    for wrong in ("status:below=F", "nothing=1"):
        with pytest.raises(search.SearchError):
            search.parse("Encounter", wrong, strict=True)
    with pytest.raises(search.SearchError):  # a known parameter that can't be served, in either mode
        search.parse("Encounter", "pair=1", registry={"Encounter": {"pair": "composite"}})
    (c,), _ = search.parse("Patient", "balance:of-type=gt5")
    assert (c.prefix, c.value, c.modifier) == ("gt", "5", "")


def test_unsupported_paths_are_skipped(spark):
    root = SCHEMAS.root("Patient")
    for text in ("Patient.name.resolve()", "Patient.nothing", "Patient.name is HumanName", "Patient.name.trace('x')", "Patient.name.", "name ="):
        with pytest.raises(fhirpath.Unsupported):
            fhirpath.compiled(text, F.col("r"), root)
    known = fhirpath.registry([{"code": "x", "type": "string", "base": ["Patient"], "expression": "Patient.nothing"}])
    df = spark.createDataFrame([("1", '{"id":"1"}')], "id string, body_json string")
    assert fhirpath.with_index(df, known, SCHEMAS, "Patient").first().idx == []


def test_timing_entries(spark):
    timing = [{"path": "Timing"}, {"path": "Timing.event", "max": "*", "type": [{"code": "dateTime"}]}, {"path": "Timing.repeat", "type": [{"code": "Element"}]}, {"path": "Timing.repeat.boundsPeriod", "type": [{"code": "Period"}]}]
    plan = [{"path": "Plan"}, {"path": "Plan.when", "type": [{"code": "Timing"}]}]
    known = Schemas({**DEFINITIONS, "Timing": {"snapshot": {"element": timing}}, "Plan": {"snapshot": {"element": plan}}}, depth=5)
    assert known.ddl("Plan") == "`id` string, `when` struct<`event`:array<string>,`_event`:array<string>,`repeat`:struct<`boundsPeriod`:struct<`start`:string,`_start`:string,`end`:string,`_end`:string>>>"
    body = json.dumps({"when": {"event": ["2020", "2021"], "repeat": {"boundsPeriod": {"start": "2019"}}}})
    df = spark.createDataFrame([(body,), ("{}",), (None,)], "body_json string")
    rows = fhirpath.with_index(df, fhirpath.registry([{"code": "d", "type": "date", "base": ["Plan"], "expression": "Plan.when"}]), known, "Plan").collect()
    assert [[e.value for e in r.idx] for r in rows] == [["2020", "2021", "2019"], [], []]


def test_index_rows_parse_a_document_once(spark):
    known = fhirpath.registry([{"code": c, "type": t, "base": ["Patient"], "expression": f"Patient.{e}"} for c, t, e in (("family", "string", "name.family"), ("gender", "token", "gender"))])
    df = spark.createDataFrame([("1", '{"gender":"x","name":[{"family":"A"},{"family":"B"}]}'), ("2", "{}"), ("3", None), ("4", '{"gender":""}')], "id string, body_json string")
    rows = fhirpath.index_rows(df, known, SCHEMAS, "Patient", "id")
    assert sorted(map(tuple, rows.collect())) == [("1", "family", "", "a"), ("1", "family", "", "b"), ("1", "gender", "", "x")]
    plans = [rows, operations.compiled_index(spark, "/root/testdata/sf0.001"), operations.compiled_index_patient(spark, "/root/testdata/sf0.001")]
    assert [p._jdf.queryExecution().optimizedPlan().toString().count("from_json(") for p in plans] == [1, 1, 1]


def test_structure_of_one_document():
    of = lambda doc: structure.structure_issues(doc, SCHEMAS.of("Patient"), "Patient")
    assert of({"resourceType": "Patient", "gender": "x", "_gender": {}, "name": [{"given": ["a"], "family": "b"}]}) == []
    assert of({"gender": "a  b", "name": ["x"], "active": 1}) == ["format:Patient.gender", "kind:Patient.active", "object:Patient.name[0]"]


def test_iteration_ends_and_leaves_out_matches(spark):
    idx = lambda r: [{"code": "next", "system": "", "value": f"Place/{r}"}]
    rows = [(k, idx(v), True, False) for k, v in (("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"))]
    df = spark.createDataFrame(rows, "id string, idx array<struct<code:string,system:string,value:string>>, is_current boolean, deleted boolean")
    got = graph.include_iterate(df.filter("id = 'a'"), [("Place", "next", "Place")], {"Place": df}, "Place")
    assert sorted(r.id for r in got.collect()) == ["b", "c"]
    assert graph.include_iterate(df.filter("id = 'x'"), [("Place", "next", "Place")], {"Place": df}, "Place").isEmpty()
    assert graph.chained_any(df, "next", {}, ["a=b"]).isEmpty() and graph.has(df, "Place", None, "Other", "x", "y=z").isEmpty()


def test_member_match_ladder(spark):
    who = spark.createDataFrame([("1", [("s", "x")], "Ann", "2000", "f"), ("2", [("t", "x")], "Bob", "2000", "m"), ("3", [("s", "y")], "Bob", "2000", "m")], "id string, identifiers array<struct<system:string,value:string>>, family string, birthdate string, gender string")
    asked = [("both", [("", "x")], None, None, None, None), ("system", [("s", "x")], None, None, None, None), ("second", [("", "x"), ("s", "y")], None, None, None, None), ("subscriber", [], "y", None, None, None), ("name", [("q", "q")], None, "ANN", "2000", "f"), ("twice", [], None, "bob", "2000", "m"), ("no", [], None, None, None, None)]
    got = mpi.member_match(spark.createDataFrame(asked, "asked string, identifiers array<struct<system:string,value:string>>, subscriber string, family string, birthdate string, gender string"), who)
    assert {r.asked: (r.result, r.id) for r in got.collect()} == {"both": ("several", None), "system": ("matched", "1"), "second": ("matched", "3"), "subscriber": ("matched", "3"), "name": ("matched", "1"), "twice": ("several", None), "no": ("none", None)}


def test_export_reports_failures(spark, tmp_path):
    ok = spark.createDataFrame([("{}",)], "body_json string")
    made = loaders.export({"Bad": ok.withColumn("body_json", F.raise_error(F.lit("broken")).cast("string")), "Good": ok}, f"file://{tmp_path}/x", "r", "now")
    assert made["status"] == "failed" and [e["type"] for e in made["error"]] == ["Bad"] and [o["count"] for o in made["output"]] == [1]
    assert loaders.manifest(spark, f"file://{tmp_path}/x").count() == 1


def test_unloaded_and_installed(spark):
    bound = spark.createDataFrame([("a|1",), ("b",)], "valueset string")
    assert [r[0] for r in terminology.unloaded_value_sets(bound, spark.createDataFrame([("a",)], "valueset string")).collect()] == ["b"]


def test_maintenance_is_single_flight():
    now, inner = [0.0], []
    m = Maintenance(lambda: inner.append(m.tick()), 10, clock=lambda: now[0])
    assert m.tick() and inner == [False] and not m.tick()  # neither inside a run nor before it is due
    now[0] = 10
    assert m.tick() and m.runs == 2
    bad = Maintenance(lambda: 1 / 0, 1, clock=lambda: now[0])
    assert bad.tick() and bad.runs == 0 and len(bad.errors) == 1


def test_common_conditions_are_not_joined(spark):
    """Requests that ask the same are one, and a condition that all rows meet is looked up in the rows that the other one finds."""
    idx = "array<struct<code:string,system:string,value:string>>"
    rows = [(str(k), [("sex", "", "m"), ("mrn", "s" if k % 2 else "t", f"P{k // 2}"), ("mrn", "s", "all")]) for k in range(200)]
    current = spark.createDataFrame(rows, f"id string, idx {idx}")
    asks = {"both": [("sex", "m", None), ("mrn", "P3", "s")], "any": [("mrn", "P3", None), ("mrn", "P3", None)], "all": [("sex", "m", None)], "none": [("sex", "m", None), ("mrn", "x", None)], "other": [("sex", "f", None)], "null": [("sex", None, None)], "two": [("mrn", "P3", "s"), ("mrn", "P3", "t")], "like": [("mrn", "P3", "s"), ("sex", "m", None)]}
    requests = spark.createDataFrame([(q, *c) for q, cs in asks.items() for c in cs] + [(f"r{k}", *c) for k in range(300) for c in asks["both"]], "request string, code string, value string, system string")
    found = lifecycle.matched(requests, current)
    joined = lifecycle._candidates(lifecycle._sets(requests), current).count()
    assert joined <= 200 + 2 + 2 + 2 * 2  # what the rarest condition of each set finds
    got = {r.request: (r.hits, r.hit) for r in found.collect()}
    assert got == {"both": (1, "7"), "any": (2, "6"), "all": (200, "0"), "none": (0, None), "other": (0, None), "null": (0, None), "two": (0, None), "like": (1, "7")} | {f"r{k}": (1, "7") for k in range(300)}
