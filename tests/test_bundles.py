import json

from medlattice.operators import bundle, profile

SCHEMA = "bundle string, n int, full_url string, method string, url string, if_none_exist string, body string"
STORED = [("Patient", "s", "1", "p1"), ("Patient", "s", "2", "p2"), ("Patient", "s", "2", "p3"), ("Organization", "", "o", "o1")]


def applied(spark, rows):
    entries = spark.createDataFrame([(b, n, f, m, u, i, json.dumps(x) if x is not None else None) for b, n, f, m, u, i, x in rows], SCHEMA)
    got = bundle.apply(entries, spark.createDataFrame(STORED, "kind string, system string, value string, id string")).collect()
    return {(r.bundle, r.n): r for r in got}


def test_bundle(spark):
    of = lambda ref: {"resourceType": "Observation", "subject": {"reference": ref}, "note": [{"text": ref}]}
    new = {"resourceType": "Patient", "identifier": [{"system": "s", "value": "9"}]}
    rows = [
        ("a", 0, "urn:uuid:x", "POST", None, None, new),
        ("a", 1, None, "POST", None, None, of("urn:uuid:x")),
        ("a", 2, None, "PUT", "Observation/o7", None, of("Patient?identifier=s|9")),
        ("a", 3, None, "POST", None, None, of("Organization?identifier=|o")),
        ("a", 4, None, "POST", None, None, of("Patient/p1")),
        ("b", 0, "urn:uuid:x", "POST", None, "identifier=s|1", new),
        ("b", 1, None, "POST", None, None, of("urn:uuid:x")),
        ("c", 0, None, "POST", None, "identifier=s|2", new),
        ("c", 1, None, "POST", None, None, of("Patient/p1")),
        ("d", 0, None, "POST", None, None, of("urn:uuid:x")),  # of another bundle
        ("e", 0, None, "POST", None, None, of("Patient?identifier=s|2")),
        ("f", 0, None, "POST", None, None, None),
        ("g", 0, None, "DELETE", "Patient/p1", None, new),
        ("h", 0, None, "PUT", None, None, new),
        ("i", 0, None, "POST", None, "name=x", new),
    ]
    got = applied(spark, rows)
    assert len(got) == len(rows)
    subject = lambda *k: json.loads(got[k].body)["subject"]["reference"]
    mine = f"Patient/{got['a', 0].id}"
    assert [got["a", n].status for n in range(5)] == ["created", "created", "updated", "created", "created"] and got["a", 2].id == "o7"
    assert [subject("a", n) for n in range(1, 5)] == [mine, mine, "Organization/o1", "Patient/p1"]
    assert json.loads(got["a", 1].body)["note"][0]["text"] == "urn:uuid:x"
    assert (got["b", 0].status, got["b", 0].id, subject("b", 1)) == ("exists", "p1", "Patient/p1")
    why = {"c": "multiple-matches", "d": "unresolved", "e": "unresolved", "f": "no-type", "g": "method", "h": "url", "i": "condition"}
    for b, reason in why.items():
        assert {(r.status, r.reason, r.id, r.body) for (x, _), r in got.items() if x == b} == {("rejected", reason, None, None)}
    assert applied(spark, rows)["a", 1].id == got["a", 1].id and applied(spark, []) == {}


def test_no_task_gets_all_that_ask_alike(spark, monkeypatch):
    """Entries without a condition, and those with the same one, are dealt over keys of the join, with the same result."""
    ask = {"resourceType": "Observation", "subject": {"reference": "Organization?identifier=|o"}}
    rows = [(f"b{k}", 0, None, "POST", None, "identifier=s|1" if k % 2 else None, ask | ({"resourceType": "Patient"} if k % 2 else {})) for k in range(400)]
    plain = {k: (r.status, r.id, r.body) for k, r in applied(spark, rows).items()}
    monkeypatch.setattr(bundle, "ASKS", 20)
    assert {k: (r.status, r.id, r.body) for k, r in applied(spark, rows).items()} == plain
    e = spark.createDataFrame([(f"b{k}", 0, "Patient" if k % 2 else "Observation", "s" if k % 2 else None, "1" if k % 2 else None) for k in range(400)], "bundle string, n int, kind string, system string, value string")
    asked = e.filter("value is not null").groupBy(*bundle.KEYS).count().withColumnRenamed("count", "asks")
    assert max(r["count"] for r in bundle._salted(e, asked).groupBy(*bundle.KEYS, "_salt").count().collect()) <= 60


def test_profile(spark):
    path = lambda p, i=None, **k: {"id": f"Observation.{i or p}", "path": f"Observation.{p}"} | k
    definition = {
        "url": "urn:p",
        "snapshot": {
            "element": [
                path("status", min=1), path("value[x]", min=1), path("component.code", min=1), path("note.text", min=0),
                path("category", "category:lab", sliceName="lab", min=1), path("category.coding.code", "category:lab.coding.code", fixedCode="laboratory", min=1),
            ]
        },
    }
    lab = {"coding": [{"code": "laboratory"}]}
    docs = [
        ({"status": "final", "valueQuantity": {"value": 0}, "category": [lab]}, []),
        ({"status": "", "valueString": "x", "category": [lab, {}]}, ["required:status"]),
        ({"status": "final", "values": 1, "component": [{"code": {"text": "a"}}, {"x": 1}]}, ["required:value[x]", "required:component.code", "slice:category:lab"]),
        (None, ["required:status", "required:value[x]", "slice:category:lab"]),
    ]
    for doc, want in docs:
        body = json.dumps(doc) if doc else None
        assert profile.missing(body, profile.requirements(definition)) + profile.short_slices(body, profile.slice_rules(definition)) == want
    df = spark.createDataFrame([(json.dumps({"meta": {"profile": ["urn:p|1"]}}),), ("{}",), (None,)], "b string")
    got = [len(r.i) for r in df.select(profile.profile_issues(df.b, [definition], declared=True).alias("i")).collect()]
    assert got == [3, 0, 0]


def test_projections(spark):
    df = spark.createDataFrame([('{"resourceType":"Patient","meta":{"tag":[1]},"text":"t","name":"é"}', "1", 2, "now"), (None, "2", 1, "now")], "b string, id string, v int, t string")
    got = [(json.loads(r.e), json.loads(r.s)) if r.e else (r.e, r.s) for r in df.select(profile.elements(df.b, ["text"]).alias("e"), profile.stamp(df.b, df.id, df.v, df.t).alias("s")).collect()]
    assert got[0][0] == {"resourceType": "Patient", "meta": {"tag": [1]}, "text": "t"}
    assert got[0][1] == {"resourceType": "Patient", "meta": {"tag": [1], "versionId": "2", "lastUpdated": "now"}, "text": "t", "name": "é", "id": "1"} and got[1] == (None, None)
