"""Queries of resource life cycle, promotion, validation by definitions, compiled indexes, consent and terminology upkeep."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.functions import fhirpath
from medlattice.functions.schema import Schemas, flatten
from medlattice.operators import graph, history, lifecycle, mpi, profile, promotion, search, security, structure, terminology, validate
from medlattice.operators.lineage import cut
from medlattice.plans import resources as rs
from medlattice.plans.queries import _decided, _table, query
from medlattice.sources import loaders

NOW = "2026-01-01T00:00:00Z"


def _element(path: str, *types: str, least: int = 0, most: str = "1", **more) -> dict:
    return {"id": path, "path": path, "min": least, "max": most, "type": [{"code": t} for t in types]} | more


def definition(kind: str, *elements: dict, of: str = "resource") -> dict:
    return {"resourceType": "StructureDefinition", "url": f"urn:definition:{kind}", "name": kind, "type": kind, "kind": of, "derivation": "specialization", "snapshot": {"element": [{"id": kind, "path": kind}, *elements]}}


#: Structure definitions of the derived types, as far as they have elements.
DEFINITIONS = {
    d["type"]: d
    for d in (
        definition("HumanName", _element("HumanName.family", "string"), _element("HumanName.given", "string", most="*"), of="complex-type"),
        definition("Coding", _element("Coding.system", "uri"), _element("Coding.code", "code"), of="complex-type"),
        definition("CodeableConcept", _element("CodeableConcept.coding", "Coding", most="*"), _element("CodeableConcept.text", "string"), of="complex-type"),
        definition("Identifier", _element("Identifier.system", "uri"), _element("Identifier.value", "string"), of="complex-type"),
        definition("Reference", _element("Reference.reference", "string"), of="complex-type"),
        definition("Period", _element("Period.start", "dateTime"), _element("Period.end", "dateTime"), of="complex-type"),
        definition("Quantity", _element("Quantity.value", "decimal"), _element("Quantity.unit", "string"), _element("Quantity.system", "uri"), _element("Quantity.code", "code"), of="complex-type"),
        definition("Patient", _element("Patient.id", "id"), _element("Patient.active", "boolean"), _element("Patient.name", "HumanName", most="*"), _element("Patient.gender", "code", least=1, binding={"strength": "required", "valueSet": "urn:vs:gender|4.0"}), _element("Patient.identifier", "Identifier", most="*"), _element("Patient.contact", "BackboneElement", most="*"), _element("Patient.contact.name", "HumanName", least=1)),
        definition("Observation", _element("Observation.status", "code", least=1), _element("Observation.code", "CodeableConcept", least=1), _element("Observation.subject", "Reference"), _element("Observation.effective[x]", "dateTime", "Period"), _element("Observation.value[x]", "Quantity", "string"), _element("Observation.performer", "Reference", most="*")),
    )
}
SCHEMAS = Schemas(DEFINITIONS)
#: Search parameters of the derived types, as documents.
PARAMETERS = [
    {"code": c, "type": t, "base": [k], "expression": e}
    for k, c, t, e in (
        ("Patient", "family", "string", "Patient.name.family"), ("Patient", "gender", "token", "Patient.gender"), ("Patient", "identifier", "token", "Patient.identifier"), ("Patient", "mrn", "token", "Patient.identifier.where(system = 'urn:mrn')"),
        ("Observation", "code", "token", "Observation.code"), ("Observation", "date", "date", "Observation.effective"), ("Observation", "value-quantity", "quantity", "(Observation.value as Quantity)"), ("Observation", "value-string", "string", "Observation.value.ofType(string)"),
        ("Observation", "subject", "reference", "Observation.subject"), ("Observation", "performer", "reference", "Observation.performer"), ("Observation", "resolved", "reference", "Observation.subject.resolve()"),
    )
] + [{"code": "pair", "type": "composite", "base": ["Observation"], "expression": "Observation"}]
REGISTRY = fhirpath.registry(PARAMETERS)


def _observations(spark, d):
    """Line items as Observation documents: quantities or strings, instants or periods."""
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    day, even = F.substring(F.col("l_shipdate").cast("string"), 1, 10), F.col("l_linenumber") % 2 == 0
    body = F.struct(
        F.lit("Observation").alias("resourceType"), key.alias("id"), F.lit("final").alias("status"), F.struct(F.array(F.struct(F.lit("urn:flag").alias("system"), F.col("l_returnflag").alias("code"))).alias("coding")).alias("code"),
        F.struct(F.concat(F.lit("Patient/"), (F.col("l_orderkey") % 50).cast("string")).alias("reference")).alias("subject"), F.when(even, day).alias("effectiveDateTime"), F.when(~even, F.struct(day.alias("start"))).alias("effectivePeriod"),
        F.when(even, F.struct(F.col("l_quantity").cast("bigint").alias("value"), F.lit("u").alias("unit"))).alias("valueQuantity"), F.when(~even, F.col("l_linestatus")).alias("valueString"),
        F.array(F.struct(F.concat(F.lit("Organization/"), F.col("l_suppkey").cast("string")).alias("reference"))).alias("performer"),
    )
    return rs._load(spark, d, "lineitem").select(key.alias("id"), F.col("l_partkey").alias("part"), F.to_json(body).alias("body_json"))


@query(
    "",
    """with l as (select l_orderkey || '-' || l_linenumber id, l_partkey part, *, substr(cast(l_shipdate as varchar), 1, 10) d from lineitem), e as (
 select id, part, 'code' code, 'urn:flag' system, l_returnflag as value from l union all select id, part, 'date', '', d from l union all select id, part, 'value-quantity', 'u', cast(cast(l_quantity as bigint) as varchar) || '.0' from l where l_linenumber % 2 = 0 union all
 select id, part, 'value-string', '', lower(l_linestatus) from l where l_linenumber % 2 = 1 union all select id, part, 'subject', '', 'Patient/' || (l_orderkey % 50) from l union all select id, part, 'performer', '', 'Organization/' || l_suppkey from l) select * from e""",
)
def compiled_index(spark, d):
    """Index entries of observations by the registry's FHIRPath expressions."""
    return fhirpath.index_rows(_observations(spark, d), REGISTRY, SCHEMAS, "Observation", "id", "part")


@query("patient", "select id, 'family' code, '' system, family as value from patient union all select id, 'gender', '', gender from patient where gender is not null union all select id, 'identifier', 'urn:mrn', mrn from patient union all select id, 'mrn', 'urn:mrn', mrn from patient")
def compiled_index_patient(spark, d):
    return fhirpath.index_rows(rs.patient(spark, d).drop("idx"), REGISTRY, SCHEMAS, "Patient", "id")


@query("", "select code, type, expression from (values " + ", ".join(f"('{c}', '{p['type']}', '{p['expression'].replace(chr(39), chr(39) * 2)}')" for c, p in REGISTRY["Observation"].items()) + ") t(code, type, expression)")
def search_registry(spark, d):
    return spark.createDataFrame([(c, p["type"], p["expression"]) for c, p in fhirpath.registry(PARAMETERS, [{"code": "code", "type": "string", "base": ["Observation"], "expression": "Observation.status"}])["Observation"].items()], "code string, type string, expression string")


@query("patient", "select id, segment from patient where segment = 'MACHINERY'")
def search_uri(spark, d):
    return search.search(rs.patient(spark, d), "Patient", "profile=urn:profile:MACHINERY", paged=False).select("id", "segment")


@query("encounter", "select id from encounter where status = 'F'")
def search_lenient_modifier(spark, d):
    """A modifier that the index can't serve matches plainly, and an unknown parameter is ignored."""
    return search.search(rs.encounter(spark, d), "Encounter", "status:below=F&nothing=1", paged=False).select("id")


@query("encounter", "select id from encounter where status in ('F', 'O')")
def search_value_list(spark, d):
    return search.matching(search.current(rs.encounter(spark, d)), [search.Condition("status", "token", ["F", "O"])]).select("id")


@query("patient encounter", "select e.id from encounter e where subject in (select 'Patient/' || id from patient where segment in ('BUILDING', 'MACHINERY'))")
def chain_any_value(spark, d):
    return graph.chained_any(rs.encounter(spark, d), "subject", {"Patient": rs.patient(spark, d)}, ["segment=BUILDING", "segment=MACHINERY"]).select("id")


@query("patient encounter", "select id from patient where 'Patient/' || id in (select subject from encounter where status = 'P') and 'Patient/' || id in (select subject from encounter where cls = '1-URGENT')")
def has_several(spark, d):
    e = rs.encounter(spark, d)
    return graph.has_all(rs.patient(spark, d), "Patient", [(e, "Encounter", "subject", "status=P"), (e, "Encounter", "subject", "class=1-URGENT")]).select("id")


@query("", "with recursive r as (select n_nationkey k, 0 depth from nation where n_nationkey = 3 union select (k * 7 + 1) % 25, depth + 1 from r where depth < 5) select distinct 'Place' as type, cast(k as varchar) id from r where k <> 3")
def include_cycle(spark, d):
    """References that lead back to the matches include them not once more; five rounds."""
    k = F.col("n_nationkey")
    ref = F.concat(F.lit("Place/"), ((k * 7 + 1) % 25).cast("string"))
    idx = F.array(F.struct(F.lit("next").alias("code"), F.lit("").alias("system"), ref.alias("value")))
    places = rs._load(spark, d, "nation").select(k.cast("string").alias("id"), idx.alias("idx"), F.lit(True).alias("is_current"), F.lit(False).alias("deleted"))
    return graph.include_iterate(places.filter("id = '3'"), [("Place", "next", "Place")], {"Place": places}, "Place")


@query("encounter", "select count(*) total, case when count(*) > 150 then 150 end as next from encounter where status = 'F'")
def search_page_info(spark, d):
    return lifecycle.page_info(search.search(rs.encounter(spark, d), "Encounter", "status=F", paged=False), 50, 100)


@query("versions obsv", "select 'Event' as type, count(*) total from versions union all select 'Observation', count(*) from obsv")
def history_totals(spark, d):
    return lifecycle.history_totals({"Event": rs.versions(spark, d), "Observation": rs.observation_versions(spark, d)})


@query("brands expansion", "select count(*) total from expansion where valueset = 'vs-all' and contains(lower(code), '#2')")
def vs_expand_total(spark, d):
    return terminology.expansion_total(rs.value_sets(spark, d)[0], "vs-all", "#2")


@query("", "with n as (select case when event_id % 2 = 0 then cast(user_id % 400 as varchar) else (user_id % 400) || 'y' end id, event_id n from events), s as (select distinct cast(user_id as varchar) id from events) select n, case when s.id is not null or n > min(n) over (partition by n.id) then 'conflict' else 'created' end status from n left join s on s.id = n.id")
def create_batch(spark, d):
    """Creates with ids that are stored (even events), new ones, and repeats of these."""
    e = rs._load(spark, d, "events")
    stored = rs.versions(spark, d)
    key = F.concat((F.col("user_id") % 400).cast("string"), F.when(F.col("event_id") % 2 == 0, "").otherwise("y"))
    rows, rejects = lifecycle.create(stored, e.select(key.alias("id"), F.col("event_id").alias("n")), NOW)
    return rows.select("n", F.lit("created").alias("status")).unionByName(rejects.select("n", F.col("reason").alias("status")))


@query("", "select event_id n, 36 len, '7' version, true ok from events")
def create_ids(spark, d):
    """Made ids: version 7, of the batch's time, all different."""
    stored = rs.versions(spark, d)
    rows, _ = lifecycle.create(stored, rs._load(spark, d, "events").select(F.lit(None).cast("string").alias("id"), F.col("event_id").alias("n")), NOW)
    from medlattice.functions.index import uuid7_millis

    ok = (uuid7_millis(F.col("id")) == 1767225600000) & F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return rows.select("n", F.length("id").alias("len"), F.substring("id", 15, 1).alias("version"), ok.alias("ok"))


@query("versions", "with v as (select id, max(version_id) m from versions group by id) select id, case when cast(id as bigint) % 3 = 2 then 'version-conflict' else cast(m + 1 as varchar) end outcome from v union all select 'none', 'not-found'")
def update_if_match(spark, d):
    """Updates with the current ETag, with none, and with an old one."""
    stored = rs.versions(spark, d)
    k = F.col("id").cast("bigint") % 3
    new = history.newest(stored).select("id", F.when(k == 0, F.concat(F.lit('W/"'), F.col("version_id").cast("string"), F.lit('"'))).when(k == 2, 'W/"0"').alias("etag"))
    new = new.unionByName(spark.createDataFrame([("none", None)], "id string, etag string"))
    rows, rejects = lifecycle.update(stored, new, NOW, "etag")
    return rows.select("id", F.col("version_id").cast("string").alias("outcome")).unionByName(rejects.select("id", F.col("reason").alias("outcome")))


@query("versions", "with v as (select id, version_id m, deleted, event_type from versions qualify row_number() over (partition by id order by version_id desc) = 1) select id, case when deleted then 'gone' else cast(m + 1 as varchar) end outcome, case when not deleted then event_type end body from v union all select 'none', 'not-found', null")
def delete_batch(spark, d):
    stored = rs.versions(spark, d)
    ids = stored.select("id").unionByName(spark.createDataFrame([("none",)], "id string"))
    rows, rejects = lifecycle.delete(stored, ids, NOW)
    return rows.select("id", F.col("version_id").cast("string").alias("outcome"), F.col("event_type").alias("body")).unionByName(rejects.select("id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("body")))


@query(
    "patient",
    """with r as (select cast(p_partkey as varchar) request, case p_partkey % 3 when 0 then 'POST' when 1 then 'PUT' else 'DELETE' end as method, 'P' || (p_partkey % 40) mrn from part), h as (select mrn, count(*) n, min(id) i from patient where gender = 'male' group by mrn)
 select request, case when n > 1 then 'refused' when n = 1 then (case method when 'POST' then 'exists' when 'PUT' then 'update' else 'delete' end) when method = 'DELETE' then 'nothing' else 'create' end action, case when n = 1 then i end id from r left join h on r.mrn = h.mrn""",
)
def conditional_requests(spark, d):
    """Conditional creates, updates and deletes by an identifier and a gender together."""
    k = F.col("p_partkey")
    req = rs._load(spark, d, "part").select(k.cast("string").alias("request"), F.when(k % 3 == 0, "POST").when(k % 3 == 1, "PUT").otherwise("DELETE").alias("method"), F.concat(F.lit("P"), (k % 40).cast("string")).alias("mrn"))
    none = F.lit(None).cast("string")
    conditions = req.select("request", F.lit("identifier").alias("code"), F.col("mrn").alias("value"), F.lit("urn:mrn").alias("system")).unionByName(req.select("request", F.lit("gender").alias("code"), F.lit("male").alias("value"), none.alias("system")))
    return lifecycle.conditional(req, lifecycle.matched(conditions, search.current(rs.patient(spark, d))))


@query("", "select r_name as name, 2 + r_regionkey as version from region where r_regionkey <> 2 union all select r_name, 3 from region where r_regionkey = 2 union all select 'new', 1")
def concurrent_appends(spark, d):
    """Appends and upserts in parallel on one table: all land. Each region's row is replaced by one writer, and one more is appended."""
    from concurrent.futures import ThreadPoolExecutor

    from medlattice.sources.store import retry

    t = _table(spark, "concurrent")
    region = rs._load(spark, d, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").cast("bigint").alias("k"))
    t.overwrite(region.select("id", F.lit(0).cast("bigint").alias("version")))
    new = lambda k: region.filter(F.col("k") == k).select("id", F.when(F.col("k") == 2, 3).otherwise(F.col("k") + 2).cast("bigint").alias("version"))
    jobs = [lambda k=k: retry(lambda: t.upsert(new(k), t.version()), 50) for k in range(5)] + [lambda: t.append(spark.createDataFrame([("new", 1)], "id string, version bigint"))]
    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()
    return t.read().select(F.col("id").alias("name"), "version")


@query("", "select name, 'ok' result from (values ('bronze_table'), ('other_gold'), ('third_silver')) t(name)")
def optimize_all(spark, d):
    """Tables are found by their pointers, and compacted by interleaved bits of two columns."""
    from medlattice.sources.store import Catalog, Table

    c = Catalog(f"{_table(spark, 'catalog').path}")
    for kind, tier in (("bronze_table", "bronze"), ("other", "gold"), ("third", "silver")):
        Table(spark, c.path(kind, tier)).overwrite(rs._load(spark, d, "nation").select(F.col("n_name").alias("id"), "n_regionkey"))
    return spark.createDataFrame(c.optimize(spark, ["id", "n_regionkey"], 168), "name string, result string")


@query("", "select n_name as id, n_regionkey as region from nation")
def clustered_table(spark, d):
    t = _table(spark, "clustered")
    t.overwrite(rs._load(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("region")))
    t.compact(["id", "region"], 2)
    return t.read()


@query(
    "merged patient",
    """select p.id, m.merged is null is_current, case when m.merged is null then null else false end active, coalesce((select string_agg('replaces:' || merged, ',' order by merged) from merged x where x.survivor = p.id), 'replaced-by:' || m.survivor, '') links,
 1 + coalesce((select 1 from merged x where x.survivor = p.id), 0) mrns from patient p left join merged m on p.id = m.merged""",
)
def promote_merge(spark, d):
    """Survivors link and answer for what they replace; merged patients are inactive and leave searches."""
    rows = promotion.promote_patients(rs.patient(spark, d), mpi.merges(_decided(spark, d)))
    link = F.from_json(F.get_json_object("body_json", "$.link"), "array<struct<other:struct<reference:string>,type:string>>")
    said = F.array_join(F.array_sort(F.transform(link, lambda x: F.concat(x["type"], F.lit(":"), F.regexp_replace(x["other"]["reference"], "^Patient/", "")))), ",")
    names = F.filter("identifiers", lambda i: i["system"] == "urn:cust")
    return rows.select("id", "is_current", F.get_json_object("body_json", "$.active").cast("boolean").alias("active"), F.coalesce(said, F.lit("")).alias("links"), F.size(names).alias("mrns"))


@query("merged encounter", "select e.id, coalesce('Patient/' || m.survivor, e.subject) indexed, coalesce('Patient/' || m.survivor, e.subject) body from encounter e left join merged m on e.subject = 'Patient/' || m.merged")
def promote_references(spark, d):
    """The other types' bodies and indexes refer to survivors."""
    e = rs.encounter(spark, d)
    e = e.withColumn("body_json", F.to_json(F.struct("id", F.struct(F.col("subject").alias("reference")).alias("subject"))))
    rows = promotion.promote_others(e, mpi.merges(_decided(spark, d)))
    own = F.filter("idx", lambda s: s["code"] == "subject")
    return rows.select("id", F.get(own, 0)["value"].alias("indexed"), F.get_json_object("body_json", "$.subject.reference").alias("body"))


@query("merged", "select survivor surviving_fhir_id, merged merged_fhir_id, cast(merged as bigint) % 2 = 0 as is_new, '7' version from merged")
def merge_history(spark, d):
    """Every second merge is in the history already."""
    m = mpi.merges(_decided(spark, d))
    first = cut(promotion.new_merges(m.filter("cast(merged as bigint) % 2 = 1"), None, NOW))
    more = cut(promotion.new_merges(m, first, NOW))
    cols = ["surviving_fhir_id", "merged_fhir_id", F.substring("merge_id", 15, 1).alias("version")]
    return first.select(*cols, F.lit(False).alias("is_new")).unionByName(more.select(*cols, F.lit(True).alias("is_new")))


@query("decision", "select members candidate_ids, decision reason, case when decision = 'multi_match' then 'steward_pick_survivor' else 'verify_distinct' end suggested_action from decision where decision not in ('merge', 'link') and component >= '5'")
def review_queue(spark, d):
    decided = _decided(spark, d)
    old = cut(promotion.new_reviews(decided.filter("component < '5'"), None, NOW))
    return promotion.new_reviews(decided, old, NOW).select("candidate_ids", "reason", "suggested_action")


@query("merged", "select '{\"reference\":\"Patient/' || survivor || '\"}' first, 'Patient/' || merged as second, 1 as version_id, 2 as entries, 'MERGE' code from merged")
def merge_provenance(spark, d):
    rows = promotion.provenance(promotion.new_merges(mpi.merges(_decided(spark, d)), None, NOW), NOW)
    at = lambda p: F.get_json_object("body_json", p)
    return rows.select(at("$.target[0]").alias("first"), at("$.target[1].reference").alias("second"), "version_id", F.size("idx").alias("entries"), at("$.activity.coding[0].code").alias("code"))


@query("decision", "select (select count(*) from patient) bronze_rows, (select count(*) from patient) current_ids, (select count(*) from patient) gold, (select count(*) from patient) silver, count(*) filter (decision = 'merge') merges, count(*) filter (decision not in ('merge', 'link')) reviews from decision")
def promotion_metrics(spark, d):
    decided, bronze = _decided(spark, d), rs.patient(spark, d)
    gold = cut(promotion.promote_patients(bronze, mpi.merges(decided)))
    return promotion.metrics(bronze, gold, promotion.silver(gold, SCHEMAS, "Patient", NOW), decided)


@query("merged patient", "select id silver_id, case when m.merged is null then 'pass' else 'merged' end silver_status, family, gender, mrn from patient p left join merged m on p.id = m.merged")
def silver_rebuild(spark, d):
    """Governance columns and the definition's elements; columns that are null everywhere, such as contact, are gone."""
    rows = promotion.silver(promotion.promote_patients(rs.patient(spark, d), mpi.merges(_decided(spark, d))), SCHEMAS, "Patient", NOW)
    if "contact" in rows.columns:
        raise AssertionError("an empty column is left")
    return rows.select("silver_id", "silver_status", F.get("name", 0)["family"].alias("family"), "gender", F.get("identifier", 0)["value"].alias("mrn"))


@query("patient", "select id, case when cast(id as bigint) % 5 = 0 then 'NEW' else segment end segment from patient union all select 'extra', 'NEW'")
def gold_upsert(spark, d):
    p = rs.patient(spark, d).select("id", "segment")
    t = _table(spark, "gold")
    promotion.write_gold(t, p)
    promotion.write_gold(t, p.filter("cast(id as bigint) % 5 = 0").withColumn("segment", F.lit("NEW")).unionByName(spark.createDataFrame([("extra", "NEW")], "id string, segment string")))
    return t.read()


@query("", "select kind, k - 1 as place from (values ('Patient', 1), ('Encounter', 2), ('Observation', 3), ('Provenance', 4)) t(kind, k)")
def promotion_order(spark, d):
    return spark.createDataFrame([(k, n) for n, k in enumerate(promotion.order(["Provenance", "Observation", "Patient", "Encounter"]))], "kind string, place int")


@query("", "select l_orderkey || '-' || l_linenumber id, l_partkey part, l_returnflag code, case when l_linenumber % 2 = 0 then cast(l_quantity as double) end q, case when l_linenumber % 2 = 1 then l_linestatus end s, case when l_linenumber % 2 = 0 then substr(cast(l_shipdate as varchar), 1, 10) end t from lineitem")
def schema_flatten(spark, d):
    """Columns generated from the definition, choices spread by type."""
    r = flatten(_observations(spark, d).withColumnRenamed("id", "silver_id"), SCHEMAS, "Observation", ("silver_id", "part"))
    return r.select(F.col("silver_id").alias("id"), "part", F.get(F.col("code.coding"), 0)["code"].alias("code"), F.col("valueQuantity.value").alias("q"), F.col("valueString").alias("s"), F.col("effectiveDateTime").alias("t"))


@query("", "select name, kind, many, required from (values ('active', 'scalar', false, false), ('_active', 'json', false, false), ('name', 'struct', true, false), ('gender', 'scalar', false, true), ('_gender', 'json', false, false), ('identifier', 'struct', true, false), ('contact', 'struct', true, false)) t(name, kind, many, required)")
def schema_generation(spark, d):
    return spark.createDataFrame([(f.name, f.kind, f.many, f.required) for f in SCHEMAS.of("Patient")], "name string, kind string, many boolean, required boolean")


def _broken(spark, d):
    """Patients whose documents are damaged by their number."""
    k = F.col("id").cast("bigint") % 8
    good = F.col("body_json")
    put = lambda extra: F.concat(F.lit("{" + extra + ","), F.substring(F.col("body_json"), 2, 1 << 20))
    body = (
        F.when(k == 1, put('"nmae":1')).when(k == 2, put('"active":"yes"')).when(k == 3, put('"contact":{"name":{"family":"x"}}')).when(k == 4, put('"contact":[{"nick":"x"}]'))
        .when(k == 5, F.lit('{"resourceType":"Nothing"}')).when(k == 6, F.lit("[1]")).when(k == 7, F.lit('{"resourceType":"Patient","id":"a b","gender":["x"],"_gender":{}}')).otherwise(good)
    )
    return rs.patient(spark, d).select("id", "gender", body.alias("body_json"))


@query(
    "patient",
    """with k as (select id, cast(id as bigint) % 8 k, case when gender is null then 'required:Patient.gender' end g from patient) select id, case k when 5 then 'unknown-type:Nothing' when 6 then 'object:' when 7 then 'single:Patient.gender' else
 concat_ws(';', case when k = 2 then 'kind:Patient.active' when k = 3 then 'list:Patient.contact' end, case when k = 4 then 'required:Patient.contact[0].name' end, g, case when k = 4 then 'unknown:Patient.contact[0].nick' when k = 1 then 'unknown:Patient.nmae' end) end issues from k""",
)
def structure_check(spark, d):
    """Unknown types and elements at any depth, missing and misplaced ones, and kinds of values; put in order."""
    return _broken(spark, d).select("id", F.array_join(structure.issues(F.col("body_json"), SCHEMAS), ";").alias("issues"))


@query("", "select cast(p_partkey as varchar) id, case p_partkey % 6 when 0 then 'not-an-object' when 1 then 'no-type' when 2 then 'other-type' when 3 then 'bad-id' when 4 then 'not-an-object' end why from part")
def boundary_check(spark, d):
    k = F.col("p_partkey") % 6
    body = F.when(k == 0, "[]").when(k == 1, '{"id":"a"}').when(k == 2, '{"resourceType":"Other","id":"a"}').when(k == 3, '{"resourceType":"Patient","id":7}').when(k == 4, "{broken").otherwise('{"resourceType":"Patient"}')
    return rs._load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), structure.boundary(body, "Patient").alias("why"))


@query("patient", "select id, case when gender is null then 'invariant:has-gender' else '' end issues from patient")
def invariant_check(spark, d):
    """Constraints compiled from FHIRPath; what can't be compiled passes."""
    rules = [{"key": "has-gender", "expression": "gender.exists() or contact.exists()"}, {"key": "name", "expression": "name.where(family.exists()).count() > 0 implies name.family.exists()"}, {"key": "odd", "expression": "name.trace('x').all($this is Base)"}, {"key": "mrn", "expression": "identifier.all(system = 'urn:mrn' and value.exists())"}]
    rows = rs.patient(spark, d).select("id", F.from_json("body_json", SCHEMAS.ddl("Patient")).alias("r"))
    return validate.with_issues(rows, *fhirpath.invariants(rules, SCHEMAS, "Patient", F.col("r"))).select("id", F.array_join("issues", ";").alias("issues"))


@query("brands expansion", "select cast(p_partkey as varchar) id, case when p_brand < 'Brand#2' then 'accepted' when p_partkey % 2 = 0 then 'dead' else 'waiting' end route from part")
def reconcile_pending(spark, d):
    """Waiting documents once more: odd ones against a value set that is still incomplete, even ones against a complete one."""
    part = rs._load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "vs-low1").otherwise("vs-partial").alias("valueset"), F.lit("urn:brand").alias("system"), F.col("p_brand").alias("code"))
    expansion, headers = rs.value_sets(spark, d)
    expansion = expansion.unionByName(expansion.filter("valueset = 'vs-partial'").withColumn("valueset", F.lit("vs-low1")))
    headers = headers.unionByName(spark.createDataFrame([("vs-low1", True)], "valueset string, complete boolean"))
    known = terminology.validate_in_value_set(part.select("valueset", "system", "code").distinct(), expansion, headers)
    outcomes = terminology.fold(part.join(known, ["valueset", "system", "code"]), ["id"])
    routes = zip(structure.reconcile(part, outcomes), ("accepted", "dead", "waiting"))
    a, b, c = [df.select("id", F.lit(r).alias("route")) for df, r in routes]
    return a.unionByName(b).unionByName(c)


def _consents(spark):
    nested = {"status": "active", "provision": {"type": "deny", "period": {"start": "2020"}, "provision": [{"type": "permit", "securityLabel": [{"code": "R"}], "actor": [{"reference": {"reference": "Practitioner/u1"}}]}]}}
    purpose = {"status": "active", "provision": {"type": "permit", "purpose": [{"code": "ETREAT"}]}}
    ended = {"status": "active", "provision": {"type": "permit", "period": {"end": "2021"}, "provision": [{"type": "permit"}]}}
    draft = {"status": "draft", "provision": {"type": "permit"}}
    return spark.createDataFrame([(f"src{k}", json.dumps(x)) for k, x in enumerate((nested, purpose, ended, draft))], "patient string, body_json string")


@query("doclabels", "select id, case when (conf in ('R', 'V') or sens is not null) and not coalesce(source = 'src0' and conf = 'R', false) and not coalesce(source = 'src1', false) then 'deny' else 'permit' end decision from doclabels")
def consent_provisions(spark, d):
    """Nested permits by actor, purpose and period."""
    rows = rs.doc_labels(spark, d)
    labels = F.array_compact(F.array(F.when(F.col("conf") == "R", "R"), F.col("sens")))
    df = rows.select("id", F.col("source").alias("patient"), labels.alias("labels"), security.decision("user", F.col("conf"), F.col("sens")).alias("decision"))
    return security.with_provisions(df, security.provisions(_consents(spark)), "Practitioner/u1", ["u1"], "ETREAT", "2026-01-01").select("id", "decision")


@query("doclabels", "select count(*) total from doclabels where not (conf in ('R', 'V') or sens is not null)")
def visible_total(spark, d):
    rows = rs.doc_labels(spark, d).withColumn("decision", security.decision("user", F.col("conf"), F.col("sens")))
    return security.visible(rows)[1]


@query("encounter", "select subject patient, bool_or(status = 'F') and not bool_or(status = 'P') allowed from encounter where status in ('F', 'P') group by subject")
def payer_opt_in(spark, d):
    consents = rs.encounter(spark, d).select(F.col("subject").alias("patient"), F.when(F.col("status") == "O", "draft").otherwise("active").alias("status"), F.when(F.col("status") == "P", "deny").otherwise("permit").alias("kind"))
    return security.opted_in(consents)


def _package(spark):
    docs = [*DEFINITIONS.values(), definition("Patient", _element("Patient.gender", "code", binding={"strength": "required", "valueSet": "http://cts.example/ValueSet/1|2"})) | {"url": "urn:profile:p", "name": "p", "derivation": "constraint"}, {"resourceType": "ValueSet", "url": "urn:vs:x"}]
    return spark.createDataFrame([(x["resourceType"], x["url"], json.dumps(x)) for x in docs], "type string, url string, body_json string")


@query("", "select valueset from (values ('http://cts.example/ValueSet/1')) t(valueset)")
def bound_value_sets(spark, d):
    """Bound value sets of a package that aren't loaded and whose host is wanted."""
    loaded = spark.createDataFrame([("urn:vs:gender",)], "valueset string")
    return terminology.bound_value_sets(_package(spark), loaded, ["cts.example"])


@query("", "select url, type, name, installed from (values ('urn:profile:p', 'Patient', 'p', true), ('urn:profile:q', null, null, false)) t(url, type, name, installed)")
def installed_profiles(spark, d):
    wanted = spark.createDataFrame([("urn:profile:p",), ("urn:profile:q",)], "url string")
    return terminology.installed(wanted, _package(spark)).join(terminology.profiles(_package(spark)), "url", "left")


@query("brands", "select 'urn:brand' system, '2' loaded, '3' latest, false as current, cast((select count(*) from brands) as bigint) n union all select 'urn:other', null, '1', false, null")
def terminology_update(spark, d):
    """Headers of loaded systems against the versions known from elsewhere."""
    rows, header = terminology.loaded(rs.brands(spark, d), "2")
    latest = spark.createDataFrame([("urn:brand", "3"), ("urn:other", "1")], "system string, version string")
    n = header.select("system", F.col("count").alias("n"))
    return terminology.update_report(header, latest).join(n, "system", "left")


@query("brands", "select system, code, display, (select count(*) from (select * from brands order by code limit 7)) n from brands order by code limit 7")
def terminology_load_limit(spark, d):
    """A load with a limit, which is the feature."""
    rows, header = terminology.loaded(rs.brands(spark, d), "1", 7)
    return rows.join(header.select("system", F.col("count").alias("n")), "system")


@query("brands expansion", "select * from expansion where valueset <> 'vs-low' union all select 'vs-low', 'urn:brand', 'x', 'X'")
def expansion_replace(spark, d):
    new = spark.createDataFrame([("urn:brand", "x", "X")], "system string, code string, display string")
    return terminology.replace_expansion(rs.value_sets(spark, d)[0], "vs-low", new)


@query("", "select 'urn:q:' || n_nationkey || '|1' asked, 'Questionnaire' kind, 'urn:q:' || n_nationkey url from nation where n_nationkey < 20 union all select 'urn:q:' || n_nationkey || '|1', 'Library', 'urn:lib:' || (n_nationkey % 3) from nation where n_nationkey < 20 and n_nationkey % 3 < 2 union all select 'urn:q:' || n_nationkey || '|1', 'ValueSet', 'urn:vs:' || n_regionkey from nation where n_nationkey < 20")
def questionnaire_package(spark, d):
    """Questionnaires with a library and a value set two items deep; some libraries, and five questionnaires, aren't stored."""
    k = F.col("n_nationkey").cast("string")
    item = F.array(F.struct(F.array(F.struct(F.concat(F.lit("urn:vs:"), F.col("n_regionkey").cast("string"), F.lit("|3")).alias("answerValueSet"))).alias("item")))
    ext = F.array(F.struct(F.lit("http://hl7.org/fhir/StructureDefinition/cqf-library").alias("url"), F.concat(F.lit("urn:lib:"), (F.col("n_nationkey") % 3).cast("string")).alias("valueCanonical")))
    nation = rs._load(spark, d, "nation")
    forms = nation.filter("n_nationkey < 20").select(F.concat(F.lit("urn:q:"), k).alias("url"), F.to_json(F.struct(ext.alias("extension"), item.alias("item"))).alias("body_json"))
    asked = nation.select(F.concat(F.lit("urn:q:"), k, F.lit("|1")).alias("asked"))
    libraries = spark.createDataFrame([("urn:lib:0",), ("urn:lib:1",)], "url string")
    values = rs._load(spark, d, "region").select(F.concat(F.lit("urn:vs:"), F.col("r_regionkey").cast("string")).alias("url"))
    return terminology.questionnaire_package(asked, forms, libraries, values)


@query("patient", "select 'Patient' as type, count(*) n from patient union all select 'Patient0', count(*) from patient where mrn like 'P%'")
def export_manifest(spark, d):
    path = f"{_table(spark, 'export').path}-{uuid.uuid4().hex}"
    p = rs.patient(spark, d)
    loaders.export({"Patient": p, "Patient0": p.filter(F.col("mrn").startswith("P")), "None": p.filter("false")}, path, "$export", NOW)
    return loaders.manifest(spark, path).select("type", "n")


@query("patient encounter", """select 'Patient' as type, count(*) n from patient where mrn like 'P%' and cast(id as bigint) % 3 <> 0 and last_updated >= '2026-01-01T00:00:20Z' union all
 select 'Encounter', count(*) from encounter where d >= '2026-01-01T00:00:20Z' and subject in (select 'Patient/' || id from patient where mrn like 'P%')""")
def export_group(spark, d):
    """A group's export since a time, without the members who opted out."""
    p = rs.patient(spark, d)
    group, out = p.filter(F.col("mrn").startswith("P")), p.filter("cast(id as bigint) % 3 = 0")
    tables = {"Patient": (p, []), "Encounter": (rs.encounter(spark, d), ["subject"]), "Observation": (rs.observation(spark, d), ["encounter"])}
    got = graph.export(tables, ["Patient", "Encounter"], "2026-01-01T00:00:20Z", group, out)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("type"), "n") for k, df in got.items()])


@query("decision", "select (select count(*) from patient) gold, (select count(*) from patient) - count(*) filter (decision = 'merge') current, count(*) filter (decision = 'merge') merged, (select count(*) from patient) bronze_rows, count(*) filter (decision = 'merge') merges from decision")
def promote_patients(spark, d):
    """The whole of a promotion: Bronze read, merges applied, Gold upserted and Silver rebuilt."""
    bronze, gold, silver = (_table(spark, f"promote-{t}") for t in ("bronze", "gold", "silver"))
    bronze.overwrite(rs.patient(spark, d))
    m = promotion.promote("Patient", bronze, gold, silver, SCHEMAS, NOW, _decided(spark, d))
    g = gold.read().agg(F.count("*").alias("gold"), F.count_if(F.col("is_current")).alias("current"))
    s = silver.read().agg(F.count_if(F.col("silver_status") == "merged").alias("merged"))
    return g.crossJoin(s).crossJoin(m.select("bronze_rows", "merges"))  # one row each


@query("patient", "select id, case when cast(id as bigint) % 2 = 0 and gender is null then 'required:gender' else '' end issues from patient")
def declared_profiles(spark, d):
    """Profiles apply to documents that name them."""
    rules = definition("Patient", _element("Patient.gender", "code", least=1)) | {"url": "urn:profile"}
    named = F.concat(F.lit('{"meta":{"profile":["'), F.when(F.col("id").cast("bigint") % 2 == 0, "urn:profile|1").otherwise("urn:other"), F.lit('"]},'), F.substring("body_json", 2, 1 << 20))
    return rs.patient(spark, d).select("id", F.array_join(profile.profile_issues(named, [rules], declared=True), ";").alias("issues"))
