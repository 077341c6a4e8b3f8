"""One query for each operator over the derived resources, with the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlattice.operators import audit, bundle, graph, history, mpi, profile, promotion, search, security, terminology, validate
from medlattice.operators import capabilities as caps
from medlattice.operators.lineage import cut
from medlattice.plans import resources as rs
from medlattice.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Derived resources in SQL, put in front of an oracle where it names them.
CTES = {
    "patient": """patient as (select cast(c_custkey as varchar) id, lower(c_name) family, case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then 'male' when c_custkey % 3 = 1 then 'female' else 'unknown' end gender,
 case when c_custkey % 20 in (0,1) then concat('P', cast(cast(floor(c_custkey / 20) as bigint) as varchar)) when c_custkey % 20 in (2,3,4) then concat('T', cast(cast(floor(c_custkey / 20) as bigint) as varchar)) else concat('S', cast(c_custkey as varchar)) end mrn,
 c_name as name, c_mktsegment segment, c_acctbal balance, concat('2026-01-01T00:00:', lpad(cast(c_custkey % 60 as varchar), 2, '0'), 'Z') last_updated from customer)""",
    "encounter": "encounter as (select cast(o_orderkey as varchar) id, o_orderstatus status, substr(cast(o_orderdate as varchar),1,10) d, concat('Patient/', cast(o_custkey as varchar)) subject, o_orderpriority cls from orders)",
    "obsv": """obsv as (select concat(cast(l_orderkey as varchar),'-',cast(l_linenumber as varchar)) id, row_number() over (partition by l_orderkey,l_linenumber order by l_shipdate,l_partkey,l_suppkey,l_extendedprice) version_id,
 l_returnflag code, cast(l_quantity as bigint) q, substr(cast(l_shipdate as varchar),1,10) d, concat('Organization/', cast(l_suppkey as varchar)) performer, concat('Encounter/', cast(l_orderkey as varchar)) encounter from lineitem)""",
    "obs": "obs as (select * from (select *, max(version_id) over (partition by id) top from obsv) where version_id = top)",
    "versions": "versions as (select cast(user_id as varchar) id, row_number() over (partition by user_id order by ts, event_id) version_id, event_type = 'error' deleted, strftime(ts, '%Y-%m-%d %H:%M:%S') last_updated, event_type from events)",
    "doclabels": "doclabels as (select cast(d.doc_id as varchar) id, source, case when l.toxic = 1 then 'R' else 'N' end conf, case when l.quality = 0 then 'PSY' end sens from documents d left join labels l on d.doc_id = l.doc_id)",
    "brands": "brands as (select distinct 'urn:brand' system, p_brand code, concat('Brand ', p_brand) display from part)",
    "expansion": "expansion as (select 'vs-all' valueset, * from brands union all select 'vs-low', * from brands where code < 'Brand#3' union all select 'vs-partial', * from brands where code < 'Brand#2')",
    "comps": "comps as (select id, min(id) over (partition by mrn) component from patient)",
    "decided": """decided as (select component, string_agg(p.id, ',' order by p.id) members, count(*) n, min(p.id) a, max(p.id) b from comps join patient p using (id) group by component)""",
    "decision": """decision as (select d.component, members, n, case when n = 1 then 'link' when n > 2 then 'multi_match' when coalesce(x.gender,'unknown') <> coalesce(y.gender,'unknown') and coalesce(x.gender,'unknown') <> 'unknown' and coalesce(y.gender,'unknown') <> 'unknown' then 'sex_mismatch' else 'merge' end decision,
 case when n = 1 then a when n = 2 and not (coalesce(x.gender,'unknown') <> coalesce(y.gender,'unknown') and coalesce(x.gender,'unknown') <> 'unknown' and coalesce(y.gender,'unknown') <> 'unknown') then case when y.last_updated > x.last_updated then b else a end end survivor
 from decided d join patient x on x.id = a join patient y on y.id = b)""",
    "merged": "merged as (select case when survivor = split_part(members, ',', 1) then split_part(members, ',', 2) else split_part(members, ',', 1) end merged, survivor from decision where decision = 'merge')",
}
_NEEDS = {"obs": ["obsv"], "expansion": ["brands"], "comps": ["patient"], "decided": ["comps", "patient"], "decision": ["decided", "comps", "patient"], "merged": ["decision", "decided", "comps", "patient"]}


def _sql(names: str, body: str) -> str:
    wanted = set(names.split())
    for n in list(wanted):
        wanted |= set(_NEEDS.get(n, []))
    named = "with recursive " + ",\n".join(v for k, v in CTES.items() if k in wanted) if wanted else ""
    own = body.lstrip()
    if named and own.startswith("with "):  # its own tables follow the derived ones
        return named + ",\n" + own.removeprefix("with ").removeprefix("recursive ")
    return (named + "\n" if named else "") + body


def query(names: str = "", sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _sql(names, sql)
        return f

    return register


def _search(name: str, kind: str, text: str, columns: list[str], names: str, sql: str) -> None:
    """A query that searches a derived resource by a query string."""

    def f(spark, d, kind=kind, text=text, columns=columns):
        df = {"Patient": rs.patient, "Encounter": rs.encounter, "Observation": rs.observation, "Organization": rs.organization}[kind](spark, d)
        return search.search(df, kind, text, paged="_sort" in text or "_count" in text).select(*columns)

    f.__name__ = name
    query(names, sql)(f)


E_ = ["id", "status", "d"]
_search("search_token_status", "Encounter", "status=F&_sort=-date&_count=50&_offset=50", E_, "encounter", "select id, status, d from encounter where status = 'F' order by d desc, id desc limit 50 offset 50")
_search("search_token_or", "Encounter", "status=F,P", ["id", "status"], "encounter", "select id, status from encounter where status in ('F', 'P')")
_search("search_token_system", "Encounter", "status=urn:status|O", ["id", "status"], "encounter", "select id, status from encounter where status = 'O'")
_search("search_token_not", "Patient", "gender:not=male", ["id", "gender"], "patient", "select id, gender from patient where gender is null or gender <> 'male'")
_search("search_missing", "Patient", "gender:missing=true", ["id"], "patient", "select id from patient where gender is null")
_search("search_present", "Patient", "gender:missing=false", ["id"], "patient", "select id from patient where gender is not null")
_search("search_string_prefix", "Patient", "family=CUSTOMER%230000001", ["id", "family"], "patient", "select id, family from patient where starts_with(family, 'customer#0000001')")
_search("search_string_contains", "Patient", "family:contains=00%5F12", ["id", "family"], "patient", "select id, family from patient where contains(family, '0012')")
_search("search_string_exact", "Patient", "family:exact=Customer%23000000007", ["id", "family"], "patient", "select id, family from patient where family = 'customer#000000007'")
_search("search_date_range", "Encounter", "status=F&date=ge1995-01-01&date=le1997-12-31", E_, "encounter", "select id, status, d from encounter where status = 'F' and d >= '1995-01-01' and d <= '1997-12-31'")
_search("search_date_prefix", "Encounter", "date=1996-03", E_, "encounter", "select id, status, d from encounter where starts_with(d, '1996-03')")
_search("search_date_after", "Encounter", "date=sa2001-05-31", E_, "encounter", "select id, status, d from encounter where d > '2001-05-31'")
_search("search_quantity_gt", "Observation", "value-quantity=gt40&code=R", ["id", "q"], "obs", "select id, q from obs where q > 40 and code = 'R'")
_search("search_quantity_system", "Observation", "value-quantity=le5|urn:unit", ["id", "q"], "obs", "select id, q from obs where q <= 5")
_search("search_number_lt", "Patient", "balance=lt0", ["id", "balance"], "patient", "select id, balance from patient where balance < 0")
_search("search_reference_full", "Encounter", "subject=Patient/7", ["id", "subject"], "encounter", "select id, subject from encounter where subject = 'Patient/7'")
_search("search_reference_bare", "Encounter", "subject=12", ["id", "subject"], "encounter", "select id, subject from encounter where subject = '12' or ends_with(subject, '/12')")
_search("search_last_updated", "Patient", "_lastUpdated=ge2026-01-01T00:00:50Z&_lastUpdated=lt2026-01-01T00:00:55Z", ["id", "last_updated"], "patient", "select id, last_updated from patient where last_updated >= '2026-01-01T00:00:50Z' and last_updated < '2026-01-01T00:00:55Z'")
_search("search_repeated_param", "Encounter", "date=ge1996-01-01&date=lt1996-02-01&class=1-URGENT&status:not=F", ["id", "d"], "encounter", "select id, d from encounter where d >= '1996-01-01' and d < '1996-02-01' and cls = '1-URGENT' and status <> 'F'")
_search("search_sort_numeric_page", "Observation", "code=A&_sort=-value-quantity&_count=100&_offset=20", ["id", "q"], "obs", "select id, q from obs where code = 'A' order by q desc nulls last, id desc limit 100 offset 20")
_search("search_sort_missing_last", "Patient", "_sort=gender&_count=1000", ["id", "gender"], "patient", "select id, gender from patient order by gender nulls last, id limit 1000")
_search("search_injection_safe", "Patient", "family=x'%20OR%20'1'='1", ["id"], "patient", "select id from patient where starts_with(family, 'x'' or ''1''=''1')")


@query("encounter", "select count(*) total from encounter where status = 'F'")
def search_total(spark, d):
    return search.total(rs.encounter(spark, d), "Encounter", "status=F")


@query("patient", "select id, mrn from patient where id in ('3', '5', '8', '13') or false")
def search_id_in(spark, d):
    ids = search.Condition("_id", "_id", ["3", "5", "8", "13"])
    return search.matching(search.current(rs.patient(spark, d)), [ids]).select("id", "mrn")


@query("patient", "select id, mrn from patient where mrn = 'P3'")
def identifier_search(spark, d):
    return search.current(rs.patient(spark, d)).filter(F.exists("identifiers", lambda i: (i["system"] == "urn:mrn") & (i["value"] == "P3"))).select("id", "mrn")


@query("patient encounter", "select e.id, e.subject from encounter e where exists (select 1 from patient p where e.subject = concat('Patient/', p.id) and p.segment = 'BUILDING')")
def chain_subject_segment(spark, d):
    return graph.chained(rs.encounter(spark, d), "subject", rs.patient(spark, d), "Patient", "segment=BUILDING").select("id", "subject")


@query("patient encounter", "select id from patient where concat('Patient/', id) in (select subject from encounter where status = 'P')")
def has_encounter_status(spark, d):
    return graph.has(rs.patient(spark, d), "Patient", rs.encounter(spark, d), "Encounter", "subject", "status=P").select("id")


@query("patient encounter", "select id, family from patient where concat('Patient/', id) in (select subject from encounter where status = 'F' and starts_with(d, '1997-01'))")
def include_patient(spark, d):
    found = search.search(rs.encounter(spark, d), "Encounter", "status=F&date=1997-01", paged=False)
    return graph.include(found, "subject", rs.patient(spark, d), "Patient").select("id", "family")


@query(
    "patient encounter obs",
    """select 'Encounter' type, id from encounter where concat('Encounter/', id) in (select encounter from obs where q = 50 and starts_with(d, '1998-0')) union
 select 'Patient', id from patient where concat('Patient/', id) in (select subject from encounter where concat('Encounter/', id) in (select encounter from obs where q = 50 and starts_with(d, '1998-0')))""",
)
def include_iterate(spark, d):
    tables = {"Encounter": rs.encounter(spark, d), "Patient": rs.patient(spark, d)}
    found = search.search(rs.observation(spark, d), "Observation", "value-quantity=50&date=1998-0", paged=False)
    return graph.include_iterate(found, [("Observation", "encounter", "Encounter"), ("Encounter", "subject", "Patient")], tables, "Observation")


@query("encounter obs", "select id, encounter from obs where encounter in (select concat('Encounter/', id) from encounter where status = 'P' and starts_with(d, '1995-0'))")
def revinclude(spark, d):
    found = search.search(rs.encounter(spark, d), "Encounter", "status=P&date=1995-0", paged=False)
    return graph.revinclude(found, "Encounter", rs.observation(spark, d), "encounter").select("id", "encounter")


@query("patient encounter", "select id, subject from encounter where subject in (select concat('Patient/', id) from patient where mrn like 'T1%')")
def compartment_members(spark, d):
    group = rs.patient(spark, d).filter(F.col("mrn").startswith("T1"))
    return graph.compartment(rs.encounter(spark, d), ["subject"], group).select("id", "subject")


@query("patient encounter", "select 'Patient' type, id, last_updated from patient where id = '7' union all select 'Encounter', id, d from encounter where subject = 'Patient/7' order by concat(type, '/', id) limit 10 offset 2")
def everything_page(spark, d):
    return graph.everything(rs.patient(spark, d), {"Encounter": (rs.encounter(spark, d), ["subject"])}, "7", count=10, offset=2)


@query("versions", "select id, version_id, deleted from (select *, row_number() over (partition by id order by version_id desc) k from versions) where k = 1")
def current_version(spark, d):
    return history.newest(rs.versions(spark, d)).select("id", "version_id", "deleted")


@query("versions", "select id, version_id, version_id = max(version_id) over (partition by id) is_current from versions")
def migrate_is_current(spark, d):
    return history.mark_current(rs.versions(spark, d)).select("id", "version_id", "is_current")


@query("versions", "select id, version_id, case when deleted then 'gone' else 'ok' end status from versions where version_id in (1, 2, 3)")
def vread(spark, d):
    v = rs.versions(spark, d)
    return history.vread(v, v.filter("version_id <= 3").select("id", "version_id"))


@query("versions", "select w.id, v.version_id, case when v.id is null then 'not-found' when v.deleted then 'gone' else 'ok' end status from (select distinct id from versions union all select 'none') w left join (select * from versions qualify row_number() over (partition by id order by version_id desc) = 1) v on w.id = v.id")
def point_read_gone(spark, d):
    v = rs.versions(spark, d)
    wanted = v.select("id").distinct().unionByName(spark.createDataFrame([("none",)], "id string"))
    return history.point_read(v, wanted)


@query("versions", "select id, version_id, deleted, last_updated from versions where id = '17'")
def history_instance(spark, d):
    return history.instance_history(rs.versions(spark, d), "17").select("id", "version_id", "deleted", "last_updated")


@query("versions", "select id, version_id, last_updated from versions order by last_updated desc, version_id desc, id desc limit 100 offset 10")
def history_type(spark, d):
    return history.type_history(rs.versions(spark, d), 100, 10).select("id", "version_id", "last_updated")


@query("versions obsv", "select 'Event' type, id, version_id, last_updated, deleted from versions union all select 'Observation', id, version_id, d, false from obsv order by last_updated desc, id desc, type desc, version_id desc limit 200")
def history_system(spark, d):
    return history.system_history({"Event": rs.versions(spark, d), "Observation": rs.observation_versions(spark, d)}, 200)


@query("versions", "select id, version_id, deleted, version_id = max(version_id) over (partition by id) is_current from (select id, version_id, deleted from versions union all select id, max(version_id) + 1, true from versions where id < '2' group by id)")
def write_versions(spark, d):
    v = rs.versions(spark, d).select("id", "version_id", "deleted", "last_updated")
    new, _ = history.ingest(v, v.filter("id < '2'").groupBy("id").agg(F.lit(True).alias("deleted"), F.lit("2026").alias("last_updated")))
    return history.write_versions(v.withColumn("is_current", F.lit(False)), new.select("id", "version_id", "deleted", "last_updated", F.lit(False).alias("is_current"))).select("id", "version_id", "deleted", "is_current")


def _table(spark, name: str) -> store.Table:
    import uuid

    from medlattice.operators.lineage import cut

    if not spark.sparkContext.getCheckpointDir():
        cut(spark.range(1))
    return store.Table(spark, f"{spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}")


@query("patient", "select id, case when cast(id as bigint) % 10 = 0 then 'NEW' else segment end segment from patient union all select concat('n', id), 'NEW' from patient where cast(id as bigint) % 100 = 1")
def merge_upsert(spark, d):
    p = rs.patient(spark, d).select("id", "segment")
    t = _table(spark, "upsert")
    t.overwrite(p)
    new = p.filter("cast(id as bigint) % 10 = 0").select("id", F.lit("NEW").alias("segment")).unionByName(p.filter("cast(id as bigint) % 100 = 1").select(F.concat(F.lit("n"), "id").alias("id"), F.lit("NEW").alias("segment")))
    t.upsert(new)
    return t.read()


@query("patient", "select id, gender from patient where gender is null or gender <> 'male'")
def delete_predicate(spark, d):
    t = _table(spark, "delete")
    t.overwrite(rs.patient(spark, d).select("id", "gender"))
    t.delete(F.col("gender") == "male")
    t.compact("id", 2)
    return t.read()


@query("brands expansion", "with vs as (select unnest(['vs-all','vs-low','vs-partial','vs-none']) valueset), c as (select distinct valueset, p_brand code from part, vs union all select valueset, 'Brand#99' from vs) select c.valueset, c.code, case when exists (select 1 from expansion e where e.valueset = c.valueset and e.code = c.code) then 'valid' when c.valueset in ('vs-none', 'vs-partial') then 'unknown' else 'invalid' end result from c".replace("with vs", "select * from (with vs", 1) + ")")
def vs_validate_code(spark, d):
    expansion, headers = rs.value_sets(spark, d)
    codes = rs.brands(spark, d).select("code").unionByName(spark.createDataFrame([("Brand#99",)], "code string"))
    asked = codes.select(F.explode(F.array(*[F.lit(v) for v in ("vs-all", "vs-low", "vs-partial", "vs-none")])).alias("valueset"), F.lit("urn:brand").alias("system"), "code")
    return terminology.validate_in_value_set(asked, expansion, headers).select("valueset", "code", "result")


@query("brands", "select 'urn:brand' system, code, 'valid' result from brands union all select 'urn:brand', 'x', 'invalid' union all select 'urn:other', 'x', 'unknown'")
def cs_validate_code(spark, d):
    b = rs.brands(spark, d)
    asked = b.select("system", "code").unionByName(spark.createDataFrame([("urn:brand", "x"), ("urn:other", "x")], "system string, code string"))
    return terminology.validate_in_system(asked, b)


@query("brands expansion", "select system, code, display from expansion where valueset = 'vs-all' and contains(lower(code), '#2') order by system, code limit 3 offset 1")
def vs_expand_page(spark, d):
    return terminology.expand_page(rs.value_sets(spark, d)[0], "vs-all", "#2", 3, 1).select("system", "code", "display")


@query("brands", "select system, code, display from brands where code = 'Brand#21'")
def cs_lookup(spark, d):
    return terminology.lookup(rs.brands(spark, d), "urn:brand", "Brand#21")


@query("brands", "select system, count(*) concepts from brands group by system")
def concept_counts(spark, d):
    return terminology.concept_counts(rs.brands(spark, d))


@query("", "select cast(p_partkey as varchar) id, case when p_brand < 'Brand#3' then 'ok' else 'invalid' end outcome from part")
def binding_check(spark, d):
    expansion, headers = rs.value_sets(spark, d)
    part = rs._load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("code"))
    codes = part.select("code").distinct().select(F.lit("vs-low").alias("valueset"), F.lit("urn:brand").alias("system"), "code")
    known = terminology.validate_in_value_set(codes, expansion, headers)
    return terminology.fold(part.join(known.select("code", "result"), "code"), ["id"])


@query("brands", "select 'vs-new' valueset, 'urn:brand' system, code from brands union all select 'vs-new', 'urn:extra', 'a'")
def vs_expand(spark, d):
    includes = spark.createDataFrame([("vs-new", "urn:brand", [], False, False, False), ("vs-new", "urn:extra", ["a"], False, False, False)], "valueset string, system string, codes array<string>, filtered boolean, imports boolean, excluded boolean")
    return terminology.expand_value_sets(includes, rs.brands(spark, d))[0]


@query("patient", "select a.id u, b.id v from patient a join (select mrn, min(id) id from patient group by mrn) b on a.mrn = b.mrn and a.id <> b.id")
def mpi_pairs(spark, d):
    return mpi.links(mpi.identifier_keys(rs.people(spark, d)))


def _decided(spark, d):
    """Decisions, written once: several operators join them."""
    p = cut(rs.people(spark, d))
    return cut(mpi.decisions(p, mpi.components(p, mpi.links(mpi.identifier_keys(p)))))


@query("comps", "select id, component from comps")
def mpi_components(spark, d):
    p = rs.people(spark, d)
    return mpi.components(p, mpi.links(mpi.identifier_keys(p)))


@query("decision", "select component, members, n, decision, survivor from decision where decision = 'merge'")
def mpi_merges(spark, d):
    return _decided(spark, d).filter("decision = 'merge'")


@query("decision", "select component, members, n, decision from decision where decision not in ('merge', 'link')")
def mpi_reviews(spark, d):
    return _decided(spark, d).filter("decision not in ('merge', 'link')").drop("survivor")


@query("decision", """with k as (select distinct mrn, d.component, d.decision, d.survivor from decision d join patient p on list_contains(string_split(d.members, ','), p.id))
 select 'urn:mrn' identifier_system, k.mrn identifier_value, case when decision = 'merge' then survivor else (select min(id) from patient q where q.mrn = k.mrn) end fhir_id, 'deterministic_rule:shared-identifier' decision_path from k union all
 select 'urn:cust', name, case when d.decision = 'merge' then survivor else p.id end, 'deterministic_rule:shared-identifier' from decision d join patient p on list_contains(string_split(d.members, ','), p.id)""")
def patient_link(spark, d):
    return promotion.patient_links(rs.people(spark, d), _decided(spark, d))


@query("patient", "select cast(c_custkey as varchar) merged, cast(((c_custkey - 1) // 8) * 8 + 8 as varchar) survivor from customer where c_custkey % 8 <> 0 and ((c_custkey - 1) // 8) * 8 + 8 <= (select max(c_custkey) from customer)")
def survivor_chain(spark, d):
    k = F.col("c_custkey")
    c = rs._load(spark, d, "customer")
    top = (F.floor((k - 1) / 8) * 8 + 8).cast("bigint")
    chain = c.join(c.agg(F.max("c_custkey").alias("most")), top <= F.col("most")).filter(k % 8 != 0)
    return mpi.terminal(chain.select(k.cast("string").alias("merged"), (k + 1).cast("string").alias("survivor")))


@query("merged encounter", "select e.id, coalesce('Patient/' || m.survivor, e.subject) subject from encounter e left join merged m on e.subject = concat('Patient/', m.merged)")
def rewrite_refs(spark, d):
    return mpi.rewrite_references(rs.encounter(spark, d).select("id", "subject"), "subject", mpi.merges(_decided(spark, d)))


@query("merged encounter", "select e.id, '{\"id\":\"' || e.id || '\",\"subject\":{\"reference\":\"' || coalesce('Patient/' || m.survivor, e.subject) || '\"}}' body_json from encounter e left join merged m on e.subject = 'Patient/' || m.merged")
def rewrite_json_body(spark, d):
    e = rs.encounter(spark, d).select("id", F.to_json(F.struct("id", F.struct(F.col("subject").alias("reference")).alias("subject"))).alias("body_json"))
    return mpi.rewrite_bodies(e, mpi.merges(_decided(spark, d)))


@query("patient", "select id, family, gender, mrn from patient")
def silver_flatten(spark, d):
    schema = "resourceType string, id string, name array<struct<family:string>>, gender string, identifier array<struct<system:string,value:string>>"
    r = rs.patient(spark, d).select(F.from_json("body_json", schema).alias("r"))
    return r.select("r.id", F.col("r.name")[0]["family"].alias("family"), "r.gender", F.col("r.identifier")[0]["value"].alias("mrn"))


@query("merged patient", "select id, m.merged is null is_current from patient p left join merged m on p.id = m.merged")
def gold_current(spark, d):
    return promotion.promote_patients(rs.patient(spark, d), mpi.merges(_decided(spark, d))).select("id", "is_current")


@query("encounter", "select id, case when status = 'P' or id like '%7' then 'dead-letter' when cls = '1-URGENT' then 'pending' else 'accepted' end route from encounter")
def validate_split(spark, d):
    e = validate.with_issues(rs.encounter(spark, d), validate.required("status"), validate.well_formed("d", "date"), validate.invariant("p", F.col("status") != "P"), validate.invariant("seven", ~F.col("id").endswith("7")))
    return validate.routed(e, F.col("cls") == "1-URGENT").select("id", "route")


@query("patient", "select id, gender is null failed from patient")
def required_check(spark, d):
    return validate.with_issues(rs.patient(spark, d), validate.required("gender")).select("id", (F.size("issues") > 0).alias("failed"))


@query("patient", r"select id, regexp_matches(name, '^[A-Za-z0-9\-.]{1,64}$') name_ok, regexp_matches(segment, '^[^\s]+(\s[^\s]+)*$') segment_ok from patient")
def format_check(spark, d):
    return rs.patient(spark, d).select("id", validate.format_ok(F.col("name"), "id").alias("name_ok"), validate.format_ok(F.col("segment"), "code").alias("segment_ok"))


@query("", "select cast(l_orderkey as varchar) id, count(*) filter (l_returnflag = 'R') returned from lineitem group by l_orderkey having count(*) filter (l_returnflag = 'R') < 1 or count(*) filter (l_returnflag = 'R') >= 2")
def slice_cardinality(spark, d):
    items = rs._load(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("code"))).alias("items"))
    return items.select("id", validate.slice_count(F.col("items"), "code", "R").cast("bigint").alias("returned")).filter("returned < 1 or returned >= 2")


@query("doclabels", "select id, case when conf in ('R', 'V') or sens is not null then 'deny' else 'permit' end decision from doclabels")
def sensitivity_user(spark, d):
    return rs.doc_labels(spark, d).select("id", security.decision("user", F.col("conf"), F.col("sens")).alias("decision"))


@query("doclabels", "select id, case when (conf in ('R', 'V') or sens is not null) and not (coalesce(source = 'src1' and conf = 'R', false) or coalesce(source = 'src2', false)) then 'deny' else 'permit' end decision from doclabels")
def consent_filter(spark, d):
    label = F.when(F.col("conf") == "R", "R").otherwise(F.col("sens"))
    rows = rs.doc_labels(spark, d).select("id", F.col("source").alias("patient"), label.alias("label"), security.decision("user", F.col("conf"), F.col("sens")).alias("decision"))
    consents = spark.createDataFrame([("src1", "active", "permit", "R", None, None), ("src2", "active", "permit", None, "2020", "2099"), ("src3", "active", "permit", None, None, "2001"), ("src4", "inactive", "permit", None, None, None)], "patient string, status string, kind string, label string, start string, end string")
    return security.with_consent(rows, consents, "2026-01-01").select("id", "decision")


@query("patient encounter", "select id from patient where concat('Patient/', id) not in (select subject from encounter where status = 'P')")
def provider_opt_out(spark, d):
    denies = rs.encounter(spark, d).filter("status = 'P'").select(F.regexp_replace("subject", "^Patient/", "").alias("patient"), F.lit("active").alias("status"), F.lit("deny").alias("kind"))
    return security.without_opt_out(rs.patient(spark, d), denies).select("id")


@query("encounter", "select id, status from encounter where subject = 'Patient/7' and status in ('F', 'O')")
def scope_filter(spark, d):
    allowed = security.scope_filter(["patient/Encounter.rs?status=F", "patient/Encounter.rs?status=O"], "Encounter", "s", "7", ["subject"])
    return search.current(rs.encounter(spark, d)).filter(allowed).select("id", "status")


@query(
    "doclabels",
    """select id, case when sens is null then '{"id":"' || id || '","meta":{"security":[{}]},"note":{"extension":[{"valueCoding":{}}]}}'
 else '{"id":"' || id || '","meta":{"security":[{"code":"PSY"},{"system":"http://terminology.hl7.org/CodeSystem/v3-ObservationValue","code":"REDACTED"}]},"_note":{"extension":[{"url":"http://hl7.org/fhir/StructureDefinition/data-absent-reason","valueCode":"masked"}]}}' end body_json from doclabels""",
)
def redact_inline(spark, d):
    body = F.to_json(F.struct("id", F.struct(F.array(F.struct(F.col("sens").alias("code"))).alias("security")).alias("meta"), F.struct(F.array(F.struct(F.struct(F.col("sens").alias("code")).alias("valueCoding"))).alias("extension")).alias("note")))
    return security.redact(rs.doc_labels(spark, d).select("id", body.alias("body_json")), ["PSY"])


_AUDIT = """with recursive e as (select user_id || '/' || strftime(ts, '%Y-%m-%d') chain, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, cast(event_id as varchar)) k, event_id, user_id, cast(event_id as varchar) id, strftime(ts, '%Y-%m-%d %H:%M:%S') recorded, 'id=' || event_id || chr(10) || 'recorded=' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'action=R' || chr(10) || 'outcome=0' || chr(10) || 'subtype=' || event_type || chr(10) || 'agent_who=user/' || user_id || chr(10) || 'entity_ref=' || chr(10) || 'patient=' || (user_id % 10) || chr(10) || 'body_json=' || coalesce(props, '') body from events),
c as (select chain, k, id, event_id, user_id, sha256(chr(10) || body) hash, '' prev from e where k = 1 union all select e.chain, e.k, e.id, e.event_id, e.user_id, sha256(c.hash || chr(10) || e.body), c.hash from c join e on e.chain = c.chain and e.k = c.k + 1),
t as (select *, case when event_id % 101 = 100 then repeat('0', 64) else prev end link from c),
f as (select * from t where not exists (select 1 from t x where x.chain = t.chain and x.link = t.hash))
"""


def _audit(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _AUDIT + sql
        return f

    return register


@_audit("select chain, id, 'content' problem from t where event_id % 60 = 59 or event_id % 101 = 100 union all select chain, id, 'missing-predecessor' from t where event_id % 101 = 100 union all select chain, '', 'no-start' from t where k = 1 and event_id % 101 = 100")
def audit_verify(spark, d):
    return audit.verify(cut(rs.audit_log(spark, d)))


@_audit("select chain, count(*) n, (select min(hash) from f where f.chain = t.chain) tip from t group by chain")
def audit_anchor(spark, d):
    return audit.anchor(cut(rs.audit_log(spark, d)))


@_audit("select chain, id, k - 1 as position from c")
def audit_positions(spark, d):
    return audit.positions(cut(rs.audit_log(spark, d, damaged=False)))


@_audit("select chain, case user_id % 3 when 0 then 'truncated' when 1 then 'rewritten' else 'ok' end state from c where k = 1")
def audit_anchor_check(spark, d):
    """Anchors checked after the last records of a third of the users have gone, and those of another third have been written anew."""
    log = cut(rs.audit_log(spark, d, damaged=False))
    anchors = cut(audit.anchor(log))
    last = log.join(anchors.select("chain", F.col("tip").alias("hash"), F.lit(True).alias("last")), ["chain", "hash"], "left")
    user = F.substring_index("chain", "/", 1).cast("bigint") % 3
    now = last.filter(~F.coalesce(F.col("last") & (user == 0), F.lit(False))).withColumn("hash", F.when(F.col("last") & (user == 1), F.sha2("hash", 256)).otherwise(F.col("hash")))
    return audit.check_anchors(now, anchors)


@query("", "select cast(event_id as varchar) id, strftime(ts, '%Y-%m-%d %H:%M:%S') recorded from events where user_id % 10 = 3")
def disclosure_accounting(spark, d):
    return audit.accounting(rs.audit_log(spark, d), "3").select("id", "recorded")


@query("patient encounter", "select 'Encounter' type, count(*) n from encounter where subject in (select concat('Patient/', id) from patient where mrn like 'P%') union all select 'Patient', count(*) from patient where mrn like 'P%'")
def export_counts(spark, d):
    group = rs.patient(spark, d).filter(F.col("mrn").startswith("P"))
    e = graph.compartment(rs.encounter(spark, d), ["subject"], group).select(F.lit("Encounter").alias("type"))
    return e.unionByName(group.select(F.lit("Patient").alias("type"))).groupBy("type").agg(F.count("*").alias("n"))


@query("patient", """select '{"resourceType":"Patient","id":"' || id || '","name":[{"family":"' || family || '"}],' || coalesce('"gender":"' || gender || '",', '') || '"identifier":[{"system":"urn:mrn","value":"' || mrn || '"}]}' as value from patient""")
def ndjson_export(spark, d):
    from medlattice.sources.loaders import ndjson

    path = _table(spark, "export").path
    ndjson(rs.patient(spark, d), path)
    return spark.read.text(path)


@query("patient", """with a as (select id asked, mrn, family, balance, gender from patient where cast(id as bigint) % 3 < 2), n as (select mrn, count(*) c, min(id) i from patient group by mrn),
 p as (select family, balance, gender, count(*) c, min(id) i from patient group by all)
 select asked, case when n.c = 1 or p.c = 1 then 'matched' when n.c > 1 then 'several' else 'none' end result, case when n.c = 1 then n.i when p.c = 1 then p.i end id
 from a left join n on n.mrn = a.mrn and cast(asked as bigint) % 3 = 0 left join p on p.family = a.family and p.balance = a.balance and p.gender = a.gender and cast(asked as bigint) % 2 = 0""")
def member_match(spark, d):
    """A third of the patients is asked for by identifier, every second by demographics."""
    p, k, none = rs.patient(spark, d), F.col("id").cast("bigint"), F.lit(None).cast("string")
    people = p.select("id", "identifiers", "family", F.col("balance").cast("string").alias("birthdate"), "gender")
    ident = F.array(F.struct(F.lit("urn:mrn").alias("system"), F.col("mrn").alias("value")))
    asked = p.filter(k % 3 < 2).select(F.col("id").alias("asked"), F.when(k % 3 == 0, ident).otherwise(F.filter(ident, lambda i: F.lit(False))).alias("identifiers"), none.alias("subscriber"), F.when(k % 2 == 0, F.col("family")).alias("family"), F.col("balance").cast("string").alias("birthdate"), "gender")
    return mpi.member_match(asked, people)


@query("", "select o_orderstatus status, o_orderpriority cls, count(*) n, cast(sum(o_custkey) as bigint) s from orders where o_orderdate >= timestamp '1996-01-01' group by cube (o_orderstatus, o_orderpriority)")
def raw_sql_passthrough(spark, d):
    return store.query(spark, "select o_orderstatus status, o_orderpriority cls, count(*) n, sum(o_custkey) s from orders where o_orderdate >= :since group by cube (o_orderstatus, o_orderpriority)", {"orders": rs._load(spark, d, "orders"), "absent": None}, {"since": "1996-01-01"})


_PARAMETERS = " union all ".join(f"select '{k}' kind, '{c}' code, '{t}' as type" for k, known in search.REGISTRY.items() for c, t in known.items())


@query("", _PARAMETERS)
def capabilities(spark, d):
    return caps.parameters(spark)


@query("", f"with p as ({_PARAMETERS}), n as (select kind, count(*) parameters from p group by kind), r as (select 'Patient' kind, (select count(*) from customer) resources union all select 'Encounter', (select count(*) from orders) union all select 'Organization', (select count(*) from supplier) union all select 'Observation', (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem))) select n.kind, parameters, resources from n join r on n.kind = r.kind")
def capability_statement(spark, d):
    return caps.statement(spark, {"Patient": rs.patient(spark, d), "Encounter": rs.encounter(spark, d), "Observation": rs.observation(spark, d), "Organization": rs.organization(spark, d), "Device": None})


@query("brands", "select distinct system uri from brands")
def terminology_capabilities(spark, d):
    return caps.terminology(rs.brands(spark, d))


@query("", "select cast(c_custkey as varchar) id, 'info' indicator, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') then 'Coverage requirements: prior authorization may be required for one or more orders' else 'Coverage requirements discovery available' end summary from customer")
def coverage_cards(spark, d):
    drafts = rs._load(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count("*").alias("orders"))
    return caps.cards(rs.patient(spark, d).select("id").join(drafts, "id", "left"))


@query("", """select action, subtype, outcome, count(*) n from (select case event_type when 'view' then (case when user_id % 2 = 0 then 'R' else 'E' end) when 'click' then 'U' when 'error' then 'D' else (case when user_id % 2 = 0 then 'E' else 'C' end) end action,
 case event_type when 'view' then (case when user_id % 2 = 0 then 'read' else 'search-type' end) when 'click' then 'patch' when 'error' then 'delete' else (case when user_id % 2 = 0 then 'operation' else 'create' end) end subtype,
 case event_id % 4 when 1 then '4' when 2 then '8' else '0' end outcome from events) group by all""")
def audit_classify(spark, d):
    e = rs._load(spark, d, "events")
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "click", "PATCH").when(F.col("event_type") == "error", "DELETE").otherwise("POST")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 503, 301))), (F.col("event_id") % 4 + 1).cast("int"))
    action, subtype, outcome = audit.classify(method, F.col("user_id") % 2 == 0, status)
    return e.select(action.alias("action"), subtype.alias("subtype"), outcome.alias("outcome")).groupBy("action", "subtype", "outcome").agg(F.count("*").alias("n"))


@query(
    "",
    """with hits as (select p.m, count(*) hits, min(c_custkey) hit from customer c join (select distinct cast(floor(c_acctbal) as bigint) m from customer) p on cast(floor(c.c_acctbal) as bigint) = p.m group by p.m),
 b as (select o_orderkey k, hits, case when hits = 1 then cast(hit as varchar) else substr(sha256(concat('b', o_orderkey, '/0')), 1, 32) end pid, c_nationkey nat from orders join customer on o_custkey = c_custkey join hits on m = cast(floor(c_acctbal) as bigint)),
 s as (select b.*, (select count(*) from supplier where s_nationkey = nat) sups, (select min(s_suppkey) from supplier where s_nationkey = nat) sup from b),
 r as (select *, case when hits > 1 then 'multiple-matches' when sups <> 1 then 'unresolved' end reason from s)
 select concat('b', k) bundle, 0 n, case when reason is null then 'exists' else 'rejected' end status, reason, case when reason is null then pid end id, null::varchar subject, null::varchar provider from r union all
 select concat('b', k), 1, case when reason is null then 'created' else 'rejected' end, reason, case when reason is null then substr(sha256(concat('b', k, '/1')), 1, 32) end,
  case when reason is null then concat('Patient/', pid) end, case when reason is null then concat('Organization/', sup) end from r""",
)
def bundle_transaction(spark, d):
    """An order as a bundle of a patient, unless one has its balance, and an encounter that refers to it and to the one supplier of its nation."""
    orders, customers = rs._load(spark, d, "orders"), rs._load(spark, d, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).withColumn("m", F.floor("c_acctbal").cast("string"))
    key, none = F.concat(F.lit("b"), F.col("o_orderkey").cast("string")), F.lit(None).cast("string")
    urn = F.concat(F.lit("urn:uuid:"), F.col("o_custkey").cast("string"))
    ref = lambda c: F.struct(c.alias("reference"))
    who = F.concat(F.lit("Organization?identifier=urn:nation|"), F.col("c_nationkey").cast("string"))
    patient = rows.select(key.alias("bundle"), F.lit(0).alias("n"), urn.alias("full_url"), F.lit("POST").alias("method"), none.alias("url"), F.concat(F.lit("identifier=urn:balance|"), "m").alias("if_none_exist"), F.to_json(F.struct(F.lit("Patient").alias("resourceType"))).alias("body"))
    body = F.to_json(F.struct(F.lit("Encounter").alias("resourceType"), ref(urn).alias("subject"), ref(who).alias("serviceProvider")))
    visit = rows.select(key.alias("bundle"), F.lit(1).alias("n"), none.alias("full_url"), F.lit("POST").alias("method"), none.alias("url"), none.alias("if_none_exist"), body.alias("body"))
    stored = customers.select(F.lit("Patient").alias("kind"), F.lit("urn:balance").alias("system"), F.floor("c_acctbal").cast("string").alias("value"), F.col("c_custkey").cast("string").alias("id"))
    supplier = rs._load(spark, d, "supplier").select(F.lit("Organization").alias("kind"), F.lit("urn:nation").alias("system"), F.col("s_nationkey").cast("string").alias("value"), F.col("s_suppkey").cast("string").alias("id"))
    got = bundle.apply(patient.unionByName(visit), stored.unionByName(supplier))
    return got.select("bundle", "n", "status", "reason", "id", F.get_json_object("body", "$.subject.reference").alias("subject"), F.get_json_object("body", "$.serviceProvider.reference").alias("provider"))


@query("patient", "select id, case when gender is null then 'required:gender' else '' end issues from patient")
def profile_required(spark, d):
    path = lambda p, **k: {"id": f"Patient.{p}", "path": f"Patient.{p}", "min": 1} | k
    rules = {"url": "urn:profile", "snapshot": {"element": [path("gender"), path("name.family"), path("contact.name"), path("identifier.system")]}}
    return rs.patient(spark, d).select("id", F.array_join(profile.profile_issues(F.col("body_json"), [rules]), ";").alias("issues"))


@query("patient", "select id, case when gender is null then 'resourceType,id' else 'resourceType,id,gender' end fields from patient")
def elements_projection(spark, d):
    return rs.patient(spark, d).select("id", F.array_join(F.json_object_keys(profile.elements(F.col("body_json"), ["gender"])), ",").alias("fields"))


@query("patient", "select id, '1' version, last_updated updated, family from patient")
def stamped_body(spark, d):
    p = rs.patient(spark, d)
    body = p.select(profile.stamp(F.col("body_json"), F.col("id"), F.col("version_id"), F.col("last_updated")).alias("b"))
    at = lambda c: F.get_json_object("b", f"$.{c}")
    return body.select(at("id").alias("id"), at("meta.versionId").alias("version"), at("meta.lastUpdated").alias("updated"), at("name[0].family").alias("family"))


@query("", "select concat('resp-', o_orderkey) id, 'queued' outcome, concat('Claim/', o_orderkey) request from orders where o_custkey = 7 and o_orderstatus <> 'F'")
def prior_auth_inquire(spark, d):
    use = F.when(F.col("o_orderstatus") == "F", "claim").otherwise("preauthorization")
    claims = rs._load(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("Patient/"), F.col("o_custkey").cast("string")).alias("patient"), F.lit("Organization/1").alias("insurer"), use.alias("use"))
    return profile.inquired(profile.submitted(claims, "2026-01-01"), patient="Patient/7").select("id", "outcome", "request")


from medlattice.plans import intake, operations  # noqa: E402, F401  (they register their queries)
