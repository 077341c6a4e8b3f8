"""Queries of loaders, table upkeep, entity-resolution rules, formats and search defaults, over files and rows made from the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from medlattice.functions import index as ix
from medlattice.operators import lifecycle, mpi, search, terminology, validate
from medlattice.plans import resources as rs
from medlattice.plans.queries import _table, query
from medlattice.sources import loaders
from medlattice.sources.store import Catalog, Table


def _text(spark, rows, name: str, column: str) -> str:
    """Lines written to a folder of the shared store."""
    path = _table(spark, name).path
    rows.select(F.col(column).alias("value")).coalesce(1).write.text(path)
    return path


@query("", "select 'http://loinc.org' system, cast(p_partkey as varchar) code, case when p_partkey % 3 = 0 then 'Long \"' || p_name || '\", x' when p_partkey % 3 = 1 then 'Short ' || p_name else cast(p_partkey as varchar) end display from part where p_partkey % 4 <> 0")
def load_loinc(spark, d):
    """Quoted fields with commas and quotes; deprecated codes are left out."""
    k, part = F.col("p_partkey"), rs._load(spark, d, "part")
    long = F.when(k % 3 == 0, F.concat(F.lit('"Long ""'), "p_name", F.lit('"", x"'))).otherwise("")
    short = F.when(k % 3 == 1, F.concat(F.lit("Short "), "p_name")).otherwise("")
    status = F.when(k % 4 == 0, "DEPRECATED").when(k % 4 == 1, "").otherwise("ACTIVE")
    line = F.concat_ws(",", k.cast("string"), *[F.lit("")] * 7, long, short, F.lit(""), status)
    head = spark.createDataFrame([(0, ",".join(f"c{n}" for n in range(12)))], "n int, value string")
    rows = head.unionByName(part.select(F.lit(1).alias("n"), line.alias("value"))).orderBy("n")
    return loaders.loinc(spark, _text(spark, rows, "loinc", "value"))


@query("", "select 'http://snomed.info/sct' system, cast(p_partkey as varchar) code, case when p_partkey % 3 = 0 then cast(p_partkey as varchar) else 'A ' || p_brand end display from part where p_partkey % 5 <> 0")
def load_snomed(spark, d):
    """Inactive concepts go; the first active fully specified name is shown, else the code."""
    k, part = F.col("p_partkey"), rs._load(spark, d, "part")
    head = lambda names: spark.createDataFrame([(0, "\t".join(names))], "n int, value string")
    concept = part.select(F.lit(1).alias("n"), F.concat_ws("\t", k.cast("string"), F.lit("x"), F.when(k % 5 == 0, "0").otherwise("1")).alias("value"))
    named = part.select("p_brand", k.alias("k"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("v"))
    name = named.select(F.lit(1).alias("n"), F.concat_ws("\t", (F.col("k") * 10 + F.col("v")).cast("string"), F.when((F.col("k") % 3 == 0) | (F.col("v") == 1), "0").otherwise("1"), F.col("k").cast("string"), F.lit(loaders.FSN), F.concat(F.element_at(F.array(F.lit("Z "), F.lit("A "), F.lit("B ")), F.col("v")), "p_brand")).alias("value"))
    files = [_text(spark, head(h).unionByName(rows).orderBy("n"), f"snomed{n}", "value") for n, (h, rows) in enumerate(((("id", "effectiveTime", "active"), concept), (("id", "active", "conceptId", "typeId", "term"), name)))]
    return loaders.snomed(spark, *files)


@query("", "select 'http://www.nlm.nih.gov/research/umls/rxnorm' system, cast(p_partkey as varchar) code, 'first ' || p_brand display from part where p_partkey % 4 <> 0")
def load_rxnorm(spark, d):
    """English names of the source only, one for each code: that of the least atom."""
    k = F.col("p_partkey")
    rows = rs._load(spark, d, "part").select("p_brand", k.alias("k"), F.explode(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("v"))
    v = F.col("v")
    cells = [F.lit("")] * 18
    cells[0], cells[7], cells[14] = F.col("k").cast("string"), F.concat(F.lit("a"), v.cast("string")), F.concat(F.when(v == 1, "first ").otherwise("other "), "p_brand")
    cells[1] = F.when((v == 0) | (F.col("k") % 4 == 0), "SPA").otherwise("ENG")
    cells[11] = F.lit("RXNORM")
    return loaders.rxnorm(spark, _text(spark, rows.select(F.concat_ws("|", *cells).alias("value")), "rxnorm", "value"))


@query("", "select case n_regionkey % 2 when 0 then 'CodeSystem' else 'ValueSet' end as type, 'urn:' || n_nationkey as url from nation where n_regionkey < 4")
def load_package(spark, d):
    """Conformance resources among a package's documents, one a file; others are left out."""
    base = _table(spark, "package").path
    kind = F.when(F.col("n_regionkey") == 4, "Patient").when(F.col("n_regionkey") % 2 == 0, "CodeSystem").otherwise("ValueSet")
    docs = rs._load(spark, d, "nation").select(F.to_json(F.struct(kind.alias("resourceType"), F.concat(F.lit("urn:"), F.col("n_nationkey").cast("string")).alias("url"))).alias("value"))
    p = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fs = p("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n, text in enumerate([*[r.value for r in docs.collect()], None]):  # 25 nations
        out = fs.create(p(f"{n}.json" if text else "package.json"), True)
        out.write(bytearray((text or '{"resourceType":"CodeSystem","url":"urn:none"}').encode()))
        out.close()
    return loaders.package(spark, base).select("type", "url")


@query("", "select 'urn:oid:1' valueset, 'urn:brand' system, cast(n_nationkey as varchar) code, n_name display from nation")
def load_expansion(spark, d):
    """A stored expansion in one document."""
    contains = [{"system": "urn:brand", "code": str(r.n_nationkey), "display": r.n_name} for r in rs._load(spark, d, "nation").collect()]  # 25 nations
    doc = spark.createDataFrame([(json.dumps({"url": "urn:oid:1", "expansion": {"total": 25, "contains": contains}}),)], "value string")
    return loaders.expansion_file(spark, _text(spark, doc, "expansion", "value"))


@query("", "select 'urn:cs' system, 'r' || r_regionkey code, r_name display, '1' as version from region union all select 'urn:cs', 'n' || n_nationkey, n_name, '1' from nation union all select 'urn:cs', 'd' || n_nationkey, null, '1' from nation")
def concept_tree(spark, d):
    """Nested concepts of any depth: regions, nations in them, and one more below."""
    n = rs._load(spark, d, "nation").select("n_regionkey", F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("display"), F.array(F.struct(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("code"))).alias("concept")).alias("c"))
    n = n.groupBy("n_regionkey").agg(F.collect_list("c").alias("concept"))
    r = rs._load(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    top = r.agg(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("display"), "concept")).alias("concept"))  # five regions
    return terminology.concepts(top.select(F.to_json(F.struct(F.lit("urn:cs").alias("url"), F.lit("1").alias("version"), "concept")).alias("body_json")))


@query(
    "",
    """with p as (select c_custkey k, cast(floor((c_custkey - 1) / 2.0) as bigint) pair, c_custkey % 2 = 1 odd from customer), q as (select pair, min(k) a, max(k) b, pair % 6 rule from p group by pair having count(*) = 2)
 select cast(a as varchar) a, cast(b as varchar) b, case rule when 0 then 'merge' when 1 then 'sex_mismatch' when 2 then 'date_of_death_mismatch' when 3 then 'merge' when 5 then 'merge' end decision from q where rule not in (4)""",
)
def mpi_guardrails(spark, d):
    """Pairs by a shared identifier: sex and date of death differ, deaths fourteen days apart, an SSN conflict, one without sex."""
    c, k = rs._load(spark, d, "customer"), F.col("c_custkey")
    pair, odd = F.floor((k - 1) / 2), k % 2 == 1
    rule = pair % 6
    ident = lambda s, v: F.struct(F.lit(s).alias("system"), v.cast("string").alias("value"), F.lit("").alias("typeCode"))
    ssn = F.when(rule == 4, F.when(odd, "111-22-3333").otherwise("111-22-4444"))
    idents = F.array(ident("HTTP://Host.org/mrn/", F.concat(F.lit("  m  "), pair.cast("string"))), F.when(ssn.isNotNull(), ident(mpi.SSN, ssn)))
    sex = F.when(rule == 1, F.when(odd, "male").otherwise("female")).when(rule == 5, F.when(odd, "male")).otherwise("male")
    death = F.when(rule == 2, F.when(odd, "2020-01-01").otherwise("2020-02-01")).when(rule == 3, F.when(odd, "2020-01-01").otherwise("2020-01-15"))
    people = c.select(k.cast("string").alias("id"), sex.alias("gender"), F.lit("2026").alias("last_updated"), F.lit(False).alias("deleted"), F.lit(True).alias("active"), death.alias("deceased"), ssn.alias("ssn"), F.array_compact(idents).alias("identifiers"))
    decided = mpi.decisions(people, mpi.components(people, mpi.links(mpi.identifier_keys(people)))).filter("n = 2")
    both = F.transform(F.split("members", ","), lambda x: x.cast("int"))
    return decided.select(F.array_min(both).cast("string").alias("a"), F.array_max(both).cast("string").alias("b"), "decision")


@query("", "select cast(c_custkey as varchar) id, case c_custkey % 4 when 0 then 'http://host.org/Path|a b' when 1 then 'urn:x|v' when 2 then 'http://hl7.org/fhir/sid/us-ssn|123456789' end key from customer")
def identifier_normalise(spark, d):
    k = F.col("c_custkey") % 4
    system = F.when(k == 0, "HTTP://Host.ORG/Path/").when(k == 1, " urn:x ").when(k == 2, mpi.SSN).otherwise("urn:y")
    value = F.when(k == 0, "  a \t b ").when(k == 1, "v").when(k == 2, "123-45-6789").otherwise("   ")
    return rs._load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), mpi.normal_key(system, value).alias("key"))


@query("", "select cast(c_custkey as varchar) id, case c_custkey % 4 when 0 then 'http://x/Patient/b/_history/2' when 1 then 'Patient/b' when 2 then 'Group/a' else 'Patient/c' end ref from customer")
def rewrite_reference_forms(spark, d):
    """Absolute and versioned references keep what is before and behind the id."""
    k = F.col("c_custkey") % 4
    ref = F.when(k == 0, "http://x/Patient/a/_history/2").when(k == 1, "Patient/a").when(k == 2, "Group/a").otherwise("Patient/c")
    rows = rs._load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), ref.alias("ref"))
    return mpi.rewrite_references(rows, "ref", spark.createDataFrame([("a", "b")], "merged string, survivor string"))


_FORMATS = [
    ("date", "2020-02-30", True), ("date", "2020-13", False), ("dateTime", "2020-01-01T00:00:60Z", True), ("dateTime", "2020-01-01T00:00", False), ("instant", "2020-01-01T00:00:00.5+14:00", True), ("instant", "2020-01-01", False),
    ("time", "23:59:59", True), ("time", "24:00:00", False), ("code", "a\tb", True), ("code", "a  b", False), ("id", "a.b-1", True), ("id", "a_b", False), ("oid", "urn:oid:1.2.0", True), ("oid", "urn:oid:3.1", False),
    ("uuid", "urn:uuid:C757873D-EC9A-4326-A141-556F43239520", True), ("uuid", "urn:uuid:1", False),
]


@query("", "select * from (values " + ", ".join(f"('{k}', '{v}', {str(ok).lower()})" for k, v, ok in _FORMATS) + ") t(kind, value, ok)")
def formats(spark, d):
    """Every format with a value that fits and one that doesn't."""
    rows = spark.createDataFrame([(k, v) for k, v, _ in _FORMATS], "kind string, value string")
    ok = F.lit(None).cast("boolean")
    for k in validate.FORMATS:
        ok = F.when(F.col("kind") == k, validate.format_ok(F.col("value"), k)).otherwise(ok)
    return rows.withColumn("ok", ok)


@query("", "select cast(c_custkey as varchar) id, case when c_custkey % 5 = 0 then 'unknown:nmae' else '' end issues from customer")
def unknown_root_elements(spark, d):
    body = F.when(F.col("c_custkey") % 5 == 0, '{"id":"a","nmae":1,"_name":{}}').otherwise('{"id":"a","name":1}')
    return rs._load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), body.alias("b")).select("id", F.array_join(validate.unknown_elements("b", ["id", "name"]), ";").alias("issues"))


@query("patient", "select id, last_updated from patient order by last_updated desc, id desc limit 50")
def sort_default(spark, d):
    return search.search(rs.patient(spark, d), "Patient", "nothing=1").select("id", "last_updated")


@query("patient", "select id, last_updated from patient order by last_updated, id limit 30 offset 5")
def sort_unknown_field(spark, d):
    return search.search(rs.patient(spark, d), "Patient", "_sort=nothing&_count=30&_offset=5").select("id", "last_updated")


@query("", "select n_name as id, 'gold' tier from nation union all select 'none', null")
def serve_routing(spark, d):
    """Searches go to the tier of the mode; a table that isn't there is left out."""
    c = Catalog(_table(spark, "serve").path, "medallion")
    rows = rs._load(spark, d, "nation").select(F.col("n_name").alias("id"))
    for tier in ("bronze", "gold"):
        Table(spark, c.path("Place", tier)).overwrite(rows.withColumn("tier", F.lit(tier)))
    missing = spark.createDataFrame([("none", None)], "id string, tier string")
    return c.serve(spark, "Place").unionByName(missing if c.serve(spark, "Other") is None else missing.filter("false"))


@query("", "select count(*) n, 2 as gone, 3 as version from nation where n_regionkey < 3")
def table_vacuum(spark, d):
    """Parts that only older versions hold are deleted; the newest version stays whole."""
    t = _table(spark, "vacuum")
    for k in range(3):
        t.overwrite(rs._load(spark, d, "nation").filter(F.col("n_regionkey") < k + 1).select(F.col("n_name").alias("id")))
    gone = t.vacuum(0, force=True)
    return t.read().agg(F.count("*").alias("n")).select("n", F.lit(gone).alias("gone"), F.lit(t.version()).alias("version"))


@query("", "select cast(event_id as varchar) id, epoch_us(ts) // 1000 ms from events")
def uuid7_time(spark, d):
    """Ids made from times give these times back, and are as many as their seeds."""
    e = rs._load(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    made = e.select("event_id", lifecycle.uuid7(F.col("ms"), F.col("event_id")).alias("u"))
    one = made.groupBy("u").agg(F.min("event_id").alias("event_id"))
    return one.select(F.col("event_id").cast("string").alias("id"), ix.uuid7_millis(F.col("u")).alias("ms"))
