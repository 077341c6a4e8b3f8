"""Code systems and value sets: extraction, expansion, three-state checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concepts(systems: DataFrame) -> DataFrame:
    """system, code, display, version of all concepts of CodeSystem documents (body_json), of any depth, in pre-order."""

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"system": [], "code": [], "display": [], "version": []}
            for body in batch.column("body_json").to_pylist():
                doc = json.loads(body)
                todo = list(reversed(doc.get("concept") or []))
                while todo:
                    c = todo.pop()
                    if c.get("code") is not None:
                        for k, v in (("system", doc.get("url")), ("code", c["code"]), ("display", c.get("display")), ("version", doc.get("version"))):
                            out[k].append(v)
                    todo.extend(reversed(c.get("concept") or []))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string()) for k in out]))

    return systems.select("body_json").mapInArrow(walk, "system string, code string, display string, version string")


def expand_value_sets(includes: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expansion, headers) of includes (valueset, system, codes, filtered, imports, excluded).

    An include with codes gives these; a whole system gives its loaded concepts; filters, imports, exclusions and
    systems that aren't loaded leave the value set incomplete.
    """
    systems = loaded.select("system").distinct().withColumn("there", F.lit(True))
    rows = includes.join(systems, "system", "left")
    plain = ~F.col("filtered") & ~F.col("imports")
    named = rows.filter(plain & (F.size("codes") > 0)).select("valueset", "system", F.explode("codes").alias("code"))
    whole = rows.filter(plain & (F.size("codes") <= 0)).join(loaded.select("system", "code"), "system").select("valueset", "system", "code")
    missing = ~plain | F.col("excluded") | ((F.size("codes") <= 0) & F.col("there").isNull())
    headers = rows.groupBy("valueset").agg((~F.max(missing)).alias("complete"))
    return named.unionByName(whole).distinct(), headers


def validate_in_value_set(codes: DataFrame, expansion: DataFrame, headers: DataFrame) -> DataFrame:
    """codes (valueset, system or null, code) with result: valid, invalid or unknown."""
    hits = expansion.select("valueset", F.col("system").alias("_s"), "code").distinct()
    exact = codes.join(hits, ["valueset", "code"], "left").withColumn("hit", F.col("_s").isNotNull() & (codes["system"].isNull() | (codes["system"] == F.col("_s"))))
    keys = codes.columns
    best = exact.groupBy(*keys).agg(F.max("hit").alias("hit"))
    loaded = expansion.groupBy("valueset").agg(F.lit(True).alias("loaded"))
    partial = headers.groupBy("valueset").agg(F.min("complete").alias("complete"))
    joined = best.join(loaded, "valueset", "left").join(partial, "valueset", "left")
    result = F.when(F.col("hit"), "valid").when(F.col("loaded").isNull() | (F.col("complete") == F.lit(False)), "unknown").otherwise("invalid")
    return joined.select(*keys, result.alias("result"))


def validate_in_system(codes: DataFrame, loaded: DataFrame) -> DataFrame:
    """codes (system, code) with result: valid, invalid if the system is loaded, else unknown."""
    known = loaded.select("system", "code").distinct().withColumn("hit", F.lit(True))
    systems = loaded.select("system").distinct().withColumn("there", F.lit(True))
    joined = codes.join(known, ["system", "code"], "left").join(systems, "system", "left")
    return joined.select(*codes.columns, F.when(F.col("hit"), "valid").when(F.col("there"), "invalid").otherwise("unknown").alias("result"))


def fold(results: DataFrame, keys: list[str]) -> DataFrame:
    """Any valid: ok; else any invalid: invalid; else any unknown: pending."""
    any_ = lambda r: F.max(F.col("result") == r)
    return results.groupBy(*keys).agg(F.when(any_("valid"), "ok").when(any_("invalid"), "invalid").otherwise("pending").alias("outcome"))


def expand_page(expansion: DataFrame, valueset: str, text: str = "", count: int = 1000, offset: int = 0) -> DataFrame:
    """Rows of a value set by substring of code or display, in order of system and code."""
    rows = expansion.filter(F.col("valueset") == valueset)
    if text:
        rows = rows.filter(F.lower("code").contains(text.lower()) | F.lower(F.coalesce("display", F.lit(""))).contains(text.lower()))
    return rows.orderBy("system", "code").offset(max(0, offset)).limit(min(5000, max(0, count)))


def lookup(loaded: DataFrame, system: str, code: str) -> DataFrame:
    return loaded.filter((F.col("system") == system) & (F.col("code") == code)).select("system", "code", "display")


def concept_counts(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("system").agg(F.countDistinct("code").alias("concepts"))


def unloaded_value_sets(bindings: DataFrame, expansion: DataFrame) -> DataFrame:
    """Bound value sets, without version, that have no expansion."""
    wanted = bindings.select(F.substring_index("valueset", "|", 1).alias("valueset")).distinct()
    return wanted.join(expansion.select("valueset").distinct(), "valueset", "left_anti")


def expansion_total(expansion: DataFrame, valueset: str, text: str = "") -> DataFrame:
    """One row: total of a value set's rows that a page is cut from."""
    rows = expansion.filter(F.col("valueset") == valueset)
    if text:
        rows = rows.filter(F.lower("code").contains(text.lower()) | F.lower(F.coalesce("display", F.lit(""))).contains(text.lower()))
    return rows.agg(F.count("*").alias("total"))


_DEFINITION = "url string, type string, name string, derivation string, snapshot struct<element:array<struct<binding:struct<valueSet:string>>>>"


def bound_value_sets(package: DataFrame, expansion: DataFrame | None = None, hosts: list[str] | None = None) -> DataFrame:
    """valueset: bound in a package's structure definitions (type, body_json), without version; not those that have an
    expansion, and only those of some hosts, if given."""
    docs = package.filter("type = 'StructureDefinition'").select(F.from_json("body_json", _DEFINITION).alias("d"))
    bound = docs.select(F.explode("d.snapshot.element").alias("e")).select(F.substring_index("e.binding.valueSet", "|", 1).alias("valueset")).filter("valueset is not null").distinct()
    if hosts:
        bound = bound.filter(F.regexp_extract("valueset", "^[a-z]+://([^/]+)", 1).isin(hosts))
    return bound if expansion is None else bound.join(expansion.select("valueset").distinct(), "valueset", "left_anti")


def profiles(package: DataFrame) -> DataFrame:
    """url, type, name of installed profiles: structure definitions that constrain another."""
    docs = package.filter("type = 'StructureDefinition'").select(F.from_json("body_json", _DEFINITION).alias("d")).select("d.*")
    return docs.filter("derivation = 'constraint'").select("url", "type", "name")


def installed(wanted: DataFrame, package: DataFrame) -> DataFrame:
    """url, installed of wanted profiles."""
    have = package.select(F.get_json_object("body_json", "$.url").alias("url")).distinct().withColumn("_there", F.lit(True))
    return wanted.join(have, "url", "left").select("url", F.coalesce("_there", F.lit(False)).alias("installed"))


def update_report(headers: DataFrame, latest: DataFrame) -> DataFrame:
    """system, loaded (the greatest version), latest, current of systems whose newest version is known from elsewhere."""
    own = headers.groupBy("system").agg(F.max("version").alias("loaded"))
    return latest.withColumnRenamed("version", "latest").join(own, "system", "left").select("system", "loaded", "latest", F.coalesce(F.col("loaded") == F.col("latest"), F.lit(False)).alias("current"))


def replace_expansion(stored: DataFrame, valueset: str, rows: DataFrame) -> DataFrame:
    """Stored expansions with the rows of one value set replaced."""
    return stored.filter(F.col("valueset") != valueset).unionByName(rows.select(F.lit(valueset).alias("valueset"), "system", "code", "display"))


def loaded(concepts: DataFrame, version: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, header) of one load of a code system: each (system, code) once, at most `limit` rows if a limit is asked for."""
    rows = concepts.groupBy("system", "code").agg(F.min("display").alias("display"))
    rows = rows.orderBy("system", "code").limit(limit) if limit is not None else rows
    return rows, rows.groupBy("system").agg(F.lit(version).alias("version"), F.count("*").alias("count"))


def questionnaire_package(asked: DataFrame, questionnaires: DataFrame, libraries: DataFrame, value_sets: DataFrame) -> DataFrame:
    """asked, kind, url of what an asked canonical needs: the questionnaire, its libraries and the value sets of its items of
    any depth, as far as they are stored (url, body_json); nothing where the questionnaire isn't."""
    library = "http://hl7.org/fhir/StructureDefinition/cqf-library"
    url = F.substring_index("asked", "|", 1)
    forms = asked.select("asked", url.alias("url")).join(questionnaires.select("url", "body_json"), "url")

    def needs(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for name, body in zip(b.column("asked").to_pylist(), b.column("body_json").to_pylist()):
                doc = json.loads(body)
                found = {("Library", e.get("valueCanonical")) for e in doc.get("extension") or [] if e.get("url") == library}
                todo = list(doc.get("item") or [])
                while todo:
                    item = todo.pop()
                    found.add(("ValueSet", item.get("answerValueSet")))
                    todo.extend(item.get("item") or [])
                out += [(name, k, u.split("|")[0]) for k, u in found if u]
            yield pa.RecordBatch.from_pydict({c: [r[k] for r in out] for k, c in enumerate(("asked", "kind", "url"))}, schema=pa.schema([(c, pa.string()) for c in ("asked", "kind", "url")]))

    wanted = forms.select("asked", "body_json").mapInArrow(needs, "asked string, kind string, url string").distinct()
    have = libraries.select(F.lit("Library").alias("kind"), "url").unionByName(value_sets.select(F.lit("ValueSet").alias("kind"), "url")).distinct()
    return forms.select("asked", F.lit("Questionnaire").alias("kind"), "url").unionByName(wanted.join(have, ["kind", "url"], "left_semi").select("asked", "kind", "url"))
