"""Promotion of appended versions: merges applied, references and indexes rewritten, tables of entity resolution kept."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from medlattice.functions.schema import Schemas, flatten, without_null_columns
from medlattice.operators.history import newest
from medlattice.operators.lifecycle import uuid7
from medlattice.operators.lineage import cut
from medlattice.operators.mpi import body_ids, identifier_keys, rewritten, with_survivors
from medlattice.operators.mpi import merges as merges_of
from medlattice.sources.store import Table, retry

RULE = "deterministic_rule:shared-identifier"


def order(kinds: list[str]) -> list[str]:
    """Patient first, so that its survivors are known to the others, which follow by name."""
    return sorted(kinds, key=lambda k: (k != "Patient", k))


def union_entries(a: Column | str, b: Column | str) -> Column:
    """Two arrays of entries as one, equal ones once, in order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))


@pandas_udf(T.StringType())
def _linked(bodies, replaces, replaced_by):
    def one(body, old, new):
        if new is None and (old is None or not len(old)):
            return body
        doc = json.loads(body)
        links = [{"other": {"reference": f"Patient/{x}"}, "type": "replaces"} for x in sorted(old if old is not None else [])]
        if new is not None:
            doc["active"] = False
            links.append({"other": {"reference": f"Patient/{new}"}, "type": "replaced-by"})
        doc["link"] = [*(doc.get("link") or []), *links]
        return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))

    return type(bodies)([one(*x) if x[0] else x[0] for x in zip(bodies, replaces, replaced_by)])


def apply_merges(current: DataFrame, merges: DataFrame) -> DataFrame:
    """current patients (id, body_json, idx, identifiers, ...) with `merged`: survivors link what they replace and gain its
    index entries, merged ones are inactive and link their survivor. merges: merged, survivor."""
    there = current.select("id")
    pairs = merges.join(there.withColumnRenamed("id", "merged"), "merged", "left_semi").join(there.withColumnRenamed("id", "survivor"), "survivor", "left_semi")
    gone = current.select(F.col("id").alias("merged"), F.col("idx").alias("_idx"), F.col("identifiers").alias("_ids"))
    gains = pairs.join(gone, "merged").groupBy(F.col("survivor").alias("id")).agg(F.collect_list("merged").alias("_old"), F.flatten(F.collect_list("_idx")).alias("_idx"), F.flatten(F.collect_list("_ids")).alias("_ids"))  # of one merge
    rows = current.join(gains, "id", "left").join(pairs.select(F.col("merged").alias("id"), F.col("survivor").alias("_new")), "id", "left")
    new = {"body_json": _linked("body_json", "_old", "_new"), "idx": union_entries("idx", "_idx"), "identifiers": union_entries("identifiers", "_ids"), "merged": F.col("_new").isNotNull()}
    return rows.withColumns(new).select(*current.columns, "merged")


def rewrite_documents(df: DataFrame, survivors: DataFrame) -> DataFrame:
    """df with ids of merged patients in body_json and in `Patient/<merged>` values of idx turned to their survivor; the survivors
    of all ids of one row are joined to it once, for both."""
    values = F.transform(F.filter("idx", lambda s: s["value"].startswith("Patient/")), lambda s: F.substring(s["value"], 9, 1 << 30))
    none = F.array().cast("array<string>")
    rows = with_survivors(df, F.array_distinct(F.concat(F.coalesce(body_ids("body_json"), none), F.coalesce(values, none))), survivors)
    to = lambda s: F.when(s["value"].startswith("Patient/"), F.concat(F.lit("Patient/"), F.element_at("_to", F.substring(s["value"], 9, 1 << 30))))
    moved = lambda s: F.struct(s["code"].alias("code"), s["system"].alias("system"), F.coalesce(to(s), s["value"]).alias("value"))
    new = {"body_json": rewritten("body_json", "_to"), "idx": F.when(F.col("_to").isNull(), F.col("idx")).otherwise(F.transform("idx", moved))}
    return rows.withColumns(new).select(*df.columns)


def patient_links(people: DataFrame, decided: DataFrame) -> DataFrame:
    """system, value, fhir_id, path: of each identifier key one row. A merge's keys lead to its survivor, others to the key's
    least holder among singles and reviewed candidates."""
    members = decided.select(F.explode(F.split("members", ",")).alias("id"), "decision", "survivor")
    rows = identifier_keys(people).select("id", "key").join(members, "id")
    rank = F.when(F.col("decision") == "merge", 0).otherwise(1)
    best = rows.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.coalesce("survivor", "id").alias("to"))).alias("x"))
    return best.select(F.expr("substring(key, 1, instr(key, '|') - 1)").alias("identifier_system"), F.expr("substring(key, instr(key, '|') + 1)").alias("identifier_value"), F.col("x.to").alias("fhir_id"), F.lit(RULE).alias("decision_path"))


def new_merges(merges: DataFrame, history: DataFrame | None, now: str) -> DataFrame:
    """Rows for the merge history: merges that it doesn't hold, or holds as undone only."""
    rows = merges.select(F.col("survivor").alias("surviving_fhir_id"), F.col("merged").alias("merged_fhir_id"))
    if history is not None:
        rows = rows.join(history.filter("unmerged_at is null"), ["surviving_fhir_id", "merged_fhir_id"], "left_anti")
    seed = F.concat_ws("~", F.lit(now), "surviving_fhir_id", "merged_fhir_id")
    return rows.select(uuid7(F.unix_millis(F.to_timestamp(F.lit(now))), seed).alias("merge_id"), "surviving_fhir_id", "merged_fhir_id", F.lit(now).alias("merged_at"), F.lit(RULE).alias("merge_reason"), F.lit("system").alias("merge_actor"), F.lit(None).cast("string").alias("unmerged_at"))


def new_reviews(decided: DataFrame, queue: DataFrame | None, now: str) -> DataFrame:
    """Rows for the review queue: candidate sets that it doesn't hold, whatever has been decided about those."""
    rows = decided.filter(~F.col("decision").isin("merge", "link", "distinct")).select(F.col("members").alias("candidate_ids"), F.col("decision").alias("reason"))
    if queue is not None:
        rows = rows.join(queue, "candidate_ids", "left_anti")
    action = F.when(F.col("reason") == "multi_match", "steward_pick_survivor").otherwise("verify_distinct")
    seed = F.concat_ws("~", F.lit(now), "candidate_ids")
    return rows.select(uuid7(F.unix_millis(F.to_timestamp(F.lit(now))), seed).alias("review_id"), "candidate_ids", "reason", action.alias("suggested_action"), F.lit("pending").alias("status"), F.lit(now).alias("created_at"))


def provenance(history: DataFrame, now: str) -> DataFrame:
    """First versions of a Provenance for each new row of the merge history."""
    ref = lambda c: F.struct(F.concat(F.lit("Patient/"), c).alias("reference"))
    id_ = uuid7(F.unix_millis(F.to_timestamp(F.lit(now))), F.concat(F.lit("provenance"), F.col("merge_id")))
    coding = F.struct(F.lit("http://terminology.hl7.org/CodeSystem/v3-DataOperation").alias("system"), F.lit("MERGE").alias("code"))
    body = F.struct(
        F.lit("Provenance").alias("resourceType"), id_.alias("id"), F.array(ref("surviving_fhir_id"), ref("merged_fhir_id")).alias("target"), F.lit(now).alias("recorded"),
        F.struct(F.array(coding).alias("coding")).alias("activity"), F.array(F.struct(F.struct(F.lit("deterministic entity resolution").alias("display")).alias("who"))).alias("agent"),
        F.array(F.struct(F.col("merge_reason").alias("text"))).alias("reason"),
    )
    target = lambda c: F.struct(F.lit("target").alias("code"), F.lit("").alias("system"), F.concat(F.lit("Patient/"), c).alias("value"))
    return history.select(id_.alias("id"), F.lit(1).cast("bigint").alias("version_id"), F.lit(now).alias("last_updated"), F.lit(False).alias("deleted"), F.to_json(body).alias("body_json"), F.array(target("surviving_fhir_id"), target("merged_fhir_id")).alias("idx"))


def silver(current: DataFrame, schemas: Schemas, kind: str, now: str) -> DataFrame:
    """Governance columns and the type's elements, without columns that are null everywhere; written once, as that takes two passes."""
    status = F.when(F.col("merged"), "merged").otherwise("pass") if "merged" in current.columns else F.lit("pass")
    rows = current.select(F.col("id").alias("silver_id"), F.col("id").alias("fhir_id"), "version_id", status.alias("silver_status"), F.lit(now).alias("governed_at"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "body_json")
    return without_null_columns(cut(flatten(rows, schemas, kind, ("silver_id", "fhir_id", "version_id", "silver_status", "governed_at", "deleted"))))


def metrics(bronze: DataFrame, gold: DataFrame, silver_rows: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """One row: bronze_rows, current_ids, gold, silver, merges and reviews of a promotion."""
    one = bronze.agg(F.count("*").alias("bronze_rows"), F.count_distinct("id").alias("current_ids"))
    one = one.crossJoin(gold.agg(F.count("*").alias("gold"))).crossJoin(silver_rows.agg(F.count("*").alias("silver")))  # one row each
    if decided is None:
        return one
    review = ~F.col("decision").isin("merge", "link", "distinct")
    return one.crossJoin(decided.agg(F.count_if(F.col("decision") == "merge").alias("merges"), F.count_if(review).alias("reviews")))


def promote_patients(bronze: DataFrame, merges: DataFrame) -> DataFrame:
    """The Gold rows of patients: the newest version of each id with merges applied, merged ones out of searches. The newest versions are
    written once, as merges look into them several times."""
    rows = apply_merges(cut(newest(bronze)), merges)
    return rows.withColumn("is_current", ~F.col("merged"))


def promote_others(bronze: DataFrame, survivors: DataFrame) -> DataFrame:
    """The Gold rows of another type: the newest versions with bodies and indexes that refer to survivors."""
    rows = rewrite_documents(newest(bronze), survivors)
    return rows.withColumns({"is_current": F.lit(True), "merged": F.lit(False)})


def write_gold(gold: Table, rows: DataFrame) -> int:
    """Upsert by id, tombstones included."""
    return retry(lambda: gold.upsert(rows.drop("merged")))


def promote(kind: str, bronze: Table, gold: Table, silver_table: Table, schemas: Schemas, now: str, decided: DataFrame | None = None, survivors: DataFrame | None = None) -> DataFrame:
    """One type from Bronze to Gold and Silver: patients with what has been decided about them, others with references to
    survivors. Returns the metrics; without a Bronze table there is nothing to do and all are 0."""
    rows = bronze.read()
    if rows is None:
        return bronze.spark.createDataFrame([(0, 0, 0, 0)], "bronze_rows bigint, current_ids bigint, gold bigint, silver bigint")
    if kind == "Patient" and decided is not None:
        done = promote_patients(rows, merges_of(decided))
    else:
        done = promote_others(rows, survivors) if survivors is not None else newest(rows).withColumns({"is_current": F.lit(True), "merged": F.lit(False)})
    done = cut(done)
    write_gold(gold, done)
    retry(lambda: silver_table.overwrite(silver(done, schemas, kind, now)))
    return metrics(rows, done, done, decided if kind == "Patient" else None)
