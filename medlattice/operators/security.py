"""Row and element security: scopes, consent, redaction."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlattice.operators.search import Condition, predicate

CONFIDENTIALITY = "http://terminology.hl7.org/CodeSystem/v3-Confidentiality"
ACT_CODE = "http://terminology.hl7.org/CodeSystem/v3-ActCode"
#: Restricted confidentiality and codes that forbid redisclosure.
RESTRICTED = ("R", "V")
NO_REDISCLOSURE = "NORDSCLCD"
REDISCLOSED = ("ETH", "SUD")


@dataclass(frozen=True)
class Scope:
    context: str
    kind: str
    verbs: frozenset
    restrictions: tuple = field(default=())


def parse_scope(text: str) -> Scope | None:
    """`patient/Observation.read`, or `user/*.rs?code=x`; None if neither version reads it."""
    m = re.fullmatch(r"(patient|user|system)/([A-Za-z]+|\*)\.(read|write|\*)", text)
    if m:
        return Scope(m[1], m[2], frozenset({"read": "rs", "write": "cud", "*": "cruds"}[m[3]]))
    m = re.fullmatch(r"(patient|user|system)/([A-Za-z]+|\*)\.(c?r?u?d?s?)(?:\?(.+))?", text)
    if m and m[3]:
        return Scope(m[1], m[2], frozenset(m[3]), tuple(parse_qsl(m[4] or "")))
    return None


def scope_filter(scopes: list[str], kind: str, verb: str, patient: str | None, links: list[str]) -> Column:
    """The rows that scopes open: denied without a matching one, or if only patient scopes match and there is no patient."""
    found = [s for s in map(parse_scope, scopes) if s and s.kind in (kind, "*") and verb in s.verbs]
    if not found:
        return F.lit(False)
    allowed = F.lit(True)
    if all(s.context == "patient" for s in found):
        if patient is None:
            return F.lit(False)
        allowed = F.exists("idx", lambda x: x["code"].isin(links) & (x["value"] == f"Patient/{patient}"))
    if all(s.restrictions for s in found):
        values: dict[str, list[str]] = {}
        for k, v in (r for s in found for r in s.restrictions):
            values.setdefault(k, []).append(v)
        allowed = reduce(lambda a, c: a & c, [predicate(Condition(k, "token", v)) for k, v in values.items()], allowed)
    return allowed


def decision(actor: str, confidentiality: Column, sensitivity: Column, own: Column | None = None) -> Column:
    """permit or deny by the default policy; without a label a row is normal."""
    if actor == "anonymous":
        return F.lit("deny")
    if actor == "system":
        return F.lit("permit")
    if actor == "patient":
        return F.when(own if own is not None else F.lit(False), "permit").otherwise("deny")
    closed = F.coalesce(confidentiality, F.lit("N")).isin(*RESTRICTED) | F.coalesce(sensitivity != "", F.lit(False))
    return F.when(closed, "deny").otherwise("permit")


def with_consent(df: DataFrame, consents: DataFrame, now: str) -> DataFrame:
    """df (patient, label, decision) with denials for labels lifted by an active permit that covers the label (null: all) and the time."""
    live = consents.filter((F.col("status") == "active") & (F.col("kind") == "permit") & (F.coalesce("start", F.lit("")) <= now) & (F.coalesce("end", F.lit("9999")) >= now))
    every = live.groupBy("patient").agg(F.collect_set("label").alias("labels"), F.max(F.col("label").isNull()).alias("all"))  # labels of one patient
    joined = df.join(every, "patient", "left")
    lifted = F.col("label").isNotNull() & (F.coalesce("all", F.lit(False)) | F.coalesce(F.array_contains("labels", F.col("label")), F.lit(False)))
    return joined.withColumn("decision", F.when((F.col("decision") == "deny") & lifted, "permit").otherwise(F.col("decision"))).drop("labels", "all")


def without_opt_out(patients: DataFrame, consents: DataFrame) -> DataFrame:
    """Patients without an active deny."""
    denied = consents.filter((F.col("status") == "active") & (F.col("kind") == "deny")).select(F.col("patient").alias("id"))
    return patients.join(denied, "id", "left_anti")


def opted_in(consents: DataFrame) -> DataFrame:
    """patient, allowed: a permit and no deny among the active consents."""
    live = consents.filter("status = 'active'")
    return live.groupBy("patient").agg((F.max(F.col("kind") == "permit") & ~F.max(F.col("kind") == "deny")).alias("allowed"))


def redact_body(body: str, blocked: set[str]) -> str:
    """A document without top-level fields that carry a blocked inline label; masked siblings and labels tell so."""
    doc = json.loads(body)
    labels = doc.setdefault("meta", {}).setdefault("security", [])
    hidden = [k for k, v in doc.items() if k not in ("meta", "id", "resourceType") and any(isinstance(x, dict) and blocked & {c.get("code") for e in x.get("extension", []) for c in [e.get("valueCoding", {})]} for x in (v if isinstance(v, list) else [v]))]
    for k in hidden:
        del doc[k]
        doc[f"_{k}"] = {"extension": [{"url": "http://hl7.org/fhir/StructureDefinition/data-absent-reason", "valueCode": "masked"}]}
    if hidden:
        labels.append({"system": "http://terminology.hl7.org/CodeSystem/v3-ObservationValue", "code": "REDACTED"})
    codes = {c.get("code") for c in labels}
    if codes & set(REDISCLOSED) and NO_REDISCLOSURE not in codes:
        labels.append({"system": ACT_CODE, "code": NO_REDISCLOSURE})
    if not labels:
        del doc["meta"]["security"]
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def redact(df: DataFrame, blocked: list[str]) -> DataFrame:
    """df with body_json redacted for a user."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bodies = [redact_body(x, set(blocked)) if x else x for x in b.column("body_json").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()) if c == "body_json" else b.column(c) for c in b.schema.names], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def provisions(consents: DataFrame) -> DataFrame:
    """patient, labels, actors, purposes, start, end of every permit inside active consents (patient, body_json), nested ones
    too; a nested one holds while all around it do. Empty lists cover everything."""

    def walk(batches):
        import pyarrow as pa

        lists = pa.list_(pa.string())
        schema = pa.schema([("patient", pa.string()), ("labels", lists), ("actors", lists), ("purposes", lists), ("start", pa.string()), ("end", pa.string())])
        for b in batches:
            out = []
            for patient, body in zip(b.column("patient").to_pylist(), b.column("body_json").to_pylist()):
                doc = json.loads(body) if body else {}
                todo = [(doc["provision"], "", "9999")] if doc.get("status") == "active" and doc.get("provision") else []
                while todo:
                    p, since, until = todo.pop()
                    period = p.get("period") or {}
                    since, until = max(since, period.get("start") or ""), min(until, period.get("end") or "9999")
                    codes = lambda k: [c["code"] for c in p.get(k) or [] if c.get("code")]  # noqa: E731, B023
                    if p.get("type") == "permit":
                        actors = [((a.get("reference") or {}).get("reference")) or "" for a in p.get("actor") or []]
                        out.append({"patient": patient, "labels": codes("securityLabel"), "actors": actors, "purposes": codes("purpose"), "start": since, "end": until})
                    todo += [(x, since, until) for x in p.get("provision") or []]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return consents.select("patient", "body_json").mapInArrow(walk, "patient string, labels array<string>, actors array<string>, purposes array<string>, start string, end string")


def with_provisions(df: DataFrame, permits: DataFrame, actor: str, ids: list[str], purpose: str | None, now: str) -> DataFrame:
    """df (id, patient, labels: what blocks it, decision) with denials lifted where a permit covers a label, the actor (a
    reference, or one that ends in one of its ids), the purpose and the time."""
    named = F.exists("actors", lambda a: (a == actor) | reduce(lambda x, y: x | y, [a.endswith(f"/{i}") for i in ids], F.lit(False)))
    for_purpose = F.array_contains("purposes", purpose) if purpose is not None else F.lit(False)
    live = permits.filter(((F.size("actors") == 0) | named) & ((F.size("purposes") == 0) | for_purpose) & (F.col("start") <= now) & (F.col("end") >= now))
    blocked = df.filter("decision = 'deny'").select("id", "patient", F.col("labels").alias("_own"))
    lifted = blocked.join(live, "patient").filter(((F.size("labels") == 0) & (F.size("_own") > 0)) | F.arrays_overlap("labels", "_own")).select("id").distinct()
    rows = df.join(lifted.withColumn("_lift", F.lit(True)), "id", "left")
    return rows.withColumn("decision", F.when(F.col("_lift"), "permit").otherwise(F.col("decision"))).select(*df.columns)


def visible(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, total) of a search under decisions: denied rows go, and the total counts what is left."""
    rows = found.filter("decision = 'permit'")
    return rows, rows.agg(F.count("*").alias("total"))
