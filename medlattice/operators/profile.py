"""Rules of profiles over whole documents, and projections of documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_BASE = ("resourceType", "id", "meta")


def requirements(definition: dict) -> list[str]:
    """Paths, without the type, of a StructureDefinition's elements with min > 0; those of slices are left to slice rules."""
    elements = (definition.get("snapshot") or definition.get("differential") or {}).get("element", [])
    return [e["path"].split(".", 1)[1] for e in elements if e.get("min", 0) > 0 and "." in e["path"] and ":" not in e.get("id", "")]


def slice_rules(definition: dict) -> list[tuple[str, str, str, str, int]]:
    """(path, slice, discriminator, value, min) of required slices that a scalar fixed or pattern value tells apart."""
    elements = (definition.get("snapshot") or definition.get("differential") or {}).get("element", [])
    least = {e["id"]: e["min"] for e in elements if e.get("sliceName") and e.get("min", 0) > 0}
    out = []
    for e in elements:
        top, _, rest = e.get("id", "").rpartition(":")
        name, _, inner = rest.partition(".")
        if top and inner and f"{top}:{name}" in least:
            for k, v in e.items():
                if k.startswith(("fixed", "pattern")) and isinstance(v, (str, int, bool)):
                    out.append((top.split(".", 1)[1], name, inner, v, least[f"{top}:{name}"]))
    return out


def _children(node, name: str) -> list:
    if not isinstance(node, dict):
        return []
    if name.endswith("[x]"):
        stem = name[:-3]
        got = [v for k, v in node.items() if k.startswith(stem) and k[len(stem) :][:1].isupper()]
    else:
        got = [node[name]] if name in node else []
    return [x for v in got for x in (v if isinstance(v, list) else [v]) if x not in (None, "", {}, [])]


def _at(doc, path: str) -> list:
    nodes = [doc]
    for name in path.split(".") if path else []:
        nodes = [x for n in nodes for x in _children(n, name)]
    return nodes


def missing(body: str | None, paths: list[str]) -> list[str]:
    """Issues for required elements; one is missing where its parent is there without it."""
    doc = json.loads(body) if body else {}
    out = []
    for path in paths:
        parent, _, name = path.rpartition(".")
        if any(not _children(n, name) for n in _at(doc, parent)):
            out.append(f"required:{path}")
    return out


def short_slices(body: str | None, rules: list[tuple[str, str, str, str, int]]) -> list[str]:
    doc = json.loads(body) if body else {}
    return [f"slice:{path}:{name}" for path, name, inner, value, least in rules if sum(value in _at(x, inner) for x in _at(doc, path)) < least]


def profile_issues(body: Column, definitions: list[dict], declared: bool = False) -> Column:
    """Issues of documents under profiles; `declared`: only under those that meta.profile names."""
    rules = [(d.get("url"), requirements(d), slice_rules(d)) for d in definitions]

    @pandas_udf(T.ArrayType(T.StringType()))
    def issues(bodies):
        def of(b):
            named = {p.split("|")[0] for p in (json.loads(b).get("meta") or {}).get("profile") or []} if declared and b else ()
            return [i for url, paths, slices in rules if not declared or url in named for i in (*missing(b, paths), *short_slices(b, slices))]

        return bodies.map(of)

    return issues(body)


def elements(body: Column, names: list[str]) -> Column:
    """Documents with these top-level fields and id, meta and resourceType only; `_summary=text` is elements(body, ["text"])."""
    keep = {*_BASE, *names}

    @pandas_udf(T.StringType())
    def of(bodies):
        return bodies.map(lambda b: json.dumps({k: v for k, v in json.loads(b).items() if k in keep}, ensure_ascii=False, separators=(",", ":")) if b else b)

    return of(body)


def stamp(body: Column, id_: Column, version: Column, updated: Column) -> Column:
    """Documents with their id, meta.versionId and meta.lastUpdated set; the rest of meta stays."""

    @pandas_udf(T.StringType())
    def of(bodies, ids, versions, times):
        def one(b, i, v, t):
            doc = json.loads(b)
            return json.dumps(doc | {"id": i, "meta": (doc.get("meta") or {}) | {"versionId": str(v), "lastUpdated": t}}, ensure_ascii=False, separators=(",", ":"))

        return type(bodies)([one(*x) if x[0] else x[0] for x in zip(bodies, ids, versions, times)])

    return of(body, id_, version, updated)


def submitted(claims: DataFrame, now: str) -> DataFrame:
    """A pended response for each claim (id, patient, insurer, use): prior authorisation is decided later."""
    return claims.select(
        F.concat(F.lit("resp-"), "id").alias("id"), F.lit("active").alias("status"), F.coalesce("use", F.lit("preauthorization")).alias("use"), F.lit("queued").alias("outcome"), "patient", "insurer",
        F.concat(F.lit("Claim/"), "id").alias("request"), F.lit(now).alias("created"),
    )


def inquired(responses: DataFrame, patient: str | None = None, request: str | None = None) -> DataFrame:
    """Responses to prior authorisations of a patient or to one claim."""
    rows = responses.filter("use = 'preauthorization'")
    for c, v in (("patient", patient), ("request", request)):
        rows = rows.filter(F.col(c) == v) if v is not None else rows
    return rows
