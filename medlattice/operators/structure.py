"""Structural validation of documents by the columns of their type, the boundary check, and reconciling of waiting ones."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from medlattice.functions.schema import Field, Schemas
from medlattice.operators.validate import FORMATS

#: Elements that any object may have.
ANYWHERE = frozenset("resourceType id meta implicitRules language text contained extension modifierExtension fhir_comments".split())
_CHECKS = {k: re.compile(v.replace("$", r"\Z")) for k, v in FORMATS.items()}
_KINDS = {"boolean": (bool,), "int": (int, float), "double": (int, float), "string": (str,)}


def _scalar(value, f: Field, path: str) -> list[str]:
    if not isinstance(value, _KINDS[f.spark]) or (f.spark != "boolean" and isinstance(value, bool)):
        return [f"kind:{path}"]
    check = _CHECKS.get(f.type)
    return [f"format:{path}"] if check and isinstance(value, str) and not check.match(value) else []


def structure_issues(doc, fields: tuple[Field, ...], kind: str) -> list[str]:
    """Issues at every depth: unknown, required, list, single, kind, object and format, each with its path."""
    out: list[str] = []
    todo = [(doc, fields, kind)]
    while todo:
        node, known, path = todo.pop()
        names = {f.name for f in known} | ANYWHERE
        out += [f"unknown:{path}.{k}" for k in node if k not in names and not (k.startswith("_") and k[1:] in names)]
        for f in known:
            at, value = f"{path}.{f.name}", node.get(f.name)
            if value is None:
                out += [f"required:{at}"] if f.required else []
                continue
            if isinstance(value, list) != f.many:
                out.append(f"{'list' if f.many else 'single'}:{at}")
                continue
            if f.required and value == []:
                out.append(f"empty:{at}")
            for n, item in enumerate(value if f.many else [value]):
                where = f"{at}[{n}]" if f.many else at
                if f.kind == "scalar":
                    out += _scalar(item, f, where)
                elif f.kind == "struct":
                    if isinstance(item, dict):
                        todo.append((item, f.fields, where))
                    else:
                        out.append(f"object:{where}")
    return sorted(out)


def issues(body: Column, schemas: Schemas) -> Column:
    """array<string>: a document of an unknown type has that one issue, one that isn't an object too."""
    fields = {k: schemas.of(k) for k in schemas.definitions if schemas.definitions[k].get("kind", "resource") == "resource"}

    @pandas_udf(T.ArrayType(T.StringType()))
    def of(bodies):
        def one(text):
            try:
                doc = json.loads(text) if text else None
            except ValueError:
                doc = None
            if not isinstance(doc, dict):
                return ["object:"]
            kind = doc.get("resourceType")
            return structure_issues(doc, fields[kind], kind) if kind in fields else [f"unknown-type:{kind}"]

        return bodies.map(one)

    return of(body)


def boundary(body: Column, kind: Column | str) -> Column:
    """Why a document can't enter by the route of a type: not an object, no type, an id that is no text, another type; null if it can."""
    doc = F.try_parse_json(body)
    at = lambda p: F.schema_of_variant(F.try_variant_get(doc, p, "variant"))
    named = F.get_json_object(body, "$.resourceType")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return (
        F.when(doc.isNull() | ~F.schema_of_variant(doc).startswith("OBJECT"), "not-an-object")
        .when((F.coalesce(at("$.resourceType"), F.lit("")) != "STRING") | (named == ""), "no-type")
        .when(F.coalesce(at("$.id"), F.lit("VOID")).isin("STRING", "VOID") == F.lit(False), "bad-id")
        .when(named != kind, "other-type")
    )


def reconcile(pending: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, dead, waiting) of waiting documents by their outcome (id, outcome: ok, invalid or pending) once more; without one they wait."""
    rows = pending.join(outcomes.select("id", "outcome"), "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("pending")))
    return tuple(rows.filter(F.col("outcome") == o).drop("outcome") for o in ("ok", "invalid", "pending"))
