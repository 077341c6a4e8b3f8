"""Columns of resource types, from their structure definitions, and flattening by them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 3
#: The type of a column for each primitive type.
PRIMITIVES = {
    "boolean": "boolean", "integer": "int", "positiveInt": "int", "unsignedInt": "int", "decimal": "double", "string": "string", "code": "string", "uri": "string", "url": "string", "canonical": "string", "oid": "string",
    "uuid": "string", "id": "string", "markdown": "string", "base64Binary": "string", "date": "string", "dateTime": "string", "instant": "string", "time": "string", "xhtml": "string",
}
#: Types that stay text, and root elements that are no columns.
OPEN = frozenset({"Resource", "Extension", "Narrative"})
NOT_AT_ROOT = frozenset("id meta implicitRules language text contained extension modifierExtension".split())


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # of the element, like CodeableConcept
    many: bool
    required: bool
    spark: str | None  # of a primitive; None for structures and open types
    fields: tuple[Field, ...] = ()  # of a structure
    binding: str | None = None

    @property
    def kind(self) -> str:
        return "scalar" if self.spark else "struct" if self.fields else "json"

    def ddl(self) -> str:
        one = self.spark or (f"struct<{','.join(f'`{f.name}`:{f.ddl()}' for f in self.fields)}>" if self.fields else "string")
        return f"array<{one}>" if self.many else one

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


class Schemas:
    """Columns by resource type; definitions: type -> StructureDefinition with a snapshot."""

    def __init__(self, definitions: Mapping[str, dict], depth: int = MAX_DEPTH):
        self.definitions, self.depth, self._done = definitions, depth, {}
        self._children: dict[str, dict[str, list[dict]]] = {}

    def _below(self, kind: str, path: str) -> list[dict]:
        if kind not in self._children:
            by: dict[str, list[dict]] = {}
            for e in self.definitions[kind]["snapshot"]["element"]:
                by.setdefault(e["path"].rpartition(".")[0], []).append(e)
            self._children[kind] = by
        return self._children[kind].get(path, [])

    def of(self, kind: str) -> tuple[Field, ...]:
        """Columns of a resource type; KeyError for a type without a definition."""
        if kind not in self._done:
            found = self._fields(kind, kind, 0)
            self._done[kind] = tuple(f for f in found if f.name.removeprefix("_") not in NOT_AT_ROOT)
        return self._done[kind]

    def root(self, kind: str) -> Field:
        return Field(kind, kind, False, False, None, (Field("id", "id", False, False, "string"), *self.of(kind)))

    def ddl(self, kind: str) -> str:
        return ", ".join(f"`{f.name}` {f.ddl()}" for f in self.root(kind).fields)

    def _inner(self, kind: str, path: str, depth: int) -> tuple[Field, ...]:
        return self._fields(kind, path, depth + 1) if depth + 1 < self.depth else ()

    def _fields(self, kind: str, path: str, depth: int) -> tuple[Field, ...]:
        out = []
        for e in self._below(kind, path):
            name, types = e["path"].rpartition(".")[2], [t["code"] for t in e.get("type", [])]
            many, needed = e.get("max") not in (None, "0", "1"), e.get("min", 0) >= 1
            if target := e.get("contentReference"):
                out.append(Field(name, "BackboneElement", many, needed, None, self._inner(kind, target.lstrip("#"), depth)))
            elif types and self._below(kind, e["path"]):
                out.append(Field(name, types[0], many, needed, None, self._inner(kind, e["path"], depth)))
            else:
                choice, bound = name.endswith("[x]"), e.get("binding") or {}
                strict = bound.get("valueSet", "").split("|")[0] if bound.get("strength") == "required" else None
                for t in types:
                    own = name[:-3] + t[:1].upper() + t[1:] if choice else name
                    spark = PRIMITIVES.get(t)
                    inner = () if spark or t in OPEN or t not in self.definitions else self._inner(t, t, depth)
                    coded = strict if not choice and t in ("code", "Coding", "CodeableConcept") else None
                    out.append(Field(own, t, many, needed and not choice, spark, inner, coded or None))
                    if spark and not choice:
                        out.append(Field(f"_{own}", "Element", many, False, None))
        return tuple(out)


def parsed(df: DataFrame, schemas: Schemas, kind: str, body: str = "body_json") -> DataFrame:
    """df with r: the documents as structures; open types, and what lies deeper than the schemas, are JSON text."""
    return df.withColumn("r", F.from_json(body, schemas.ddl(kind)))


def flatten(df: DataFrame, schemas: Schemas, kind: str, governance: tuple[str, ...] = (), body: str = "body_json") -> DataFrame:
    """The governance columns of df and one column for each element of the type."""
    rows = parsed(df.select(*governance, body), schemas, kind, body)
    return rows.select(*governance, *[F.col(f"r.`{f.name}`").alias(f.name) for f in schemas.of(kind) if f.name not in governance])


def without_null_columns(df: DataFrame) -> DataFrame:
    """df without the columns that are null in every row; one pass."""
    seen = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for k, c in enumerate(df.columns) if seen[k] is not False])
