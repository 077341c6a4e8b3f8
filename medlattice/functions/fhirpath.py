"""A subset of FHIRPath compiled to Columns over structures, and search-index entries by it.

Paths, unions, `where(path = 'text')`, `ofType(T)`, `as(T)` and `(path as T)`, `first()`, `exists()`, `empty()`, `count()`,
`not()`, `hasValue()`, comparisons, `and`, `or`, `implies`. A value is a collection: an array Column with the element's
field; a choice element gives one for each of its types. What isn't in the subset raises Unsupported, and callers
skip the parameter or let the invariant pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlattice.functions.index import codings, entry, search_index
from medlattice.functions.schema import Field, Schemas, parsed


class Unsupported(ValueError):
    pass


@dataclass(frozen=True)
class Values:
    """An array Column of elements of one field."""

    items: Column
    field: Field


_TOKEN = re.compile(r"\s*('(?:[^'\\]|\\.)*'|\d+(?:\.\d+)?|[A-Za-z_][A-Za-z0-9_]*|!=|<=|>=|[().|=<>,])")
_BOOLEAN = Field("", "boolean", False, False, "boolean")


class Compiler:
    """Recursive descent over tokens; `root` is the structure's Column and `field` its type."""

    def __init__(self, text: str, root: Column, field: Field):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unsupported(text)
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.text = 0, text
        self.here = [Values(F.array(root), field)]

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if got is None or (wanted is not None and got != wanted):
            raise Unsupported(self.text)
        self.at += 1
        return got

    def whole(self):
        out = self.implies()
        if self.peek() is not None:
            raise Unsupported(self.text)
        return out

    def implies(self):
        left = self.either()
        while self.peek() == "implies":
            self.take()
            right = self.either()
            left = ~truth(left) | truth(right)
        return left

    def either(self):
        left = self.both()
        while self.peek() == "or":
            self.take()
            right = self.both()
            left = truth(left) | truth(right)
        return left

    def both(self):
        left = self.compared()
        while self.peek() == "and":
            self.take()
            right = self.compared()
            left = truth(left) & truth(right)
        return left

    def compared(self):
        left = self.union()
        if (op := self.peek()) in ("=", "!=", "<", ">", "<=", ">="):
            self.take()
            a, b = single(left), single(self.union())
            return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        return left

    def union(self):
        left = self.cast()
        while self.peek() == "|":
            self.take()
            right = self.cast()
            if not isinstance(left, list) or not isinstance(right, list):
                raise Unsupported(self.text)
            left = left + right
        return left

    def cast(self):
        left = self.path()
        while self.peek() in ("as", "is"):
            if self.take() == "is":
                raise Unsupported(self.text)
            left = of_type(left, self.take())
        return left

    def path(self):
        token = self.take()
        if token == "(":
            now = self.implies()
            self.take(")")
        elif token.startswith("'"):
            return F.lit(re.sub(r"\\(.)", r"\1", token[1:-1]))
        elif token[0].isdigit():
            return F.lit(float(token))
        elif token in ("true", "false"):
            return F.lit(token == "true")
        elif self.peek() == "(":
            now = self.call(self.here, token)
        elif token == self.here[0].field.name and token[:1].isupper():
            now = self.here
        elif token[:1].isupper() and token not in {f.name for f in self.here[0].field.fields}:
            raise Unsupported(self.text)
        else:
            now = child(self.here, token)
        while self.peek() == ".":
            self.take()
            name = self.take()
            now = self.call(now, name) if self.peek() == "(" else child(now, name)
        return now

    def condition(self, field: Field, start: int):
        """The condition that begins at a token, for elements of a field."""

        def holds(x):
            kept, self.at, self.here = self.here, start, [Values(F.array(x), field)]
            try:
                return F.coalesce(truth(self.implies()), F.lit(False))
            finally:
                self.here = kept

        return holds

    def call(self, now, name: str):
        self.take("(")
        if name in ("ofType", "as"):
            kind = self.take()
            self.take(")")
            return of_type(now, kind)
        if name in ("where", "exists", "all") and self.peek() != ")":
            start, out = self.at, []
            for v in collection(now, self.text):
                holds = self.condition(v.field, start)
                out.append(Values(F.filter(v.items, holds), v.field) if name != "all" else F.forall(v.items, holds))
            self.take(")")
            return out if name == "where" else present(out) if name == "exists" else reduce(lambda a, b: a & b, out)
        self.take(")")
        if name == "exists":
            return present(now)
        if name == "hasValue":
            return present(now)
        if name == "empty":
            return ~present(now)
        if name == "not":
            return ~truth(now)
        if name == "count":
            return reduce(lambda a, b: a + b, [F.size(v.items) for v in collection(now, self.text)])
        if name == "first":
            return [Values(F.slice(v.items, 1, 1), v.field) for v in collection(now, self.text)]
        raise Unsupported(f"{self.text}: {name}()")


def _get(name: str):
    return lambda x: x[name]


def _or_none(kind: str):
    return lambda x: F.coalesce(x, F.array().cast(kind))


def collection(now, text: str = "") -> list[Values]:
    if not isinstance(now, list):
        raise Unsupported(text)
    return now


def present(now) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.size(v.items) > 0, F.lit(False)) for v in now]) if isinstance(now, list) else now.isNotNull()


def truth(now) -> Column:
    """A collection as a condition: its boolean, or whether it has items."""
    if not isinstance(now, list):
        return now
    return single(now) if len(now) == 1 and now[0].field.type == "boolean" else present(now)


def single(now) -> Column:
    if not isinstance(now, list):
        return now
    scalars = [v for v in now if v.field.spark]
    if len(scalars) != 1:
        raise Unsupported("a comparison needs one scalar")
    return F.get(scalars[0].items, 0)


def child(now, name: str) -> list[Values]:
    """Elements of a name; of a choice element those of every type."""
    out = []
    for v in collection(now, name):
        found = [f for f in v.field.fields if f.name == name] or [f for f in v.field.fields if re.fullmatch(re.escape(name) + "[A-Z].*", f.name) and f.name[len(name) :].lower() == f.type.lower()]
        for f in found:
            items = F.transform(v.items, _get(f.name))
            if f.many:
                items = F.flatten(F.transform(items, _or_none(f.ddl())))
            out.append(Values(F.filter(_or_none(f.ddl() if f.many else f"array<{f.ddl()}>")(items), lambda x: x.isNotNull()), f))
    if not out:
        raise Unsupported(name)
    return out


def of_type(now, kind: str) -> list[Values]:
    got = [v for v in collection(now, kind) if v.field.type.lower() == kind.lower()]
    if not got:
        raise Unsupported(kind)
    return got


def compiled(text: str, root: Column, field: Field):
    """A list of Values, or a Column of a condition."""
    return Compiler(text, root, field).whole()


def _leaves(x: Column, field: Field) -> list[Column]:
    """Arrays of the strings inside a structure, but for ids."""
    if field.spark:
        return [F.array(x.cast("string"))] if field.spark == "string" else []
    out = []
    for f in field.fields:
        if f.name == "id" or f.kind == "json":
            continue
        if f.many:
            out.append(_or_none("array<string>")(F.flatten(F.transform(x[f.name], _all_leaves(_whole(f))))))
        else:
            out += _leaves(x[f.name], f)
    return out


def _all_leaves(field: Field):
    return lambda x: F.flatten(F.array(*(_leaves(x, field) or [F.array().cast("array<string>")])))


def _whole(field: Field) -> Field:
    return Field(field.name, field.type, False, False, field.spark, field.fields, field.binding)


def entries(code: str, kind: str, v: Values) -> Column:
    """Index entries of one parameter from elements of one type; None where the type has none of this kind."""
    each = lambda f: F.transform(v.items, f)
    t, scalar = v.field.type, v.field.spark is not None
    has = lambda n: v.field.get(n) is not None
    none = F.array().cast("array<struct<code:string,system:string,value:string>>")
    if kind == "token":
        if t == "CodeableConcept" and has("coding"):
            return F.flatten(each(lambda x: F.coalesce(codings(code, x["coding"]), none)))
        if t in ("Coding", "Identifier", "ContactPoint") or (has("system") and (has("code") or has("value"))):
            value = "code" if t == "Coding" or not has("value") else "value"
            return each(lambda x: entry(code, x[value], x["system"]))
        return each(lambda x: entry(code, x)) if scalar else none
    if kind == "string":
        return F.flatten(each(lambda x: F.transform(_all_leaves(_whole(v.field))(x), lambda s: entry(code, F.lower(s)))))
    if kind == "date":
        if scalar:
            return each(lambda x: entry(code, x))
        if t == "Period":
            return F.flatten(each(lambda x: F.array(entry(code, x["start"]), entry(code, x["end"]))))
        if t == "Timing":
            bounds = (v.field.get("repeat") or Field("", "", False, False, None)).get("boundsPeriod")
            event = (lambda x: F.transform(F.coalesce(x["event"], F.array().cast("array<string>")), lambda e: entry(code, e))) if has("event") else lambda x: none
            limits = (lambda x: F.array(entry(code, x["repeat"]["boundsPeriod"]["start"]), entry(code, x["repeat"]["boundsPeriod"]["end"]))) if bounds and bounds.fields else lambda x: none
            return F.flatten(each(lambda x: F.concat(event(x), limits(x))))
        return none
    if kind in ("number", "uri"):
        return each(lambda x: entry(code, x)) if scalar else none
    if kind == "quantity":
        return each(lambda x: entry(code, x["value"], F.coalesce(x["system"], x["unit"]))) if has("value") else none
    if kind == "reference":
        return each(lambda x: entry(code, x["reference"])) if has("reference") else none
    return none


def registry(parameters: list[dict], profiles: list[dict] = ()) -> dict[str, dict[str, dict]]:
    """type -> code -> {type, expression, target} of SearchParameter documents; composite and special ones are left out.

    A parameter of several types keeps the parts of its expression that start with each. Core ones win over profiles'.
    """
    out: dict[str, dict[str, dict]] = {}
    for p in [*profiles, *parameters]:
        if p.get("type") in ("composite", "special") or not p.get("expression"):
            continue
        parts = [x.strip() for x in re.split(r"\|(?![^()]*\))", p["expression"])]
        for base in p.get("base", []):
            own = [x for x in parts if re.match(rf"\(*{base}\b", x)]
            if own:
                out.setdefault(base, {})[p["code"]] = {"type": p["type"], "expression": " | ".join(own), "target": p.get("target", [])}
    return out


def index(known: dict[str, dict[str, dict]], schemas: Schemas, kind: str, root: Column) -> Column:
    """The search index of a type's documents; parameters that can't be compiled are skipped."""
    parts = []
    for code, p in known.get(kind, {}).items():
        try:
            values = collection(compiled(p["expression"], root, schemas.root(kind)), p["expression"])
            parts += [F.coalesce(entries(code, p["type"], v), F.array().cast("array<struct<code:string,system:string,value:string>>")) for v in values]
        except Unsupported:
            continue
    return search_index(*parts) if parts else F.array().cast("array<struct<code:string,system:string,value:string>>")


def with_index(df: DataFrame, known: dict[str, dict[str, dict]], schemas: Schemas, kind: str) -> DataFrame:
    """df (body_json, ...) with idx."""
    return parsed(df, schemas, kind).withColumn("idx", index(known, schemas, kind, F.col("r"))).drop("r")


def index_rows(df: DataFrame, known: dict[str, dict[str, dict]], schemas: Schemas, kind: str, *keep: str) -> DataFrame:
    """The columns kept of df (body_json, ...) and code, system, value: one row for each entry of the index.

    The outer generator has no filter on its array inferred; that one would be pushed below the parsing, where each document
    is parsed again for each parameter.
    """
    return with_index(df, known, schemas, kind).select(*keep, F.inline_outer("idx")).filter("code is not null")


def invariants(rules: list[dict], schemas: Schemas, kind: str, root: Column) -> list[Column]:
    """An issue for each constraint {key, expression} that fails on the root; one that can't be compiled passes."""
    out = []
    for rule in rules:
        try:
            holds = truth(compiled(rule["expression"], root, schemas.root(kind)))
        except Unsupported:
            continue
        out.append(F.when(~F.coalesce(holds, F.lit(True)), F.lit(f"invariant:{rule['key']}")))
    return out
