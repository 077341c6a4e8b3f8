"""The search language: conditions over a row's own index array, sort, paging.

Every condition is an `exists` over the index array of the row, so a search is
one scan without a join or an aggregate; conditions are joined by AND, each on
its own, also when one entry meets several of them. Values enter as literals.
Dates compare as strings. Missing sort keys come last in both directions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = ("eq", "ne", "gt", "lt", "ge", "le", "sa", "eb", "ap")
CONTROL = {"_sort", "_count", "_offset", "_summary", "_elements", "_include", "_revinclude", "_has", "_total"}
KINDS = {"token", "string", "date", "number", "quantity", "uri", "reference"}
UNSUPPORTED_TOKEN = {"in", "not-in", "below", "above", "of-type", "text"}
#: resource type -> parameter -> kind
REGISTRY: dict[str, dict[str, str]] = {
    "Patient": {"family": "string", "gender": "token", "identifier": "token", "segment": "token", "balance": "number", "profile": "uri"},
    "Encounter": {"status": "token", "class": "token", "date": "date", "subject": "reference"},
    "Observation": {"code": "token", "date": "date", "value-quantity": "quantity", "performer": "reference", "encounter": "reference"},
    "Organization": {"name": "string", "balance": "number"},
}


@dataclass(frozen=True)
class Condition:
    code: str
    kind: str
    value: str | list[str]
    modifier: str = ""
    prefix: str = ""


class SearchError(ValueError):
    pass


def _int(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None else default
    except ValueError:
        return default


def split_prefix(value: str) -> tuple[str, str]:
    return (value[:2], value[2:]) if value[:2] in PREFIXES else ("", value)


def parse(kind: str, query: str, strict: bool = False, registry: dict | None = None) -> tuple[list[Condition], dict]:
    """Conditions and control parameters of a query string. Unknown parameters and control parameters are ignored, or rejected
    if strict, and so are modifiers that the index can't serve, which otherwise match plainly. A known parameter of a
    type that can't be searched is always rejected: leaving it out would widen the result."""
    conditions, control, wrong, never = [], {}, [], []
    known = (registry or REGISTRY).get(kind, {})
    for key, value in parse_qsl(query, keep_blank_values=True):
        name, _, modifier = key.partition(":")
        if name in CONTROL:
            control.setdefault(name, value)
        elif name in ("_id", "_lastUpdated"):
            conditions.append(Condition(name, name, value, modifier, split_prefix(value)[0] if name == "_lastUpdated" else ""))
        elif name not in known:
            if "." not in name:  # chains are another operator's
                wrong.append(key)
        elif known[name] not in KINDS:
            never.append(f"{name} ({known[name]})")
        elif modifier in UNSUPPORTED_TOKEN:
            wrong.append(key)
            prefix, rest = split_prefix(value) if known[name] in ("date", "number", "quantity") else ("", value)
            conditions.append(Condition(name, known[name], rest, "", prefix))
        elif known[name] in ("date", "number", "quantity") and modifier != "missing":
            prefix, rest = split_prefix(value)
            conditions.append(Condition(name, known[name], rest, modifier, prefix))
        else:
            conditions.append(Condition(name, known[name], value, modifier))
    if "," in control.get("_sort", "") and strict:
        wrong.append("_sort")
    if never or (strict and wrong):
        raise SearchError("unsupported: " + ", ".join(never + (wrong if strict else [])))
    return conditions, control


def _ordered(left: Column, right, prefix: str) -> Column:
    right = F.lit(right)
    return {"gt": left > right, "sa": left > right, "lt": left < right, "eb": left < right, "ge": left >= right, "le": left <= right, "ne": left != right}.get(prefix, left == right)


def _matches(c: Condition, s: Column) -> Column:
    v, value = s["value"], c.value
    if isinstance(value, list):
        return v.isin(value) if value else F.lit(False)
    if c.kind == "string":
        low = value.lower()
        if c.modifier == "exact":
            return v == low
        bare = re.sub("[%_]", "", low)
        return v.contains(F.lit(bare)) if c.modifier == "contains" else v.startswith(F.lit(bare))
    if c.kind == "date":
        return v.startswith(F.lit(value)) if c.prefix in ("", "eq", "ap") else _ordered(v, value, c.prefix)
    if c.kind in ("number", "quantity"):
        amount, *rest = value.split("|")
        try:
            met = _ordered(v.try_cast("double"), float(amount), c.prefix)
        except ValueError:
            return F.lit(False)
        return met & (s["system"] == rest[0]) if rest and rest[0] else met
    if c.kind == "reference":
        if re.match(r"^[A-Za-z]+/.+", value) or ":" in value:
            return v == value
        return (v == value) | v.endswith(F.lit("/" + value))
    if c.kind == "token":
        system, bar, code = value.partition("|")
        if bar and system and code:
            return (v == code) & (s["system"] == system)
        return v.isin(value.split(",")) if "," in value and not bar else v == value
    return v == value


def predicate(c: Condition, idx: str = "idx") -> Column:
    if c.kind == "_id":
        return F.col("id").isin(c.value if isinstance(c.value, list) else [c.value])
    if c.kind == "_lastUpdated":
        prefix, rest = split_prefix(c.value)
        return F.col("last_updated").startswith(rest) if prefix in ("", "eq", "ap") else _ordered(F.col("last_updated"), rest, prefix)
    here = lambda s: s["code"] == c.code
    if c.modifier == "missing":
        present = F.exists(idx, here)
        return ~present if c.value == "true" else present
    met = F.exists(idx, lambda s: here(s) & F.coalesce(_matches(c, s), F.lit(False)))
    return ~met if c.modifier == "not" else met


def current(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_current") & ~F.col("deleted"))


def matching(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    for c in conditions:
        df = df.filter(predicate(c))
    return df


def sort_key(kind: str, code: str, idx: str = "idx") -> Column:
    """The least value of a parameter; number and quantity compare as numbers."""
    values = F.transform(F.filter(idx, lambda s: s["code"] == code), lambda s: s["value"])
    if REGISTRY[kind].get(code) in ("number", "quantity"):
        values = F.transform(values, lambda v: v.try_cast("double"))
    return F.array_min(values)


def page(df: DataFrame, kind: str, control: dict) -> DataFrame:
    """Sorted and cut; the sort with a limit plans as a top-k without a full sort."""
    field = control.get("_sort", "-_lastUpdated").split(",")[0]
    down, name = field.startswith("-"), field.lstrip("-")
    key = sort_key(kind, name) if name in REGISTRY.get(kind, {}) else F.col("last_updated")
    order = [key.desc_nulls_last(), F.col("id").desc()] if down else [key.asc_nulls_last(), F.col("id").asc()]
    count, offset = min(1000, max(0, _int(control.get("_count"), 50))), max(0, _int(control.get("_offset"), 0))
    return df.orderBy(*order).offset(offset).limit(count)


def search(df: DataFrame, kind: str, query: str, strict: bool = False, paged: bool = True) -> DataFrame:
    """Rows of df (id, last_updated, idx, is_current, deleted, ...) that a query string selects."""
    conditions, control = parse(kind, query, strict)
    found = matching(current(df), conditions)
    return page(found, kind, control) if paged else found


def total(df: DataFrame, kind: str, query: str) -> DataFrame:
    return search(df, kind, query, paged=False).agg(F.count("*").alias("total"))
