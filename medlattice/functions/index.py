"""Search-index entries: array<struct<code, system, value>>, all strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = "array<struct<code:string,system:string,value:string>>"


def entry(code: str, value: Column, system: Column | str = "") -> Column:
    system = F.lit(system) if isinstance(system, str) else F.coalesce(system, F.lit(""))
    return F.struct(F.lit(code).alias("code"), system.cast("string").alias("system"), value.cast("string").alias("value"))


def token(code: str, value: Column, system: Column | str = "") -> Column:
    """A bare code, or a coding with its system."""
    return F.array(entry(code, value, system))


def codings(code: str, coding: Column) -> Column:
    """Every coding (array<struct<system, code>>) that has a code."""
    return F.transform(F.filter(coding, lambda c: c["code"].isNotNull()), lambda c: entry(code, c["code"], c["system"]))


def strings(code: str, *leaves: Column) -> Column:
    """Lower-cased leaf strings of a structure."""
    return F.array(*[entry(code, F.lower(x)) for x in leaves])


def dates(code: str, *values: Column) -> Column:
    """Bare values, or the start and the end of a period."""
    return F.array(*[entry(code, v) for v in values])


def number(code: str, value: Column) -> Column:
    return F.array(entry(code, value))


def uri(code: str, value: Column) -> Column:
    return F.array(entry(code, value))


def quantity(code: str, value: Column, system: Column | str = "", unit: Column | str | None = None) -> Column:
    """The value, with system, else unit, in the system's place."""
    if unit is not None:
        own = F.nullif(F.lit(system), F.lit("")) if isinstance(system, str) else system
        system = F.coalesce(own, F.lit(unit) if isinstance(unit, str) else unit)
    return F.array(entry(code, value, system))


def reference(code: str, ref: Column) -> Column:
    return F.array(entry(code, ref))


def search_index(*parts: Column) -> Column:
    """All entries of a resource; null and empty values are never indexed."""
    joined = reduce(lambda a, b: F.concat(a, b), list(parts))
    return F.filter(joined, lambda s: s["value"].isNotNull() & (s["value"] != ""))


def identifier_index(*pairs: tuple[Column | str, Column, str]) -> Column:
    """system, value, typeCode of each identifier that has a system or a value."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    rows = [F.struct(F.coalesce(lit(s), F.lit("")).alias("system"), F.coalesce(v.cast("string"), F.lit("")).alias("value"), F.lit(t).alias("typeCode")) for s, v, t in pairs]
    return F.filter(F.array(*rows), lambda i: (i["system"] != "") | (i["value"] != ""))


def uuid7_millis(value: Column) -> Column:
    """Milliseconds since 1970 inside a version 7 UUID."""
    return F.conv(F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")


def reference_type(ref: Column) -> Column:
    return F.split_part(ref, F.lit("/"), F.lit(1))


def reference_id(ref: Column) -> Column:
    return F.split_part(ref, F.lit("/"), F.lit(2))
