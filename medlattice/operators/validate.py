"""Validation as columns: an array of issues for each row, and routing by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The public patterns of FHIR R4 primitive types.
FORMATS = {
    "date": r"^([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1]))?)?$",
    "dateTime": r"^([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1])(T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?(Z|(\+|-)((0[0-9]|1[0-3]):[0-5][0-9]|14:00)))?)?)?$",
    "instant": r"^([0-9]{4})-(0[1-9]|1[0-2])-(0[1-9]|[1-2][0-9]|3[0-1])T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?(Z|(\+|-)((0[0-9]|1[0-3]):[0-5][0-9]|14:00))$",
    "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?$",
    "code": r"^[^\s]+(\s[^\s]+)*$",
    "id": r"^[A-Za-z0-9\-.]{1,64}$",
    "oid": r"^urn:oid:[0-2](\.(0|[1-9][0-9]*))+$",
    "uuid": r"^urn:uuid:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}


def format_ok(value: Column, kind: str) -> Column:
    return F.coalesce(value.rlike(FORMATS[kind]), F.lit(True))


def required(name: str) -> Column:
    return F.when(F.col(name).isNull() | (F.col(name).cast("string") == ""), F.lit(f"required:{name}"))


def well_formed(name: str, kind: str) -> Column:
    return F.when(~format_ok(F.col(name), kind), F.lit(f"format:{name}"))


def invariant(key: str, holds: Column) -> Column:
    """A constraint; one that can't be evaluated passes."""
    return F.when(~F.coalesce(holds, F.lit(True)), F.lit(f"invariant:{key}"))


def unknown_elements(body: str, known: list[str]) -> Column:
    """Issues for root keys that are neither known nor siblings of known ones."""
    names = [*known, *[f"_{k}" for k in known]]
    return F.transform(F.filter(F.coalesce(F.json_object_keys(body), F.array()), lambda k: ~k.isin(names)), lambda k: F.concat(F.lit("unknown:"), k))


def slice_count(items: Column, path: str, value: str) -> Column:
    """Elements whose discriminator has a value."""
    return F.size(F.filter(items, lambda x: x[path] == value))


def with_issues(df: DataFrame, *checks: Column) -> DataFrame:
    return df.withColumn("issues", F.array_compact(F.array(*checks)))


def routed(df: DataFrame, pending: Column | None = None) -> DataFrame:
    """df with route: dead-letter, pending or accepted."""
    wait = F.coalesce(pending, F.lit(False)) if pending is not None else F.lit(False)
    return df.withColumn("route", F.when(F.size("issues") > 0, "dead-letter").when(wait, "pending").otherwise("accepted"))


def dead_letters(df: DataFrame) -> DataFrame:
    return df.filter("route = 'dead-letter'").select("id", F.substring(F.array_join("issues", ";"), 1, 1500).alias("error"))
