"""References between resources: chains, reverse chains, includes, compartments.

References are equi-joins on "Type/id"; nothing is capped and no id list is
collected: semi joins replace the lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlattice.functions.index import reference_id, reference_type
from medlattice.operators.lineage import cut
from medlattice.operators.search import current, search


def edges(df: DataFrame, code: str | None = None) -> DataFrame:
    """id, code, ref of every relative reference of a resource's index."""
    rows = df.select("id", F.explode("idx").alias("s")).select("id", F.col("s.code").alias("code"), F.col("s.value").alias("ref"))
    rows = rows.filter(F.col("ref").rlike(r"^[A-Za-z]+/[^/]"))
    return rows.filter(F.col("code") == code) if code else rows


def chained(df: DataFrame, code: str, target: DataFrame, target_kind: str, query: str) -> DataFrame:
    """Rows whose reference `code` points at a target that the query selects."""
    return chained_any(df, code, {target_kind: target}, [query])


def chained_any(df: DataFrame, code: str, targets: dict[str, DataFrame], queries: list[str]) -> DataFrame:
    """Rows whose reference `code` points at a target, of any of the types, that any of the queries selects."""
    hits = [search(t, kind, q, paged=False).select(F.concat(F.lit(f"{kind}/"), "id").alias("ref")) for kind, t in targets.items() for q in queries]
    if not hits:
        return current(df).filter("false")
    ids = edges(current(df), code).join(reduce(DataFrame.unionByName, hits), "ref", "left_semi").select("id")
    return current(df).join(ids, "id", "left_semi")


def has(df: DataFrame, kind: str, source: DataFrame | None, source_kind: str, code: str, query: str) -> DataFrame:
    """Rows that a source selected by the query refers to by `code`; none without the source's table."""
    if source is None:
        return current(df).filter("false")
    hits = edges(search(source, source_kind, query, paged=False), code).filter(reference_type(F.col("ref")) == kind)
    return current(df).join(hits.select(reference_id(F.col("ref")).alias("id")), "id", "left_semi")


def has_all(df: DataFrame, kind: str, sources: list[tuple[DataFrame | None, str, str, str]]) -> DataFrame:
    """Rows that meet every one of several reverse chains (source, its type, code, query)."""
    return reduce(lambda rows, s: has(rows, kind, *s), sources, current(df))


def include(found: DataFrame, code: str, target: DataFrame, target_kind: str) -> DataFrame:
    """Live target rows that the found rows refer to, once each."""
    refs = edges(found, code).filter(reference_type(F.col("ref")) == target_kind).select(reference_id(F.col("ref")).alias("id")).distinct()
    return target.filter(~F.col("deleted") & F.col("is_current")).join(refs, "id", "left_semi")


def include_iterate(found: DataFrame, steps: list[tuple[str, str, str]], tables: dict[str, DataFrame], kind: str, rounds: int = 5) -> DataFrame:
    """type, id of what is reached from the found rows of `kind` by (type, code, target) steps, at most `rounds` rounds.

    The found rows themselves are never included. Each round's frontier is written once, and an empty one ends it.
    """
    seen = cut(found.select(F.lit(kind).alias("type"), "id").distinct())
    matches, frontier = seen, {kind: found}
    for _ in range(rounds):
        parts = [include(frontier[source], code, tables[target], target).select(F.lit(target).alias("type"), "id") for source, code, target in steps if source in frontier]
        if not parts:
            break
        new = cut(reduce(DataFrame.unionByName, parts).distinct().join(seen, ["type", "id"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        frontier = {t: tables[t].join(new.filter(F.col("type") == t), "id", "left_semi") for t in {target for _, _, target in steps}}
    return seen.join(matches, ["type", "id"], "left_anti")


def revinclude(found: DataFrame, kind: str, source: DataFrame, code: str) -> DataFrame:
    """Rows of source whose `code` refers to a found row."""
    refs = found.select(F.concat(F.lit(f"{kind}/"), "id").alias("ref"))
    ids = edges(current(source), code).join(refs, "ref", "left_semi").select("id").distinct()
    return current(source).join(ids, "id", "left_semi")


def in_compartment(ref: str | Column, codes: list[str]) -> Column:
    return F.exists("idx", lambda s: s["code"].isin(codes) & (s["value"] == ref))


def compartment(df: DataFrame, codes: list[str], patients: DataFrame) -> DataFrame:
    """Current rows linked with any of a set of patients (id)."""
    refs = patients.select(F.concat(F.lit("Patient/"), "id").alias("ref")).distinct()
    rows = edges(current(df)).filter(F.col("code").isin(codes)).join(refs, "ref", "left_semi").select("id").distinct()
    return current(df).join(rows, "id", "left_semi")


def everything(patient: DataFrame, members: dict[str, tuple[DataFrame, list[str]]], patient_id: str, since: str | None = None, count: int = 50, offset: int = 0) -> DataFrame:
    """The patient and all members of the compartment: type, id, last_updated, in order of Type/id."""
    parts = [current(patient).filter(F.col("id") == patient_id).select(F.lit("Patient").alias("type"), "id", "last_updated")]
    parts += [current(df).filter(in_compartment(f"Patient/{patient_id}", codes)).select(F.lit(kind).alias("type"), "id", "last_updated") for kind, (df, codes) in members.items()]
    rows = reduce(DataFrame.unionByName, parts)
    if since:
        rows = rows.filter(F.col("last_updated") >= since)
    return rows.orderBy(F.concat_ws("/", "type", "id")).offset(offset).limit(count)


def export(tables: dict[str, tuple[DataFrame, list[str]]], kinds: list[str] | None = None, since: str | None = None, patients: DataFrame | None = None, opted_out: DataFrame | None = None) -> dict[str, DataFrame]:
    """Current rows of each type to export. tables: type -> (rows, codes of its links with patients).

    Without `patients` (id) all rows; with them, what belongs to these, but for those who opted out: an empty group gives
    no rows. `since` keeps rows updated from then on, `kinds` some types.
    """
    if patients is not None and opted_out is not None:
        patients = patients.join(opted_out.select("id"), "id", "left_anti")
    out = {}
    for kind, (df, codes) in tables.items():
        if kinds and kind not in kinds:
            continue
        rows = current(df) if patients is None else current(df).join(patients.select("id"), "id", "left_semi") if kind == "Patient" else compartment(df, codes, patients)
        out[kind] = rows.filter(F.col("last_updated") >= since) if since else rows
    return out
