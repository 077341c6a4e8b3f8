"""Entity resolution of persons by shared identifiers, and reference rewriting."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from medlattice.operators.lineage import cut

SSN = "http://hl7.org/fhir/sid/us-ssn"
DEATH_DAYS = 14


def normal_key(system: Column, value: Column) -> Column:
    """system|value: scheme and host in lower case, no trailing slash; white space of the value collapsed, an SSN's digits only. Null for a blank value."""
    s = F.trim(F.coalesce(system, F.lit("")))
    head, rest = F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    s = F.regexp_replace(F.when(head != "", F.concat(F.lower(head), rest)).otherwise(s), "/$", "")
    v = F.regexp_replace(F.trim(value), r"\s+", " ")
    v = F.when(s == SSN, F.regexp_replace(v, "[^0-9]", "")).otherwise(v)
    return F.when(F.coalesce(v, F.lit("")) != "", F.concat_ws("|", s, v))


def identifier_keys(people: DataFrame) -> DataFrame:
    """id, key, ssn (digits or null), one row for each identifier of the candidates: live and active."""
    live = people.filter(~F.col("deleted") & F.coalesce("active", F.lit(True)))
    ssn = F.element_at(F.transform(F.filter("identifiers", lambda i: i["system"] == SSN), lambda i: F.regexp_replace(i["value"], "[^0-9]", "")), 1)
    own = live.select("id", F.when(F.exists("identifiers", lambda i: i["system"] == SSN), ssn).alias("ssn"), F.explode("identifiers").alias("i"))
    return own.select("id", "ssn", normal_key(F.col("i.system"), F.col("i.value")).alias("key")).filter("key is not null").distinct()


def links(keys: DataFrame) -> DataFrame:
    """u, v: links that connect all who share a key unless their SSNs differ.

    Everybody meets the key's least holder without an SSN, who conflicts with nobody; in a key where all have one,
    those with the same SSN meet. So a key of n holders gives n links, not n * n. The keys are written once, as they are joined to
    their own aggregates.
    """
    keys = cut(keys)
    free = keys.groupBy("key").agg(F.min(F.when(F.col("ssn").isNull(), F.col("id"))).alias("free"))
    same = keys.groupBy("key", "ssn").agg(F.min("id").alias("least"))
    joined = keys.join(free, "key").join(same.select("key", F.col("ssn").alias("_s"), "least"), (keys["key"] == same["key"]) & keys["ssn"].eqNullSafe(F.col("_s"))).select("id", F.coalesce("free", "least").alias("hub"))
    return joined.filter("id <> hub").select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")).distinct()


def components(people: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (least id), by passing least labels along links and jumping pointers; rounds grow with the logarithm of a path.

    The links are written once, not made again in each round, and rounds have those only who have links.
    """
    edges = cut(edges)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = people.select("id", F.col("id").alias("component")).join(both.select(F.col("u").alias("id")).distinct(), "id", "left_semi")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("far", "component")).alias("component"), "old"))
        labels = new.drop("old")
        if new.filter("component <> old").isEmpty():
            return people.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def decisions(people: DataFrame, comps: DataFrame) -> DataFrame:
    """component, members (sorted, comma-joined), n, decision, survivor.

    One member: link; two: merge, or the first guardrail that holds; more: multi_match. The survivor of a merge is the
    member updated last, of equals that with the smaller id.
    """
    # The members are the review's content: a steward picks among them. The rules need the count and the two ends only.
    ids = people.select("id").join(comps, "id").groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    big = ids.select("component", F.array_join("ids", ",").alias("members"), F.size("ids").cast("bigint").alias("n"), F.get("ids", 0).alias("first"), F.element_at("ids", -1).alias("last"))
    a, b = (people.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("gender", "deceased", "active", "last_updated", "ssn")]) for side in ("first", "last"))
    pair = big.join(a, "first").join(b, "last")
    sex = lambda s: F.coalesce(f"{s}_gender", F.lit("unknown"))
    days = F.abs(F.unix_millis(F.try_to_timestamp("first_deceased")) - F.unix_millis(F.try_to_timestamp("last_deceased")))
    rule = (
        F.when(F.col("n") == 1, "link")
        .when(F.col("n") > 2, "multi_match")
        .when(F.col("first_ssn") != F.col("last_ssn"), "distinct")
        .when((sex("first") != sex("last")) & (sex("first") != "unknown") & (sex("last") != "unknown"), "sex_mismatch")
        .when(days > DEATH_DAYS * 86_400_000, "date_of_death_mismatch")
        .when(~F.coalesce("first_active", F.lit(True)) | ~F.coalesce("last_active", F.lit(True)), "inactive_candidate")
        .otherwise("merge")
    )
    survivor = F.when(F.col("last_last_updated") > F.col("first_last_updated"), F.col("last")).otherwise(F.col("first"))
    out = pair.withColumn("decision", rule)
    return out.select("component", "members", "n", "decision", F.when(F.col("decision") == "merge", survivor).when(F.col("n") == 1, F.col("first")).alias("survivor"))


def merges(decided: DataFrame) -> DataFrame:
    """merged, survivor of each merge."""
    rows = decided.filter("decision = 'merge'").select("survivor", F.explode(F.split("members", ",")).alias("merged"))
    return rows.filter("merged <> survivor").select("merged", "survivor")


def terminal(history: DataFrame) -> DataFrame:
    """merged, survivor at the end of each chain, by pointer doubling; a chain stops where it would turn back."""
    now = history
    while True:
        far = now.select(F.col("merged").alias("survivor"), F.col("survivor").alias("far"))
        new = cut(now.join(far, "survivor", "left").select("merged", F.when(F.col("far").isNull() | (F.col("far") == F.col("merged")), F.col("survivor")).otherwise(F.col("far")).alias("survivor")))
        if new.exceptAll(now).isEmpty():
            return new
        now = new


def rewrite_references(df: DataFrame, column: str, survivors: DataFrame) -> DataFrame:
    """References in a column turned to their survivor, by join: the id after the last `Patient/` changes, what is before and behind it stays."""
    head, token, tail = (F.regexp_extract(column, r"(?s)^(.*Patient/)([^/]+)(.*)$", k) for k in (1, 2, 3))
    joined = df.withColumn("_m", token).join(survivors.select(F.col("merged").alias("_m"), F.col("survivor").alias("_to")), "_m", "left")
    return joined.withColumn(column, F.when(F.col("_to").isNotNull(), F.concat(head, F.col("_to"), tail)).otherwise(F.col(column))).select(*df.columns)


def rewrite_body(body: str, to: dict[str, str]) -> str:
    """A document with the patient id in its `reference` values replaced; what follows the id stays."""
    doc = json.loads(body)
    todo = [doc]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(x)
        elif isinstance(x, dict):
            for k, v in x.items():
                if k == "reference" and isinstance(v, str) and "Patient/" in v:
                    head, _, tail = v.rpartition("Patient/")
                    id_, slash, rest = tail.partition("/")
                    x[k] = f"{head}Patient/{to.get(id_, id_)}{slash}{rest}"
                else:
                    todo.append(v)
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


def body_ids(body: Column | str) -> Column:
    """The patient ids inside a document, each once."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"Patient/([^/\"\\]+)"), F.lit(1)))


def with_survivors(df: DataFrame, ids: Column, survivors: DataFrame) -> DataFrame:
    """df with _to: merged -> survivor of each row's ids, null without any; they are joined to it, not broadcast."""
    found = df.select("id", F.explode_outer(ids).alias("merged")).join(survivors, "merged")  # a filter on the ids would find them twice
    maps = found.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("merged", "survivor"))).alias("_to"))
    return df.join(maps, "id", "left").select(*df.columns, "_to")


@arrow_udf(T.StringType())
def _rewritten(bodies, maps):
    import pyarrow as pa

    return pa.array([rewrite_body(x, dict(m)) if m and x else x for x, m in zip(bodies.to_pylist(), maps.to_pylist())], pa.string())


def rewritten(body: Column | str, to: Column | str) -> Column:
    """A document with the ids of a map replaced; only documents that have such ids go through Python."""
    body, to = (F.col(x) if isinstance(x, str) else x for x in (body, to))
    return F.when(to.isNull(), body).otherwise(_rewritten(F.when(to.isNotNull(), body), to))


def rewrite_bodies(df: DataFrame, survivors: DataFrame) -> DataFrame:
    """df with body_json rewritten; the survivors of the ids inside each body are joined to it."""
    rows = with_survivors(df, body_ids("body_json"), survivors)
    return rows.withColumn("body_json", rewritten("body_json", "_to")).select(*df.columns)


def member_match(asked: DataFrame, people: DataFrame) -> DataFrame:
    """asked, result, id of persons asked for (asked, n identifiers [system, value], subscriber, family, birthdate, gender).

    Each identifier in its order, then the subscriber as an identifier of any system, then family, birth date and gender
    together; the first rule with exactly one match decides. Else several, or none. people: id, identifiers, family,
    birthdate, gender.
    """
    idents = people.select("id", F.explode("identifiers").alias("i")).select("id", F.col("i.system").alias("_system"), F.col("i.value").alias("value"))
    one = asked.select("asked", F.posexplode("identifiers").alias("rank", "i")).select("asked", "rank", F.nullif("i.system", F.lit("")).alias("system"), F.col("i.value").alias("value"))
    two = asked.filter("subscriber is not null").select("asked", F.lit(1_000_000).alias("rank"), F.lit(None).cast("string").alias("system"), F.col("subscriber").alias("value"))
    by_id = one.unionByName(two).join(idents, "value").filter(F.col("system").isNull() | (F.col("system") == F.col("_system"))).select("asked", "rank", "id")
    who = people.select("id", F.lower("family").alias("_family"), F.col("birthdate").alias("_birth"), F.col("gender").alias("_gender"))
    same = (F.lower("family") == F.col("_family")) & (F.col("birthdate") == F.col("_birth")) & (F.col("gender") == F.col("_gender"))
    by_name = asked.join(who, same).select("asked", F.lit(2_000_000).alias("rank"), "id")
    rules = by_id.unionByName(by_name).groupBy("asked", "rank").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    best = rules.groupBy("asked").agg(F.min(F.when(F.col("n") == 1, F.struct("rank", "id"))).alias("x"))
    result = F.when(F.col("x").isNotNull(), "matched").when(F.col("_there"), "several").otherwise("none")
    return asked.select("asked").join(best.withColumn("_there", F.lit(True)), "asked", "left").select("asked", result.alias("result"), F.col("x.id").alias("id"))
