"""Transaction bundles: ids for new entries, references inside a bundle and by condition, all or nothing.

Everything is an equi-join of entries, references and stored identifiers, so many bundles are applied at once and
a large one is spread over tasks; only the references of one body come together, to rewrite it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

ASKS = 100_000
KEYS = ["kind", "system", "value"]
_CONDITION = r"^([A-Za-z]+)\?identifier=([^|]*)\|(.+)$"


def _walk(node, change):
    """A copy of a document in which the strings under `reference` are changed."""
    if isinstance(node, dict):
        return {k: change(v) if k == "reference" and isinstance(v, str) else _walk(v, change) for k, v in node.items()}
    return [_walk(x, change) for x in node] if isinstance(node, list) else node


@pandas_udf(T.ArrayType(T.StringType()))
def references(bodies):
    """Distinct references in documents."""

    def of(body):
        found: dict[str, None] = {}
        if body:
            _walk(json.loads(body), lambda r: found.setdefault(r))
        return list(found)

    return bodies.map(of)


@pandas_udf(T.StringType())
def _rewritten(bodies, maps):
    def one(body, to):
        to = dict(to) if to is not None else {}
        return json.dumps(_walk(json.loads(body), lambda r: to.get(r, r)), ensure_ascii=False, separators=(",", ":")) if body and to else body

    return type(bodies)([one(b, m) for b, m in zip(bodies, maps)])


def new_id() -> Column:
    """An id for an entry that a retried task gives again: from its bundle and place."""
    return F.substring(F.sha2(F.concat_ws("/", "bundle", F.col("n").cast("string")), 256), 1, 32)


def _salted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows with _salt, which deals those that ask for the same over tasks of about ASKS, and all that don't ask by their place:
    a join would send equal keys, nulls too, to one task. asked: kind, system, value, asks."""
    many = asked.filter(F.col("asks") > ASKS).select(*KEYS, F.ceil(F.col("asks") / ASKS).alias("_tasks"))  # few: each has ASKS rows
    place, asks = F.xxhash64("bundle", "n"), F.coalesce(F.col("kind") != "", F.lit(False)) & F.col("value").isNotNull()
    salt = F.when(asks, F.pmod(place, F.coalesce("_tasks", F.lit(1)))).otherwise(-1 - F.pmod(place, F.lit(1 << 20)))
    return rows.join(F.broadcast(many), KEYS, "left").withColumn("_salt", salt).drop("_tasks")


def _matched(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows (bundle, n, kind, system, value, ...; kind '' or value null: asks for nothing) with hits and one id of live stored
    identifiers (kind, system, value, id)."""
    asked = rows.filter("kind <> '' and value is not null").groupBy(*KEYS).agg(F.count("*").alias("asks"))
    found = asked.join(stored, KEYS).groupBy(*KEYS).agg(F.countDistinct("id").alias("hits"), F.min("id").alias("hit"), F.max("asks").alias("asks"))
    tasks = F.greatest(F.lit(1), F.ceil(F.col("asks") / ASKS)).cast("bigint")
    found = found.select(*KEYS, "hits", "hit", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks - 1)).alias("_salt"))
    return _salted(rows, asked).join(found, [*KEYS, "_salt"], "left").drop("_salt")


def apply(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """bundle, n, kind, id, status, body of entries (bundle, n, full_url, method, url, if_none_exist, body).

    status: created, updated, exists (`ifNoneExist` found one), or rejected, with reason, for all entries of a bundle in
    which any fails: several matches, an unresolved `urn:uuid:` or condition, a body without type, an unknown method.
    Conditions look at the bundle's own identifiers first, then at stored ones; they need exactly one.
    """
    e = entries.withColumn("kind", F.get_json_object("body", "$.resourceType"))
    for k, c in enumerate(("system", "value"), 1):
        e = e.withColumn(c, F.nullif(F.regexp_extract(F.coalesce("if_none_exist", F.lit("")), r"^identifier=([^|]*)\|(.+)$", k), F.lit("")))
    e = _matched(e, stored)
    post, put = F.col("method") == "POST", F.col("method") == "PUT"
    reason = (
        F.when(F.col("kind").isNull(), "no-type").when(~(post | put), "method").when(post & F.col("if_none_exist").isNotNull() & F.col("value").isNull(), "condition")
        .when(post & (F.col("hits") > 1), "multiple-matches").when(put & ~F.coalesce(F.col("url").rlike("^[A-Za-z]+/[A-Za-z0-9.-]{1,64}$"), F.lit(False)), "url")
    )
    id_ = F.when(put, F.substring_index("url", "/", -1)).otherwise(F.when(F.col("hits") == 1, F.col("hit")).otherwise(new_id()))
    status = F.when(put, "updated").when(F.col("hits") == 1, "exists").otherwise("created")
    e = e.select("bundle", "n", "full_url", "kind", id_.alias("id"), status.alias("status"), reason.alias("own"), "body")

    refs = e.select("bundle", "n", F.explode(references("body")).alias("ref")).filter(F.col("ref").startswith("urn:uuid:") | F.col("ref").rlike(_CONDITION))
    target = F.concat_ws("/", "kind", "id")
    local = e.filter("full_url is not null").groupBy("bundle", F.col("full_url").alias("ref")).agg(F.min(target).alias("local"), F.countDistinct(target).alias("places"))
    parts = {c: F.regexp_extract("ref", _CONDITION, k) for k, c in enumerate(("kind", "system", "value"), 1)}
    refs = refs.withColumns(parts)
    idents = F.from_json(F.get_json_object("body", "$.identifier"), "array<struct<system:string,value:string>>")
    own = e.select("bundle", "kind", "id", F.explode(idents).alias("i")).select("bundle", "kind", "id", F.coalesce("i.system", F.lit("")).alias("system"), F.col("i.value").alias("value"))
    own = own.groupBy("bundle", "kind", "system", "value").agg(F.countDistinct("id").alias("own_hits"), F.min("id").alias("own_hit"))
    refs = refs.join(local, ["bundle", "ref"], "left").join(own, ["bundle", "kind", "system", "value"], "left")
    refs = _matched(refs, stored)
    found = F.when(F.col("kind") == "", F.when(F.col("places") == 1, F.col("local"))).otherwise(
        F.concat(F.col("kind"), F.lit("/"), F.when(F.col("own_hits").isNotNull(), F.when(F.col("own_hits") == 1, F.col("own_hit"))).otherwise(F.when(F.col("hits") == 1, F.col("hit"))))
    )
    to = refs.select("bundle", "n", "ref", found.alias("to")).groupBy("bundle", "n").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("to").isNotNull(), F.struct("ref", "to")))).alias("to"), F.max(F.col("to").isNull()).alias("open")
    )  # of one body
    e = e.join(to, ["bundle", "n"], "left").withColumn("own", F.coalesce("own", F.when(F.col("open"), "unresolved")))
    failed = e.filter("own is not null").groupBy("bundle").agg(F.min(F.struct("n", "own")).alias("why"))
    e = e.join(failed, "bundle", "left").withColumn("reason", F.col("why.own"))
    ok = F.col("reason").isNull()
    return e.select(
        "bundle", "n", "kind", F.when(ok, F.col("id")).alias("id"), F.when(ok, F.col("status")).otherwise("rejected").alias("status"), "reason", F.when(ok, _rewritten("body", "to")).alias("body"),
    )
