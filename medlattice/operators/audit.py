"""Hash-chained audit log: append, verify, anchor, accounting."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlattice.operators.lineage import cut

FIELDS = ("id", "recorded", "action", "outcome", "subtype", "agent_who", "entity_ref", "patient", "body_json")


def content_hash(prev: Column) -> Column:
    """sha256 of the previous hash and one field=value line for each field; null is empty."""
    lines = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in FIELDS]
    return F.sha2(F.concat(prev, F.lit("\n"), F.concat_ws("\n", *lines)), 256)


def append(rows: list[dict], prev: str = "") -> list[dict]:
    """A writer's batch, chained after `prev`. Appending is serial by its nature and runs where the batch is."""
    out = []
    for r in rows:
        text = prev + "\n" + "\n".join(f"{f}={'' if r.get(f) is None else r[f]}" for f in FIELDS)
        now = hashlib.sha256(text.encode()).hexdigest()
        out.append({**r, "prev_hash": prev, "hash": now})
        prev = now
    return out


def append_chains(rows: DataFrame) -> DataFrame:
    """Records (chain, n, and FIELDS) chained in order of n and id, all chains in parallel. Rows stream through a task in
    order, so a chain of any length takes no memory but its last hash."""

    def chained(batches):
        import pyarrow as pa

        chain, prev = None, ""
        for batch in batches:
            own = batch.to_pylist()
            done = []
            for r in own:
                if r["chain"] != chain:
                    chain, prev = r["chain"], ""
                done += append([r], prev)
                prev = done[-1]["hash"]
            yield pa.RecordBatch.from_pydict({c: [r[c] for r in done] for c in names}, schema=pa.schema([(c, pa.string()) for c in names]))

    names = ["chain", *FIELDS, "prev_hash", "hash"]
    ordered = rows.select("chain", "n", *[F.col(c).cast("string") for c in FIELDS]).repartition("chain").sortWithinPartitions("chain", "n", "id")
    return ordered.mapInArrow(chained, ", ".join(f"{c} string" for c in names))


def verify(log: DataFrame) -> DataFrame:
    """chain, id, problem of every row whose content or link fails, and rows for a missing or a second start of a chain;
    parallel, without an order."""
    bad = log.filter(content_hash(F.col("prev_hash")) != F.col("hash")).select("chain", "id", F.lit("content").alias("problem"))
    known = log.select("chain", F.col("hash").alias("prev_hash")).distinct()
    lost = log.filter("prev_hash <> ''").join(known, ["chain", "prev_hash"], "left_anti").select("chain", "id", F.lit("missing-predecessor").alias("problem"))
    starts = log.groupBy("chain").agg(F.sum(F.when(F.col("prev_hash") == "", 1).otherwise(0)).alias("n"))
    wrong = starts.filter("n <> 1").select("chain", F.lit("").alias("id"), F.when(F.col("n") == 0, "no-start").otherwise("several-starts").alias("problem"))
    return bad.unionByName(lost).unionByName(wrong)


def anchor(log: DataFrame) -> DataFrame:
    """chain, n and tip: the hash that no row of the chain follows, the least where there are several."""
    followed = log.select("chain", F.col("prev_hash").alias("hash")).distinct()
    tip = log.join(followed, ["chain", "hash"], "left_anti").groupBy("chain").agg(F.min("hash").alias("tip"))
    return log.groupBy("chain").agg(F.count("*").alias("n")).join(tip, "chain", "left")


def positions(log: DataFrame) -> DataFrame:
    """chain, id, position (from 0) along the chain, by pointer doubling: log2(n) joins."""
    now = log.select("chain", "id", "hash", F.col("prev_hash").alias("to"), F.when(F.col("prev_hash") == "", 0).otherwise(1).cast("bigint").alias("position"))
    while not now.filter("to <> ''").isEmpty():
        far = now.select("chain", F.col("hash").alias("to"), F.col("to").alias("next"), F.col("position").alias("more"))
        now = cut(now.join(far, ["chain", "to"], "left").select("chain", "id", "hash", F.coalesce("next", F.lit("")).alias("to"), (F.col("position") + F.coalesce("more", F.lit(0))).alias("position")))
    return now.select("chain", "id", "position")


def check_anchors(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """chain, state of each anchor (chain, n, tip) taken before: ok, truncated (fewer rows) or rewritten (the tip is gone)."""
    rows = log.groupBy("chain").agg(F.count("*").alias("_n"))
    tips = log.select("chain", F.col("hash").alias("tip"), F.lit(True).alias("_there")).distinct()
    now = anchors.join(rows, "chain", "left").join(tips, ["chain", "tip"], "left")
    state = F.when(F.coalesce("_n", F.lit(0)) < F.col("n"), "truncated").when(F.col("_there"), "ok").otherwise("rewritten")
    return now.select("chain", state.alias("state"))


def accounting(log: DataFrame, patient: str) -> DataFrame:
    return log.filter(F.col("patient") == patient).orderBy(F.desc("recorded"), F.desc("id"))


def classify(method: Column, has_id: Column, status: Column) -> tuple[Column, Column, Column]:
    """(action, subtype, outcome) of a request by its method, by whether it names a resource, and by its status."""
    m = F.upper(method)
    rules = [(m == "POST", has_id, "E", "operation"), (m == "POST", ~has_id, "C", "create"), (m == "GET", has_id, "R", "read"), (m == "GET", ~has_id, "E", "search-type")]
    rules += [(m == k, F.lit(True), a, s) for k, a, s in (("PUT", "U", "update"), ("PATCH", "U", "patch"), ("DELETE", "D", "delete"))]
    action, subtype = F.lit("E"), F.lit("operation")
    for met, also, a, s in rules:
        action, subtype = F.when(met & also, a).otherwise(action), F.when(met & also, s).otherwise(subtype)
    outcome = F.when((status >= 400) & (status < 500), "4").when(status >= 500, "8").otherwise("0")
    return action, subtype, outcome
