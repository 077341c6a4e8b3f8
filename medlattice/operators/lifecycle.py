"""Batches of creates, updates and deletes, conditional ones too; page metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlattice.operators.history import newest


def uuid7(millis: Column, seed: Column) -> Column:
    """A version 7 UUID of a time and of bits hashed from a seed, so that a retried task gives it again."""
    bits = F.sha2(seed.cast("string"), 256)
    time = F.lpad(F.lower(F.hex(millis.cast("bigint"))), 12, "0")
    variant = F.lower(F.hex(F.conv(F.substring(bits, 4, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8))
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(bits, 1, 3)), F.concat(variant, F.substring(bits, 5, 3)), F.substring(bits, 8, 12))


def etag_version(etag: Column) -> Column:
    """The version of `W/"3"`, `"3"` or `3`; null where it is no number."""
    return F.regexp_extract(F.trim(etag), '^(?:W/)?"?([0-9]+)"?$', 1).try_cast("bigint")


def create(stored: DataFrame, new: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of new (id or null, n, ...): the first version of each. A client's id that is stored, or that is
    in the batch before (by n), is a conflict; a missing id is made from the time and n."""
    made = F.coalesce("id", uuid7(F.unix_millis(F.to_timestamp(F.lit(now))), F.concat_ws("/", F.lit(now), F.col("n").cast("string"))))
    rows = new.withColumn("id", made)
    first = rows.groupBy("id").agg(F.min("n").alias("_first"))
    known = stored.select("id").distinct().withColumn("_there", F.lit(True))
    rows = rows.join(first, "id").join(known, "id", "left").withColumn("reason", F.when(F.col("_there") | (F.col("n") > F.col("_first")), "conflict")).drop("_first", "_there")
    made = {"version_id": F.lit(1).cast("bigint"), "last_updated": F.lit(now), "deleted": F.lit(False)}
    return rows.filter("reason is null").drop("reason").withColumns(made), rows.filter("reason is not null")


def update(stored: DataFrame, new: DataFrame, now: str, if_match: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of new (id, ...): the next version of ids that exist, deleted ones too; `if_match` names a column with
    the ETag that the writer has seen (null: any)."""
    current = newest(stored.select("id", "version_id")).withColumnRenamed("version_id", "_now")
    rows = new.join(current, "id", "left")
    stale = F.col(if_match).isNotNull() & ~F.coalesce(etag_version(F.col(if_match)) == F.col("_now"), F.lit(False)) if if_match else F.lit(False)
    rows = rows.withColumn("reason", F.when(F.col("_now").isNull(), "not-found").when(stale, "version-conflict"))
    made = {"version_id": F.col("_now") + 1, "last_updated": F.lit(now), "deleted": F.lit(False)}
    return rows.filter("reason is null").withColumns(made).drop("reason", "_now"), rows.filter("reason is not null").drop("_now")


def delete(stored: DataFrame, ids: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(tombstones, rejects): the next version of each id, with the last body."""
    rows = ids.select("id").distinct().join(newest(stored).withColumn("_there", F.lit(True)), "id", "left")
    live = F.col("_there") & ~F.col("deleted")
    made = {"version_id": F.col("version_id") + 1, "last_updated": F.lit(now), "deleted": F.lit(True)}
    gone = rows.filter(~F.coalesce(live, F.lit(False))).select("id", F.when(F.col("_there"), "gone").otherwise("not-found").alias("reason"))
    return rows.filter(live).withColumns(made).drop("_there"), gone


def _sets(requests: DataFrame) -> DataFrame:
    """request, all: its conditions (code, value, system, any: of any system), sorted."""
    one = F.struct("code", "value", F.coalesce("system", F.lit("")).alias("system"), F.col("system").isNull().alias("any"))
    return requests.groupBy("request").agg(F.array_sort(F.collect_set(one)).alias("all"))  # of one request


def _candidates(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """all, id of rows that meet the condition of each set which the fewest entries meet, systems aside."""
    sets = wanted.select("all").distinct()
    pairs = F.array_distinct(F.transform("idx", lambda s: F.struct(s["code"].alias("code"), s["value"].alias("value"))))
    entries = current.select("id", F.explode(pairs).alias("s")).select("id", "s.code", "s.value")
    asked = sets.select("all", F.explode("all").alias("c")).select("all", "c.code", "c.value")
    sizes = entries.groupBy("code", "value").agg(F.count("*").alias("n"))
    rarest = asked.join(sizes, ["code", "value"], "left").groupBy("all").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "value")).alias("r"))
    return rarest.filter("r.n > 0").select("all", "r.code", "r.value").join(entries, ["code", "value"]).select("all", "id")


def matched(requests: DataFrame, current: DataFrame) -> DataFrame:
    """request, hits, hit (the least id) of conditions (request, code, value, system or null) over the index of current rows;
    several conditions of a request must hold together.

    Requests that ask the same are looked up once, by their rarest condition; a row tells by its own index whether it meets
    the others. So nothing is joined by a condition that most rows meet, unless a request has no other.
    """
    wanted = _sets(requests)
    fits = lambda s, c: (s["code"] == c["code"]) & (s["value"] == c["value"]) & (c["any"] | (s["system"] == c["system"]))
    met = _candidates(wanted, current).join(current.select("id", "idx"), "id").filter(F.forall("all", lambda c: F.exists("idx", lambda s: fits(s, c))))
    found = met.groupBy("all").agg(F.count_distinct("id").alias("hits"), F.min("id").alias("hit"))
    return wanted.join(found, "all", "left").select("request", "hits", "hit").fillna({"hits": 0})


def conditional(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """request, action, id of requests (request, method) by what their condition matches: several are refused; one is
    given back (POST), updated (PUT) or deleted (DELETE); without one POST and PUT create and DELETE does nothing."""
    rows = requests.select("request", "method").join(hits, "request", "left").fillna({"hits": 0})
    one = F.when(F.col("method") == "POST", "exists").when(F.col("method") == "PUT", "update").otherwise("delete")
    none = F.when(F.col("method") == "DELETE", "nothing").otherwise("create")
    action = F.when(F.col("hits") > 1, "refused").when(F.col("hits") == 1, one).otherwise(none)
    return rows.select("request", action.alias("action"), F.when(F.col("hits") == 1, F.col("hit")).alias("id"))


def page_info(rows: DataFrame, count: int = 50, offset: int = 0) -> DataFrame:
    """One row: total of all pages, and the offset of the next page or null."""
    count, offset = min(1000, max(0, count)), max(0, offset)
    total = F.count("*")
    return rows.agg(total.alias("total"), F.when(F.lit(count > 0) & (total > offset + count), F.lit(offset + count).cast("bigint")).alias("next"))


def history_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """type, total of all versions."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("total")).select(F.lit(t).alias("type"), "total") for t, df in tables.items()])
