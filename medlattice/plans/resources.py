"""Clinical resources derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlattice.functions import index as ix

DAY = lambda c: F.substring(F.col(c).cast("string"), 1, 10)


def _load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by their key: a table's file may be one task, and documents and indexes are made of its rows."""
    return df.repartition(F.col(key))


def _row(df: DataFrame, *index, version=1) -> DataFrame:
    version = F.lit(version).cast("bigint") if isinstance(version, int) else version
    return df.withColumns({"idx": ix.search_index(*index), "version_id": version, "is_current": F.lit(True), "deleted": F.lit(False)})


def patient(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tens = F.floor(k / 20).cast("string")
    gender = F.when(k % 7 == 0, None).when(k % 3 == 0, "male").when(k % 3 == 1, "female").otherwise("unknown")
    mrn = F.when((k % 20).isin(0, 1), F.concat(F.lit("P"), tens)).when((k % 20).isin(2, 3, 4), F.concat(F.lit("T"), tens)).otherwise(F.concat(F.lit("S"), k.cast("string")))
    df = _dealt(_load(spark, d, "customer"), "c_custkey").select(
        k.cast("string").alias("id"),
        F.lower("c_name").alias("family"),
        gender.alias("gender"),
        mrn.alias("mrn"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.concat(F.lit("2026-01-01T00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z")).alias("last_updated"),
    )
    idents = ix.identifier_index(("urn:mrn", F.col("mrn"), "MR"), ("urn:cust", F.col("name"), ""))
    index = (ix.strings("family", F.col("family")), ix.token("gender", F.col("gender")), ix.token("segment", F.col("segment"), "urn:segment"), ix.number("balance", F.col("balance")), ix.token("identifier", F.col("mrn"), "urn:mrn"), ix.uri("profile", F.concat(F.lit("urn:profile:"), F.col("segment"))))
    body = F.to_json(F.struct(F.lit("Patient").alias("resourceType"), "id", F.array(F.struct("family")).alias("name"), "gender", F.array(F.struct(F.lit("urn:mrn").alias("system"), F.col("mrn").alias("value"))).alias("identifier")))
    return _row(df, *index).withColumns({"identifiers": idents, "body_json": body})


def people(spark: SparkSession, d: str) -> DataFrame:
    """Patients as entity resolution takes them; only the mrn is shared."""
    none = F.lit(None).cast("string")
    return patient(spark, d).select("id", "gender", "last_updated", "deleted", F.lit(True).alias("active"), none.alias("deceased"), none.alias("ssn"), "identifiers")


def encounter(spark: SparkSession, d: str) -> DataFrame:
    df = _load(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), DAY("o_orderdate").alias("d"), F.concat(F.lit("Patient/"), F.col("o_custkey").cast("string")).alias("subject"), F.col("o_orderpriority").alias("cls")
    )
    index = (ix.token("status", F.col("status"), "urn:status"), ix.token("class", F.col("cls"), "urn:priority"), ix.dates("date", F.col("d")), ix.reference("subject", F.col("subject")))
    return _row(df.withColumn("last_updated", F.col("d")), *index)


def observation_versions(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("l_orderkey", "l_linenumber")
    w = own.orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    df = _load(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.row_number().over(w).cast("bigint").alias("version"),
        (F.row_number().over(w) == F.count("*").over(own)).alias("is_current"),  # the highest version; by the same shuffle
        F.col("l_returnflag").alias("code"),
        F.col("l_quantity").cast("bigint").alias("q"),
        DAY("l_shipdate").alias("d"),
        F.concat(F.lit("Organization/"), F.col("l_suppkey").cast("string")).alias("performer"),
        F.concat(F.lit("Encounter/"), F.col("l_orderkey").cast("string")).alias("encounter"),
    )
    return df.withColumns({"last_updated": F.col("d"), "deleted": F.lit(False)}).withColumnRenamed("version", "version_id")


def observation(spark: SparkSession, d: str) -> DataFrame:
    """One version a row of lineitem, current where it is the highest of its id."""
    df = observation_versions(spark, d)
    index = (ix.token("code", F.col("code"), "urn:flag"), ix.quantity("value-quantity", F.col("q"), "urn:unit"), ix.dates("date", F.col("d")), ix.reference("performer", F.col("performer")), ix.reference("encounter", F.col("encounter")))
    return df.withColumn("idx", ix.search_index(*index))


def organization(spark: SparkSession, d: str) -> DataFrame:
    df = _load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("2026-01-01").alias("last_updated"))
    return _row(df, ix.strings("name", F.col("name")), ix.number("balance", F.col("balance")))


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Version chains with tombstones."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _load(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.row_number().over(w).cast("bigint").alias("version_id"), (F.col("event_type") == "error").alias("deleted"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "event_type")


def doc_labels(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _load(spark, d, "documents").select("doc_id", "source"), _load(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), "source", F.when(F.col("toxic") == 1, "R").otherwise("N").alias("conf"), F.when(F.col("quality") == 0, "PSY").alias("sens"))


def brands(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, "part").select(F.lit("urn:brand").alias("system"), F.col("p_brand").alias("code"), F.concat(F.lit("Brand "), F.col("p_brand")).alias("display")).distinct()


def value_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(expansion, headers): vs-all complete, vs-low (codes below Brand#3) complete, vs-partial (codes below Brand#2) incomplete."""
    b = brands(spark, d)
    of = lambda name, rows: rows.select(F.lit(name).alias("valueset"), "system", "code", "display")
    expansion = of("vs-all", b).unionByName(of("vs-low", b.filter("code < 'Brand#3'"))).unionByName(of("vs-partial", b.filter("code < 'Brand#2'")))
    headers = spark.createDataFrame([("vs-all", True), ("vs-low", True), ("vs-partial", False)], "valueset string, complete boolean")
    return expansion, headers


def audit_log(spark: SparkSession, d: str, damaged: bool = True) -> DataFrame:
    """All events as a log: each user's day is a chain. If damaged, every 60th event's content and every 101st one's link are tampered with."""
    from medlattice.operators.audit import append_chains

    rows = _load(spark, d, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("chain"), F.unix_micros(F.col("ts").cast("timestamp")).alias("n"), F.col("event_id").cast("string").alias("id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("recorded"), F.lit("R").alias("action"), F.lit("0").alias("outcome"), F.col("event_type").alias("subtype"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("agent_who"), F.lit("").alias("entity_ref"), (F.col("user_id") % 10).cast("string").alias("patient"), F.col("props").alias("body_json"),
    )
    k = F.col("id").cast("bigint")
    tampered = {"outcome": F.when(k % 60 == 59, "8").otherwise(F.col("outcome")), "prev_hash": F.when(k % 101 == 100, "0" * 64).otherwise(F.col("prev_hash"))}
    log = append_chains(rows)
    return log.withColumns(tampered).select(*log.columns) if damaged else log
