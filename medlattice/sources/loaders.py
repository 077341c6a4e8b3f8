"""Readers of terminology files and conformance packages; NDJSON export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

FSN = "900000000000003001"  # fixed value: type of a fully specified name


def loinc(spark: SparkSession, path: str) -> DataFrame:
    """system, code, display: rows whose status is empty or ACTIVE."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    c = raw.columns
    status = F.coalesce(F.col(f"`{c[11]}`"), F.lit("")) if len(c) > 11 else F.lit("")
    name = [F.nullif(F.col(f"`{c[k]}`"), F.lit("")) for k in (8, 9) if k < len(c)]
    return raw.filter(status.isin("", "ACTIVE")).select(F.lit("http://loinc.org").alias("system"), F.col(f"`{c[0]}`").alias("code"), F.coalesce(*name, F.col(f"`{c[0]}`")).alias("display"))


def snomed(spark: SparkSession, concepts: str, descriptions: str) -> DataFrame:
    """Active concepts with their first active fully specified name (by description id), else the code."""
    tsv = lambda p: spark.read.csv(p, header=True, sep="\t", quote="")
    live = tsv(concepts).filter("active = '1'").select(F.col("id").alias("code"))
    names = tsv(descriptions).filter((F.col("active") == "1") & (F.col("typeId") == FSN)).groupBy(F.col("conceptId").alias("code")).agg(F.min_by("term", F.col("id").cast("decimal(38,0)")).alias("term"))
    return live.join(names, "code", "left").select(F.lit("http://snomed.info/sct").alias("system"), "code", F.coalesce("term", "code").alias("display"))


def rxnorm(spark: SparkSession, path: str) -> DataFrame:
    """English RxNorm names, one for each RXCUI: that with the least atom id."""
    raw = spark.read.csv(path, sep="|", quote="")
    rows = raw.filter((F.col("_c11") == "RXNORM") & (F.col("_c1") == "ENG"))
    return rows.groupBy(F.col("_c0").alias("code")).agg(F.min_by("_c14", "_c7").alias("display")).select(F.lit("http://www.nlm.nih.gov/research/umls/rxnorm").alias("system"), "code", "display")


def package(spark: SparkSession, folder: str) -> DataFrame:
    """type, url, body_json of the conformance resources among a package's JSON files."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("file", F.input_file_name())
    kind = F.get_json_object("value", "$.resourceType")
    rows = raw.filter(~F.col("file").endswith("/package.json") & kind.isin("StructureDefinition", "CodeSystem", "ValueSet", "ConceptMap"))
    return rows.select(kind.alias("type"), F.get_json_object("value", "$.url").alias("url"), F.col("value").alias("body_json"))


def expansion_file(spark: SparkSession, path: str) -> DataFrame:
    """valueset, system, code, display of stored value set expansions."""
    schema = "url string, expansion struct<contains:array<struct<system:string,code:string,display:string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    return doc.select(F.col("d.url").alias("valueset"), F.inline("d.expansion.contains"))


def ndjson(df: DataFrame, path: str) -> int:
    """body_json lines; returns how many were written, counted while writing."""
    seen = Observation()
    df.select("body_json").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def export(tables: dict[str, DataFrame], path: str, request: str, now: str) -> dict:
    """One folder of lines for each type with rows, and a manifest, which is renamed into place last: a reader sees a
    whole export or none. A type that fails is listed as an error."""
    spark = next(iter(tables.values())).sparkSession
    made: dict = {"status": "complete", "transactionTime": now, "request": request, "requiresAccessToken": False, "output": [], "error": []}
    for kind, df in sorted(tables.items()):
        place = f"{path}/{kind}.ndjson"
        try:
            n = ndjson(df, place)
        except Exception as e:  # reported in the manifest
            made["error"].append({"type": kind, "url": place, "message": str(e).splitlines()[0]})
            continue
        if n:
            made["output"].append({"type": kind, "url": place, "count": n})
    if made["error"]:
        made["status"] = "failed"
    at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at("_manifest.tmp"), True)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    fs.delete(at("manifest.json"), False)
    fs.rename(at("_manifest.tmp"), at("manifest.json"))
    return made


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """type, url, n of an export's outputs."""
    doc = spark.read.text(f"{path}/manifest.json", wholetext=True)
    rows = doc.select(F.explode(F.from_json(F.get_json_object("value", "$.output"), "array<struct<type:string,url:string,count:bigint>>")).alias("o"))
    return rows.select("o.type", "o.url", F.col("o.count").alias("n"))
