import re

import pytest

D = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def base(spark):
    """All of the smallest table, with null and empty texts, ids, langs and sources, a long text, exact repeats and clashing columns."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"w{k % 5000} x{k}" for k in range(30_000))
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, None, 0), (None, "a text without an id", "en", "src0", 1), (None, None, None, None, None), (9003, long, "en", "src1", 1), (9004, " \n\t ", "", "", 1)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return rows.unionByName(docs.filter("doc_id < 3")).cache()


@pytest.fixture(scope="session")
def clashing(spark, base):
    from pyspark.sql import functions as F

    names = ["n_words", "n_hit", "size", "kept", "secrets", "hit_items", "n_lines", "start", "_row", "_hash", "symbol_rate", "component_id", "_out"]
    return base.select("*", *[F.lit("mine").alias(n) for n in names])


@pytest.fixture(scope="session")
def none(base):
    return base.filter("false")
