"""URL filters: allow and block rules, then boosted trees on lexical features.

Method, in DataFrame functions only (training and scoring are Spark ML's, on
DataFrames): urls that a rule decides are the labelled ones; gradient-boosted
trees learn from length, depth, digit ratio, entropy, parameter counts, label
counts and the block rates of host suffixes and first path segments, and judge the urls without a rule.

The trees are fitted on a sample of labelled urls, chosen by hash, of about
`max_train` rows; suffix statistics come from all labelled rows, in training
without the row's own label. For a part of the training rows they are put at
the overall rate, which is what an unknown suffix has, so that the trees judge
such hosts by their other features.

Up to `most` rules become one expression; more are joined with the suffixes of
each distinct host, which gives the same.

Defined cases: a null url, or one without "://", has an empty host and path
and no rule, and is judged by the model like others; repeated pages are judged
row by row; an empty table gives no rows; without labelled urls of both
verdicts there is no model and the verdict is "allow"; columns of the input
named like a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.llm.common import quoted, read, table

#: The contract's rules: verdict and host with path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_TRAIN = 20_000
MAX_RULES = 200
UNKNOWN = 4
TREES, DEPTH, SEED = 10, 3, 7
PRIOR = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "params", "labels", "hyphens", "marks", "suffix_rate", "domain_rate", "segment_rate")
_SEEN = ("host", "suffix", "domain", "segment", "_url", "said", *FEATURES[:-3])


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. Of equally long ones the last by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def matched(rows: DataFrame, rules=RULES, most: int = MAX_RULES) -> DataFrame:
    """rows (host, path, ...) with rule and said."""
    if len(rules) <= most:
        rule, said = match(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "said": said})
    parts = [(said, text.partition("/")[0], "".join(text.partition("/")[1:]), text) for said, text in rules]
    known = rows.sparkSession.createDataFrame(parts, "_verdict string, _name string, _rest string, _text string")
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    fits = places.withColumn("_name", F.explode(ends)).join(known, "_name").filter(F.col("path").startswith(F.col("_rest")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("_text"), "_text", "_verdict")).alias("x"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("x._text").alias("rule"), F.col("x._verdict").alias("said"))
    return rows.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")


def _count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def entropy(value: Column) -> Column:
    """Bits a character, from the counts of the value's distinct characters."""
    n = F.length(value).cast("double")
    shares = F.transform(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), lambda c: F.size(F.split(value, F.concat(F.lit("\\Q"), c, F.lit("\\E")))) - 1)
    bits = F.aggregate(shares, F.lit(0.0), lambda s, k: s - (k / n) * F.log2(k / n))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(pages: DataFrame, rules=RULES, most: int = MAX_RULES) -> DataFrame:
    """pages with host, path, rule, said (the rule's verdict) and lexical features."""
    added = {"host", "path", "rule", "verdict", "said", "suffix", "domain", "segment", "guess", "_url", *FEATURES}
    kept = [quoted(c) for c in pages.columns if c.lower() not in added]
    cut = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("url", F.lit("")).alias("_url"))
    url, query = F.col("_url"), F.regexp_extract("_url", r"(?s)\?([^#]*)", 1)
    return matched(cut, rules, most).select(
        "*",
        F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("domain"),
        F.regexp_extract("path", "^/([^/]*)/", 1).alias("segment"),
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/[^/]").alias("depth"),
        F.coalesce(F.try_divide(_count(url, "[0-9]"), F.length(url)), F.lit(0.0)).alias("digits"),
        entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(1 + _count(query, "&")).alias("params"),
        _count(F.col("host"), r"\.").alias("labels"),
        _count(F.col("host"), "-").alias("hyphens"),
        _count(url, r"[^A-Za-z0-9./:?#&=_-]").alias("marks"),
    )


def _rates(labelled: DataFrame, by: str) -> DataFrame:
    """Urls and blocked ones of each value among labelled urls."""
    return labelled.groupBy(F.col(by).alias(f"_{by}")).agg(F.count("*").alias(f"_{by}_n"), F.sum(_blocked()).alias(f"_{by}_b"))


def _blocked() -> Column:
    return F.when(F.col("said") == "block", 1.0).otherwise(0.0)


class Model:
    """Trees over labelled rows (lexical, with said); None where one verdict is missing."""

    def __init__(self, seen: DataFrame, max_train: int = MAX_TRAIN):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        n = {r.said: r.n for r in seen.groupBy("said").agg(F.count("*").alias("n")).collect()}  # two rows
        self.trees, total = None, sum(n.values())
        if len(n) < 2:
            return
        self.overall = n["block"] / total
        self.rated = [(by, _rates(seen, by)) for by in ("suffix", "domain", "segment")]
        chosen = seen.filter(F.pmod(F.xxhash64("_url"), F.lit(total)) < max_train) if total > max_train else seen
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep")
        rows = self.with_rates(chosen, own=True)
        train = table(rows.select((F.col("said") == "block").cast("double").alias("_label"), *FEATURES), "url-train")
        trees = GBTClassifier(labelCol="_label", featuresCol="_features", predictionCol="_predicted", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        self.trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(self.assembler.transform(train))

    def with_rates(self, df: DataFrame, own: bool = False) -> DataFrame:
        """df with smoothed block rates; own: without the row's own label, and for every UNKNOWN-th url as if its suffix were unknown."""
        for by, rates in self.rated:
            df = df.join(rates, F.col(by) == F.col(f"_{by}"), "left")
            n, blocked = F.coalesce(f"_{by}_n", F.lit(0)) - int(own), F.coalesce(f"_{by}_b", F.lit(0.0)) - (_blocked() if own else 0)
            rate = (blocked + PRIOR * self.overall) / (n + PRIOR)
            if own and by != "segment":
                rate = F.when(F.pmod(F.xxhash64(F.lit(SEED), "_url"), F.lit(UNKNOWN)) == 0, self.overall).otherwise(rate)
            df = df.withColumn(f"{by}_rate", rate).drop(f"_{by}", f"_{by}_n", f"_{by}_b")
        return df

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """rows with guess."""
        if self.trees is None:
            return rows.withColumn("guess", F.lit("allow"))
        scored = self.trees.transform(self.assembler.transform(self.with_rates(rows)))
        return scored.withColumn("guess", F.when(F.col("_predicted") == 1.0, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, max_train: int = MAX_TRAIN, most: int = MAX_RULES) -> DataFrame:
    """pages with host, path, rule and verdict."""
    rows = lexical(pages, rules, most)
    own = [quoted(c) for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "said"}]
    seen = table(rows.filter("said is not null").select(*_SEEN), "url-labels")
    return Model(seen, max_train).verdicts(rows).select(*own, "host", "path", "rule", F.coalesce("said", "guess").alias("verdict"))


def held_out(pages: DataFrame, rules=RULES, folds: int = 5) -> DataFrame:
    """said, guess, n: labelled urls of one fold of hosts, judged by a model of the others."""
    seen = table(lexical(pages.select("url"), rules).filter("said is not null").select(*_SEEN), "url-labels")
    fold = F.pmod(F.xxhash64("host"), F.lit(folds)) == 0
    return Model(seen.filter(~fold)).verdicts(seen.filter(fold)).groupBy("said", "guess").agg(F.count("*").alias("n"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


QUERIES = {"op9_url_filter": op9_url_filter}
#: The model's verdicts are not SQL; its held-out accuracy is tested.
SQL: dict[str, str] = {}
