"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Method, in DataFrame functions only: every document gets its metrics; for each
language and source the metrics go into logarithmic histograms of bounded size
(relative error 1 %), which merge by adding counts, so partial aggregation
builds them and the sketches of a language and of everything are sums of those
below. From them come the median and the lower decile, and the upper fence of
a metric is median + SPREADS * (median - decile) + MARGIN. The lower half sets
the spread, so a group may hold up to half junk. Groups of fewer than
`min_docs` documents take the fences of their language, then of all. Documents
are then joined with the fences of their group and filtered.

Defined cases: a null or empty text has no words and fails; null and empty
lang or source are one group; repeated documents are judged row by row (and
count in the sketches); an empty table gives no rows; columns named like a
metric give way to it in `features`, and `apply_rules` returns docs' columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlattice.llm.common import SPACE, quoted, read, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
GAMMA = 1.02
LEAST = 1e-4
SPREADS = 6.0
MIN_DOCS = 30
MAX_BROADCAST = 100_000  # groups, of some hundred bytes each; beyond it the fences are joined by shuffling
#: What a metric may exceed the median by in a group without any spread.
MARGINS = {"symbol_rate": 0.02, "upper_rate": 0.1, "dup_line_rate": 0.4, "repeat_rate": 0.2, "word_length": 1.0}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that occur twice or more in the array.

    Windows are compared by 64-bit hashes. Documents without a repeated window
    stop at the distinct count; only others sort their windows.
    """
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places)), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(gaps, F.lit(window), lambda x, y: x + y)

    def repeats(hashes: Column) -> Column:
        runs = _let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(F.filter(F.transform(s, lambda e, k: F.when(_near(s, e, k), e["i"])), lambda p: p.isNotNull())),
        )
        return _let(runs, covered)

    def _near(s: Column, e: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(s, k - 1)["h"] == e["h"])
        return before | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    counted = _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(repeats(hs)))
    return F.when(n < window + 1, 0).otherwise(counted).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """docs with the base counts, the metrics and base_failed."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_repeat_words", "base_failed", *MARGINS, "_words", "_lines"]
    kept = [quoted(c) for c in docs.columns if c.lower() not in added]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(
        *kept,
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    counted = cut.select(
        *[quoted(c) for c in cut.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return counted.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("word_chars", "n_words").alias("word_length"),
    )


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the mergeable sketches of documents that passed the base rules."""
    bucket = lambda v: F.when(v < LEAST, F.lit(0)).otherwise(1 + F.ceil(F.log(v / LEAST) / F.log(F.lit(GAMMA)))).cast("int")
    values = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in MARGINS])
    values = F.when(F.col("base_failed"), F.slice(values, 1, 0)).otherwise(values)  # a filter here would be pushed down and count repeats twice
    rows = measured.select(_group("lang").alias("lang"), _group("source").alias("source"), F.inline(values))
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], spreads: float) -> DataFrame:
    """keys, fences (metric -> fence) and docs."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "metric")
    ranked = merged.select("*", F.sum("n").over(whole.orderBy("bucket")).alias("upto"), F.sum("n").over(whole).alias("docs"))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), F.col("bucket") - 1.5))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("docs") * q, value))
    quantiles = ranked.groupBy(*keys, "metric").agg(at(0.5).alias("median"), at(0.1).alias("low"), F.max("docs").alias("docs"))
    margin = F.element_at(F.create_map(*[F.lit(x) for kv in MARGINS.items() for x in kv]), F.col("metric"))
    fence = F.col("median") + spreads * (F.col("median") - F.col("low")) + margin
    return quantiles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", fence.alias("fence")))).alias("fences"), F.max("docs").alias("docs"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS, spreads: float = SPREADS) -> DataFrame:
    """lang, source and a column fence_<metric> for each metric, one row for each group."""
    own = _fences(sketch, ["lang", "source"], spreads)
    lang = _fences(sketch, ["lang"], spreads).withColumnsRenamed({"fences": "lang_fences", "docs": "lang_docs"})
    every = _fences(sketch.withColumn("all", F.lit(1)), ["all"], spreads).select(F.col("fences").alias("all_fences"), F.lit(1).alias("one"))
    joined = own.withColumn("one", F.lit(1)).join(lang, "lang").join(every, "one")
    chosen = F.when(F.col("docs") >= min_docs, F.col("fences")).when(F.col("lang_docs") >= min_docs, F.col("lang_fences")).otherwise(F.col("all_fences"))
    return joined.select("lang", "source", chosen.alias("f")).select("lang", "source", *[F.element_at("f", m).alias(f"fence_{m}") for m in MARGINS])


def judge(measured: DataFrame, sketch: DataFrame, **options) -> DataFrame:
    """measured (from `features`) with kept, by the fences of each row's group."""
    limits = table(thresholds(sketch, **options).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "quality-fences")
    if limits.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        limits = F.broadcast(limits)
    joined = measured.join(limits, (_group("lang") == F.col("_lang")) & (_group("source") == F.col("_source")), "left")
    within = F.lit(True)
    for m in MARGINS:
        within = within & F.coalesce(F.col(m) <= F.col(f"fence_{m}"), F.lit(True))
    return joined.select(*[quoted(c) for c in measured.columns], F.when(~F.col("base_failed") & within, True).otherwise(False).alias("kept"))


def apply_rules(docs: DataFrame, **options) -> DataFrame:
    """docs that the rules keep, with docs' own columns."""
    own = F.struct(*[quoted(c) for c in docs.columns])
    marked = docs.select(own.alias("kept_row"), "text", "lang", "source")
    sketch = table(sketches(features(docs.select("text", "lang", "source"))), "quality-sketch")
    return judge(features(marked), sketch, **options).filter("kept").select("kept_row.*")


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = table(features(docs), "quality-features")
    return judge(measured, sketches(measured)).select(*BASE)


QUERIES = {"op1_quality_rules": op1_quality_rules}
#: Metric order and constants as above.
_SQL_FENCE = """
 select {keys} metric, any_value(docs) docs, min(case when upto >= docs * 0.5 then v end) med, min(case when upto >= docs * 0.1 then v end) low from (
  select {keys} metric, case when bucket = 0 then 0.0 else 1e-4 * pow(1.02, bucket - 1.5) end v, sum(n) over (partition by {keys} metric order by bucket) upto, sum(n) over (partition by {keys} metric) docs from (
   select {keys} metric, bucket, sum(n) n from sk group by {keys} metric, bucket)) group by {keys} metric"""
SQL = {
    "op1_quality_rules": r"""
with t as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') x from documents),
u as (select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from t),
g as (select doc_id, i, array_to_string(w[i : i + 7], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) i from u where len(w) > 8)),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from (select doc_id, i, count(*) over (partition by doc_id, s) c from g) where c > 1) group by doc_id),
m as (select u.doc_id, lang, source, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) as bigint) word_chars,
  len(regexp_extract_all(x, '[#*$%&|<>]')) n_symbols, len(regexp_extract_all(x, '\p{Lu}')) n_upper, len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
 from u left join rep using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  coalesce(n_symbols / nullif(word_chars, 0), 0) symbol_rate, coalesce(n_upper / nullif(word_chars, 0), 0) upper_rate, coalesce(n_dup_lines / nullif(n_lines, 0), 0) dup_line_rate,
  coalesce(n_repeat_words / nullif(n_words, 0), 0) repeat_rate, coalesce(word_chars / nullif(n_words, 0), 0) word_length from m),
long as (unpivot (select doc_id, lang, source, base_failed, symbol_rate, upper_rate, dup_line_rate, repeat_rate, word_length from f) on symbol_rate, upper_rate, dup_line_rate, repeat_rate, word_length into name metric value v),
sk as (select lang, source, metric, case when v < 1e-4 then 0 else cast(1 + ceil(ln(v / 1e-4) / ln(1.02)) as int) end bucket, count(*) n from long where not base_failed group by all),
own as ("""
    + _SQL_FENCE.format(keys="lang, source,")
    + "), lg as ("
    + _SQL_FENCE.format(keys="lang,")
    + "), al as ("
    + _SQL_FENCE.format(keys="")
    + r"""),
fence as (select own.lang, own.source, own.metric, case when own.docs >= 30 then own.med + 6 * (own.med - own.low) when lg.docs >= 30 then lg.med + 6 * (lg.med - lg.low) else al.med + 6 * (al.med - al.low) end
  + case own.metric when 'symbol_rate' then 0.02 when 'upper_rate' then 0.1 when 'dup_line_rate' then 0.4 when 'repeat_rate' then 0.2 else 1.0 end fence
 from own join lg using (lang, metric) join al using (metric)),
bad as (select distinct doc_id from long join fence using (lang, source, metric) where v > fence)
select doc_id, cast(n_words as bigint) n_words, word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
 not base_failed and bad.doc_id is null kept from f left join bad using (doc_id)
"""
}
