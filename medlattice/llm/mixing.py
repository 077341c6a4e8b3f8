"""Mixing sources to target weights by capped water-filling.

Method, in DataFrame functions only: each source's target is its weight's
share of the wanted words, clamped at `max_epochs` times its size; what the
clamp frees goes to the others by weight until none is above (solved in one
pass over the sources ordered by size / weight). A source is then taken
floor(target / size) times as a whole, and the rest by a seeded sample: a
document is in the sample if its seeded hash is at most its source's cut. The
cut is searched exactly: word sums by the upper 12 bits of the hash, then by
the next 12 bits inside the bucket where the target falls, then hash by hash
in what is left, so no source is gathered in one task. Rows that share the
cut's hash (exact repeats of id, source and text) are written once with a
number each, counted by task, and as many of them are taken as the target
wants: a source's words miss its target by half a document at most, whatever
repeats. Targets are computed over one row for each source, in one task.

Defined cases: a null or empty text has size 0 and is repeated like others; a
null source is a source of its own, last in order; of exact repeats any may be
taken, always the same number; an empty table gives no rows; a source of size 0
has target 0; columns of the input named like a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlattice.llm.common import n_words, quoted, read, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 42
_ADDED = ("size", "source_size", "target", "times", "taken", "_hash", "_seq", "_task", "_s", "_cut", "_some", "_of")


def _hash(seed: int) -> Column:
    """63 bits of a document, of which the upper 60 are seeded digest bits."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("~"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), text("doc_id"), text("source"), F.md5(text("text"))))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), 3)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    kept = [quoted(c) for c in docs.columns if c.lower() not in _ADDED]
    return docs.select(*kept, n_words(F.col("text")).alias("size")).withColumn("_hash", _hash(seed))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, whole (repetitions) and rest (words to sample), one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.select("*", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.select("source", "source_size", F.get(cycle, F.col("rank") % len(weights)).alias("w"), (F.lit(max_epochs) * F.col("source_size")).alias("cap"))
    every = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    filled = weighted.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every)).alias("wanted"),
        (F.sum("cap").over(order) - F.col("cap")).alias("before"),
        (F.sum("w").over(every) - F.sum("w").over(order) + F.col("w")).alias("open"),
        F.row_number().over(order).alias("k"),
    )
    fill = (F.col("wanted") - F.col("before")) / F.col("open")  # the level if this source and all after it stay below their caps
    level = F.min(F.when(fill <= F.col("cap") / F.col("w"), F.struct(F.col("k"), fill.alias("level")))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    done = filled.select("source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return done.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))


def _bits(hash63: Column, level: int) -> Column:
    """12 bits of the hash: the upper ones at level 0."""
    return F.shiftrightunsigned(hash63, 51 - 12 * level).bitwiseAND(F.lit(4095))


def cuts(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """source, whole, cut: documents whose hash is at most cut are in the sample."""
    left = sizes.select(F.col("source").alias("_s"), "_hash", "size")
    now = aims.select("source", "whole", F.col("rest").alias("need"), F.lit(0).cast("long").alias("prefix"), (F.col("rest") > 0).alias("open"))
    for level in range(2):
        match = F.col("_s").eqNullSafe(F.col("source")) & (F.shiftrightunsigned(F.col("_hash"), 63 - 12 * level) == F.col("prefix"))
        inside = left.join(now.filter("open"), match).groupBy("source", _bits(F.col("_hash"), level).alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("b")  # 4096 rows at most
        upto = inside.select("*", F.sum("n").over(run).alias("upto")).withColumnRenamed("source", "_s")
        at = upto.join(now.filter("open"), F.col("_s").eqNullSafe(F.col("source"))).filter(F.col("upto") >= F.col("need"))
        step = at.groupBy(F.col("source").alias("_src")).agg(F.min(F.struct("b", "upto", "n")).alias("x"))
        joined = now.join(step, F.col("source").eqNullSafe(F.col("_src")) & F.col("open"), "left")
        go = F.col("open") & F.col("x").isNotNull()
        now = joined.select(
            "source",
            "whole",
            F.when(go, F.col("need") - (F.col("x.upto") - F.col("x.n"))).otherwise(F.col("need")).alias("need"),
            F.when(go, F.col("prefix") * 4096 + F.col("x.b")).otherwise(F.col("prefix") * 4096 + 4095).alias("prefix"),
            go.alias("open"),
        )
        now = table(now, "mixing-cut")
    low = F.shiftleft(F.col("prefix"), 39)  # the first hash inside the bucket
    match = F.col("_s").eqNullSafe(F.col("source")) & (F.shiftrightunsigned(F.col("_hash"), 39) == F.col("prefix"))
    rows = left.join(now.filter("open"), match).groupBy("source", "need", "_hash").agg(F.sum("size").alias("n"), F.count("*").alias("of"), F.max("size").alias("size"))
    run = Window.partitionBy("source").orderBy("_hash")
    reached = rows.select("*", (F.sum("n").over(run) - F.col("n")).alias("before")).filter(F.col("before") + F.col("n") >= F.col("need"))
    last = reached.groupBy(F.col("source").alias("_src")).agg(F.min(F.struct("_hash", "of", "size", "before")).alias("x"))
    out = now.join(last, F.col("source").eqNullSafe(F.col("_src")), "left")
    some = F.least(F.col("x.of"), F.round((F.col("need") - F.col("x.before")) / F.greatest(F.lit(1), F.col("x.size"))).cast("long"))
    every = ~F.col("open")
    return out.select(
        "source",
        "whole",
        F.when(every, F.when(F.col("need") > 0, F.lit((1 << 63) - 1)).otherwise(-1)).otherwise(F.coalesce("x._hash", low - 1)).alias("cut"),
        F.when(every, F.lit(1)).otherwise(F.coalesce(some, F.lit(1))).alias("some"),
        F.when(every, F.lit(1)).otherwise(F.coalesce("x.of", F.lit(1))).alias("of"),
    )


def _numbered(tied: DataFrame) -> DataFrame:
    """Rows at their source's cut, with their number among these: counted by task, then within each task."""
    rows = table(tied.withColumn("_seq", F.monotonically_increasing_id()), "mixing-ties").withColumn("_task", F.shiftright("_seq", 33))
    tasks = rows.groupBy("_s", "_task").agg(F.count("*").alias("_n"))
    before = tasks.select(F.col("_s").alias("_s2"), F.col("_task").alias("_t2"), (F.sum("_n").over(Window.partitionBy("_s").orderBy("_task")) - F.col("_n")).alias("_before"))
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_s", "_task").orderBy("_seq")))
    same = F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_task") == F.col("_t2"))
    return inside.join(before, same).withColumn("_n", F.col("_n") + F.col("_before")).drop("_seq", "_task", "_s2", "_t2", "_before")


def plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """docs with size, source_size, target, times and taken (words)."""
    rows = sized(docs, seed)
    sizes = table(rows.select("doc_id", "source", "size", "_hash"), "mixing-sizes")
    aims = table(targets(sizes, **options), "mixing-targets")
    limits = cuts(sizes, aims).join(aims.select(F.col("source").alias("_a"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_a")))
    limits = table(limits.select(F.col("source").alias("_s"), "source_size", "target", F.col("whole").alias("_whole"), F.col("cut").alias("_cut"), F.col("some").alias("_some"), F.col("of").alias("_of")), "mixing-limits")
    joined = rows.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left")
    own = [quoted(c) for c in rows.columns if c not in ("_hash", "size")]
    ties = (F.col("_hash") == F.col("_cut")) & (F.col("_some") > 0) & (F.col("_some") < F.col("_of"))

    def done(df: DataFrame, more: Column) -> DataFrame:
        times = F.col("_whole") + F.when(more, 1).otherwise(0)
        return df.select(*own, "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))

    clear = done(joined, (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & (F.col("_some") >= F.col("_of"))))
    if limits.filter((F.col("_some") > 0) & (F.col("_some") < F.col("_of"))).isEmpty():
        return clear
    clear = done(joined.filter(~F.coalesce(ties, F.lit(False))), (F.col("_hash") < F.col("_cut")) | ((F.col("_hash") == F.col("_cut")) & (F.col("_some") >= F.col("_of"))))
    return clear.unionByName(done(_numbered(joined.filter(ties)), F.col("_n") <= F.col("_some")))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """docs repeated as the plan says, with docs' own columns."""
    own = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    planned = plan(own, seed, **options).filter("times > 0")
    return planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mix_sources": op10_mix_sources}
#: Targets level by level, and each source in order of its documents' digests up to its target.
SQL = {
    "op10_mix_sources": r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
 cast('0x' || substr(md5(concat_ws('|', '42', coalesce(cast(doc_id as varchar), '~'), coalesce(source, '~'), md5(coalesce(text, '~')))), 1, 15) as bigint) h from documents),
s as (select source, sum(size) n, row_number() over (order by source nulls last) - 1 k from d group by source),
w as (select *, [5, 2, 1][k % 3 + 1] w, 2 * n cap, 1.5 * sum(n) over () wanted from s),
f as (select *, sum(cap) over o - cap b, sum(w) over () - sum(w) over o + w open from w window o as (order by cap / w, source nulls last)),
l as (select min_by((wanted - b) / open, cap / w) filter ((wanted - b) / open <= cap / w) level from f),
t as (select source, n, case when level is null then cap else least(cap, level * w) end target from f, l),
r as (select *, case when n > 0 then floor(target / n) else 0 end whole from t),
g as (select source, h, count(*) c, max(size) size, sum(sum(size)) over (partition by source order by h) upto, sum(size) n from d group by source, h),
c as (select r.*, target - whole * r.n need from r),
x as (select c.source, min_by({'h': g.h, 'part': least(g.c, round((need - (upto - g.n)) / greatest(1, g.size)))}, g.h) best from c join g on c.source is not distinct from g.source where need > 0 and upto >= need group by c.source),
o as (select d.*, row_number() over (partition by source, h) i from d)
select o.doc_id, o.size, cast(c.n as bigint) source_size, c.target,
 cast(o.size * (whole + case when need <= 0 then 0 when x.best is null or o.h < x.best.h then 1 when o.h = x.best.h and i <= x.best.part then 1 else 0 end) as bigint) taken
from o join c on o.source is not distinct from c.source left join x on o.source is not distinct from x.source
"""
}
