"""Line dedup by pairwise alignment of documents that share lines.

Method: lines are hashed, and so are runs of adjacent lines that just reach
`min_words` words, one from each line on and one back from each line. For every
run found in more than one document the first of them (least doc_id) is its
holder, so that a later document has one partner for each of its shared runs at
most and a run shared by n documents costs n pairs, however common it is. Every
line of a passage of `min_words` words or more is in such a run inside it, so no
passage lacks a partner; nothing is capped. Each later document is aligned with
each partner by patience diff over line hashes: lines that occur once in both
are anchors, the longest increasing run of anchors is kept, matches grow from
the anchors and the gaps between them are aligned in turn. Aligned blocks of
adjacent lines with at least `min_words` words are deleted from the later one;
what is left of it is compared with the partner's runs once more, for passages
that one alignment can't hold: repeated, in another order or without anchors.

Defined cases: a null or empty text has no lines with words and stays as it is;
lines are compared after trimming; lines without words never match; ties of
doc_id are ordered by a hash of the text, exact repeats of a row (same id and
text) stay; rows without an id stay; a doc_id that is no integer fails the cast; an empty table gives no rows; columns of
the input named like a result column give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.llm.common import quoted, read, slices, table

MIN_WORDS = 50
_ADDED = ("n_lines", "n_removed")


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(from, to) of the shortest runs of min_words words or more that start at a line, and of those that end at one; every line has words."""
    out, at, total = [], 0, 0
    for k, w in enumerate(words):
        total += w
        if total < min_words and at:
            out.append((at - 1, k + 1))
        while total >= min_words and at <= k:
            out.append((at, k + 1))
            total -= words[at]
            at += 1
    return out


def _lines(min_words: int):
    def run(batches):
        from array import array

        import pyarrow as pa
        import xxhash

        for batch in slices(batches):
            hashes, words, runs = [], [], []
            for t in batch.column("text").to_pylist():
                lines = [x.strip() for x in t.split("\n")] if t else []
                hashes.append([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) if x else 0 for x in lines])
                words.append([len(x.split()) for x in lines])
                own = array("q", [h for h in hashes[-1] if h]).tobytes()
                runs.append(list({xxhash.xxh64_intdigest(own[8 * a : 8 * b]) - (1 << 63) for a, b in windows([w for h, w in zip(hashes[-1], words[-1]) if h], min_words)}))
            ints = [pa.array(x, pa.list_(kind)) for x, kind in ((hashes, pa.int64()), (words, pa.int32()), (runs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *ints], names=["id", "th", "hashes", "words", "runs"])

    return run


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both places; pairs come sorted by the first."""
    from bisect import bisect_left

    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[k] = last[at - 1] if at else -1
        tails[at:at + 1], last[at:at + 1] = [b], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) with a[i] == b[j] != 0, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, list] = {}
        for i in range(a0, a1):
            once.setdefault(a[i], [0, 0, 0, 0])
            once[a[i]][0] += 1
            once[a[i]][1] = i
        for j in range(b0, b1):
            if b[j] in once:
                once[b[j]][2] += 1
                once[b[j]][3] = j
        anchors = _increasing(sorted((x[1], x[3]) for h, x in once.items() if h and x[0] == 1 == x[2]))
        if anchors:
            at, bt = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                if i > at and j > bt:
                    todo.append((at, i, bt, j))
                if i < a1:
                    out.append((i, j))
                at, bt = i + 1, j + 1
    return sorted((i, j) for i, j in out if a[i])


def removed(later: list[int], earlier: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of `later` in aligned blocks (adjacent in both but for lines without words) of min_words words or more."""
    out, block, last = [], [], None
    for i, j in [*patience(later, earlier), (None, None)]:
        near = last is not None and i is not None and all(not later[k] for k in range(last[0] + 1, i)) and all(not earlier[k] for k in range(last[1] + 1, j))
        if not near:
            if sum(words[k] for k in block) >= min_words:
                out += block
            block = []
        if i is not None:
            block.append(i)
            last = (i, j)
    return sorted({*out, *_in_runs(later, earlier, words, min_words)}) if len(out) < sum(map(bool, later)) else out


def _in_runs(later: list[int], earlier: list[int], words: list[int], min_words: int) -> set[int]:
    """Lines of `later` in runs of min_words words or more that `earlier` holds anywhere."""
    from array import array

    count = {h: w for h, w in zip(later, words) if h}
    held, part = set(), []
    for h in [*earlier, None]:
        if h in count:
            part.append(h)
        elif h != 0:  # not in `later`, or the end
            own = array("q", part).tobytes()
            held.update(own[8 * a : 8 * b] for a, b in windows([count[x] for x in part], min_words))
            part = []
    if not held:
        return set()
    at = [k for k, h in enumerate(later) if h]
    own = array("q", [later[k] for k in at]).tobytes()
    return {k for a, b in windows([words[k] for k in at], min_words) if own[8 * a : 8 * b] in held for k in at[a:b]}


def _align(min_words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, ths, at = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "th", "hashes", "words", "earlier")))
            for i, th, a, words, b in rows:
                for k in removed(a, b, words, min_words):
                    ids.append(i)
                    ths.append(th)
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(at, pa.int32())], names=["id", "th", "line"])

    return run


def _cut(columns: list[str]):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts, lines, gone = [], [], []
            for t, out in zip(batch.column("text").to_pylist(), batch.column("_out").to_pylist()):
                cut = t.split("\n") if t else []
                drop = set(out or ())
                texts.append("\n".join(x for k, x in enumerate(cut) if k not in drop) if drop else t)
                lines.append(len(cut))
                gone.append(len(drop))
            new = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*new, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, *_ADDED])

    return run


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cut, n_lines (before) and n_removed."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    lines = keyed.filter("id is not null and text is not null").mapInArrow(_lines(min_words), "id bigint, th bigint, hashes array<bigint>, words array<int>, runs array<bigint>")
    lines = table(lines, "lines")
    entries = lines.select("id", "th", F.explode("runs").alias("hash"))
    key = F.struct("id", "th")
    holders = entries.groupBy("hash").agg(F.min(key).alias("first"), F.max(key).alias("last")).filter("first <> last").select("hash", "first")
    holders = table(holders, "lines-holders")  # so that the join has two exchanges, and a common run's rows are dealt to several tasks
    pairs = entries.join(holders, "hash").filter(key != F.col("first")).select("id", "th", F.col("first.id").alias("fid"), F.col("first.th").alias("fth")).distinct()
    one = lines.drop("runs").dropDuplicates(["id", "th"])
    sides = pairs.join(one, ["id", "th"]).join(one.select(F.col("id").alias("fid"), F.col("th").alias("fth"), F.col("hashes").alias("earlier")), ["fid", "fth"])
    out = sides.select("id", "th", "hashes", "words", "earlier").mapInArrow(_align(min_words), "id bigint, th bigint, line int").distinct()
    out = table(out.groupBy("id", "th").agg(F.collect_list("line").alias("_out")), "lines-out")  # of one document
    kept = [c for c in docs.columns if c.lower() not in (*_ADDED, "_out")]
    schema = T.StructType([T.StructField(c, T.StringType()) if c == "text" else docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in _ADDED])
    joined = docs.select(*[quoted(c) for c in kept]).join(out.hint("merge"), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("th")), "left")
    return joined.select(*[quoted(c) for c in kept], "_out").mapInArrow(_cut(kept), schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
#: Lines of the shortest runs with 50 words, from each line on and back, that any earlier document holds.
SQL = {
    "op6_line_dedup": r"""
with d as (select doc_id, text, case when coalesce(text, '') = '' then []::varchar[] else string_split(text, chr(10)) end ls from documents),
l as (select doc_id, k, ls[k] raw, trim(ls[k], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) t from (select doc_id, ls, unnest(range(1, len(ls) + 1)) k from d)),
x as (select *, sum(w) over (partition by doc_id order by k) c, row_number() over (partition by doc_id order by k) j from (select doc_id, k, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) w from l where t <> '')),
runs as (select a.doc_id, a.j, min(b.j) z from x a join x b on a.doc_id = b.doc_id and b.c >= a.c - a.w + 50 and b.j >= a.j group by all
 union select b.doc_id, max(a.j), b.j from x b join x a on a.doc_id = b.doc_id and b.c >= a.c - a.w + 50 and a.j <= b.j group by b.doc_id, b.j),
held as (select doc_id, list(t order by j) ts from x group by doc_id),
keyed as (select r.doc_id, r.j, r.z, md5(array_to_string(ts[r.j : r.z], chr(10))) g from runs r join held using (doc_id)),
gone as (select distinct doc_id, unnest(range(j, z + 1)) j from (select *, min(doc_id) over (partition by g) first from keyed) where first < doc_id),
cut as (select l.doc_id, count(*) n_lines, count(gone.j) n_removed, coalesce(string_agg(raw, chr(10) order by l.k) filter (gone.j is null), '') kept
 from l left join x on x.doc_id = l.doc_id and x.k = l.k left join gone on gone.doc_id = x.doc_id and gone.j = x.j group by l.doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(length(coalesce(kept, '')) as bigint) n_chars, sha256(coalesce(kept, '')) text_sha256
from d left join cut using (doc_id)
"""
}
