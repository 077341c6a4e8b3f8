"""Benchmark decontamination with a broadcast hash set of token windows.

Method: texts are lower-cased (A-Z only) and cut into words; every run of
`n` words of a benchmark item is a window, an item of fewer words is one
window. Windows are hashed into a set that is broadcast, document windows are
looked up there by a rolling hash over word numbers, every hit is verified
word by word, and hit documents or hit spans are removed.

The broadcast has a proven bound: the benchmark streams through the driver in
blocks of at most `block_bytes` of text (or one item), one at a time; a window
takes 16 bytes, a distinct word about 100. Documents are scanned once for each
block, so that a benchmark of any size works with the same memory.

Defined cases: a null or empty text has no words and no hits; an item without
words has no window; repeated documents are judged row by row; repeated item
ids count once; a null item id is rendered as "null"; an empty benchmark hits
nothing; columns of the input named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.llm.common import quoted, read, slices, table

N = 13
BLOCK_BYTES = 8 << 20
#: Lower-casing comes first in the contract; here the class lets A-Z in and each distinct word is lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}
_ADDED = ("n_words", "n_hit", "hit_starts", "hit_ends", "hit_items")


def item_words(text: str | None) -> list[str]:
    import re

    return re.findall(RAW_WORD, (text or "").translate(LOWER))


class WindowIndex:
    """Windows of one block of the benchmark: word numbers from 1, all items end to end, and for each window size the sorted
    hashes with their places. About 16 bytes a window, besides the block's distinct words."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        import numpy as np

        self.vocabulary: dict[str, int] = {}
        of = self.vocabulary
        self.names, parts, places = [], [], {}
        at = 0
        for item, text in items:
            words = item_words(text)
            if not words:
                continue
            parts.append(np.array([of.setdefault(w, len(of) + 1) for w in words], dtype=np.int32))
            self.names.append((at, item))
            size = min(n, len(words))
            places.setdefault(size, []).append(np.arange(at, at + len(words) - size + 1, dtype=np.int32))
            at += len(words)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        self.starts = np.array([a for a, _ in self.names], dtype=np.int64)
        self.windows: dict[int, tuple] = {}
        for size, found in places.items():
            place = np.concatenate(found)
            hashes = rolling([self.flat[place + j] for j in range(size)])
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = (hashes[order], place[order])

    def compiled(self):
        """For each window size: the sorted hashes and a bit table in front of them."""
        import numpy as np

        out = []
        for size, (hashes, _) in self.windows.items():
            front = np.zeros(1 << 20, dtype=bool)
            front[(hashes >> np.uint64(44)).astype(np.int64)] = True
            out.append((size, hashes, front))
        return out

    def owners(self, ids, size: int, h) -> frozenset[str]:
        """Items that hold these words, compared word by word."""
        import numpy as np

        hashes, place = self.windows[size]
        a, b = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
        same = [p for p in place[a:b].tolist() if (self.flat[p : p + size] == ids).all()]
        return frozenset(self.names[k][1] for k in {int(np.searchsorted(self.starts, p, side="right")) - 1 for p in same})


def rolling(columns):
    """64-bit hash of windows; columns[j] holds word j of each window."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = (h + c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _scanner(index, columns: list[str]):
    def scan(batches):
        import re

        import numpy as np
        import pyarrow as pa

        idx: WindowIndex = index.value
        vocabulary, compiled, find = idx.vocabulary, idx.compiled(), re.compile(RAW_WORD).findall

        class Ids(dict):
            def __missing__(self, word):
                if len(self) > 300_000:
                    self.clear()
                got = self[word] = vocabulary.get(word.translate(LOWER), 0)
                return got

        number = Ids().__getitem__
        held: dict[bytes, frozenset[str]] = {}
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            words = [find(t) if t else [] for t in texts]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            starts = np.zeros(len(words), dtype=np.int64)  # a 0 stands between documents
            np.cumsum(lengths[:-1] + 1, out=starts[1:])
            ids = np.zeros(int(lengths.sum()) + len(words), dtype=np.int64)
            for s, w in zip(starts, words):
                if w:
                    ids[s : s + len(w)] = np.fromiter(map(number, w), dtype=np.int64, count=len(w))
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            hits: dict[int, list] = {}
            for size, hashes, front in compiled:
                at = np.flatnonzero(known[size:] - known[:-size] == size)
                if not len(at):
                    continue
                h = rolling([ids[at + j] for j in range(size)])
                ok = front[(h >> np.uint64(44)).astype(np.int64)]
                at, h = at[ok], h[ok]
                ok = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
                for i, own in zip(at[ok].tolist(), h[ok]):
                    words_at = ids[i : i + size].tobytes()
                    if (owners := held.get(words_at)) is None:
                        if len(held) > 100_000:
                            held.clear()
                        owners = held[words_at] = idx.owners(ids[i : i + size], size, own)
                    if owners:
                        hits.setdefault(int(np.searchsorted(starts, i, side="right")) - 1, []).append((i, size, owners))
            spans_from, spans_to, items = [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
            for d, found in hits.items():
                marked = np.zeros(lengths[d] + 2, dtype=np.int8)
                for i, size, owners in found:
                    marked[i - starts[d] + 1 : i - starts[d] + 1 + size] = 1
                edges = np.flatnonzero(np.diff(marked))
                spans_from[d], spans_to[d] = edges[::2].tolist(), edges[1::2].tolist()
                items[d] = sorted({o for _, _, owners in found for o in owners})
            if "hit_starts" in batch.schema.names:  # a later block: joined with what the earlier ones found
                for d, (a, b, o) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hit_starts", "hit_ends", "hit_items")))):
                    if a:
                        marked = np.zeros(lengths[d] + 2, dtype=np.int8)
                        for x, y in [*zip(a, b), *zip(spans_from[d], spans_to[d])]:
                            marked[x + 1 : y + 1] = 1
                        edges = np.flatnonzero(np.diff(marked))
                        spans_from[d], spans_to[d] = edges[::2].tolist(), edges[1::2].tolist()
                        items[d] = sorted({*o, *items[d]})
            n_hit = [sum(b) - sum(a) for a, b in zip(spans_from, spans_to)]
            new = [pa.array(lengths), pa.array(n_hit, pa.int64()), pa.array(spans_from, pa.list_(pa.int64())), pa.array(spans_to, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + new, names=columns + list(_ADDED))

    return scan


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of bounded bytes, one after the other; rows come to the driver a partition at a time."""
    now, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t"))
    for r in rows.filter("t is not null").toLocalIterator():
        if now and size + len(r.t) > block_bytes:
            yield now
            now, size = [], 0
        now.append((r.i, r.t))
        size += len(r.t)
    yield now


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window),
    hit_starts and hit_ends (word positions, end exclusive) and hit_items
    (sorted item ids as strings)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in _ADDED]
    docs = docs.select([f"`{c}`" for c in kept])
    fields = [docs.schema[c] for c in kept]
    longs = T.ArrayType(T.LongType())
    added = zip(_ADDED, (T.LongType(), T.LongType(), longs, longs, T.ArrayType(T.StringType())))
    schema = T.StructType(fields + [T.StructField(k, t) for k, t in added])
    broadcast = None
    for block in _blocks(benchmark, block_bytes):
        if broadcast is not None:  # what the block before has found is written, and its index goes
            docs = table(docs, "decontaminate")
            broadcast.destroy()
        broadcast = spark.sparkContext.broadcast(WindowIndex(block, n))
        docs = docs.mapInArrow(_scanner(broadcast, kept), schema)
    return docs


def contaminated():
    """The document rule: at least a twentieth of all words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _cut(columns: list[str]):
    def cut(batches):
        import re

        import pyarrow as pa

        find = re.compile(RAW_WORD).finditer
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for d, (a, b) in enumerate(zip(batch.column("hit_starts").to_pylist(), batch.column("hit_ends").to_pylist())):
                if a:
                    at, out, last = [m.span() for m in find(texts[d])], [], 0
                    for x, y in zip(a, b):
                        out.append(texts[d][last : at[x][0]])
                        last = at[y - 1][1]
                    texts[d] = "".join([*out, texts[d][last:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return cut


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit
    words cut out of every text. Columns as in docs."""
    marked = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("kept_row"), "text")
    found = scan(marked, benchmark, n, block_bytes)
    if remove == "documents":
        return found.filter(~contaminated()).select("kept_row.*")
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cut = found.mapInArrow(_cut(marked.columns), marked.schema)
    return cut.select(*[F.col("text") if c == "text" else F.col(f"kept_row.`{c}`").alias(c) for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


QUERIES = {"op2_decontaminate": op2_decontaminate}
#: Windows of 13 words are joined with the benchmark's by text.
SQL = {
    "op2_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
bw as (select distinct item, least(len(w), 13) k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') g from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from b where len(w) > 0)),
sizes as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, sizes where len(w) >= k)),
m as (select doc_id, i, bw.k, item from dw join bw on dw.k = bw.k and dw.g = bw.g),
hit as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from m)) group by doc_id),
its as (select doc_id, count(*) n, string_agg(item, ',' order by item) s from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(hit.n, 0) as bigint) n_hit, cast(coalesce(its.n, 0) as bigint) n_items,
 sha256(coalesce(its.s, '')) items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""
}
