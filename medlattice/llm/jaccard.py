"""Exact n-gram Jaccard join in Voronoi regions of pivots, and components of its links.

Documents are sets of distinct word n-grams; the Jaccard distance of sets is a
metric. Two documents link if their similarity is at least `percent` / 100, that
is, if their distance is at most r = 1 - percent / 100.

1. Pivots are PIVOTS documents chosen by hash, with at most PIVOT_GRAMS n-grams
   altogether, which bounds their broadcast. Exact distances from a document to
   all of them come from one look-up of its n-grams. It goes to the region of
   the nearest pivot (its home, at distance h) and, as the boundary window, to
   each pivot within h + 2r: of a linked pair each is then in the other's home.
2. Where h + 2r reaches 1, the window holds all pivots, as every document
   without a shared n-gram is at distance 1. So documents with h >= 1 - 2r are
   "far", and those with h >= 1 - 3r join them (the triangle inequality: what
   links with a far one is no nearer). Distances concentrate there, and pivots
   can't tell them apart; the far region is divided by agreement on parts of the
   n-gram universe instead, which is as exact: within a group of sizes a linked
   pair differs in at most D n-grams, so of D + 1 + S hashed parts of the
   universe it agrees on at least 1 + S; unless more than S parts are empty, one
   of them isn't. A document goes to one region for each part.
3. In a region the least document is a pivot again: distances to it are computed
   exactly, each pair once; linked documents join components, and a region that
   lies in one component is done. So a group of n copies costs n distances.
4. Regions of at most SMALL documents are compared in one task by parity
   sketches (the distance of two sketches never exceeds the sets' symmetric
   difference, so only pairs that can't link are left out), and what is left
   between components is computed exactly. Larger regions are divided as in 1,
   by pivots of their own documents (a far document stays in what is left of
   its region), and join recursively. A region that this doesn't make smaller,
   or whose windows replicate its documents more than REPLICAS times on average,
   is dealt to tasks as pairs of blocks of SMALL documents instead.

The rounds are as many as a region has levels, whatever the number of its
components. Nothing is capped.

Hashes of words and n-grams have 64 bits. Defined cases: a null or empty text
has no n-grams and links with nothing; fewer than n words are one n-gram; rows
with the same doc_id are one document, which links as any exact copy of one of
its texts does and else by the greatest of them; a doc_id that is no integer
fails the cast; rows with a null doc_id link with nothing and have a null
component; an empty table gives no rows; columns of the input named like a
result column give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.llm.common import WORD, quoted, read, slices, table, temporary
from medlattice.llm.components import components

N = 3
PERCENT = 90
SPARE = 2
PIVOTS = 256
PIVOT_GRAMS = 500_000
PIVOT_CHARS = 200_000  # longer texts don't become pivots
SMALL = 4096
REPLICAS = 4
SKETCH_BITS = 512
WIDE_BITS = 2048  # for pairs, which are fewer than the entries of regions
FEW_IDS = 1_000_000  # up to so many ids are broadcast to find their texts
LOWER = {c: c + 32 for c in range(65, 91)}
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(_M1)
    return (h ^ (h >> np.uint64(29))) * np.uint64(_M2)


class Grams:
    """Distinct n-gram hashes of texts, sorted."""

    def __init__(self, n: int):
        import re

        import xxhash

        class Words(dict):
            def __missing__(self, word):
                if len(self) > 200_000:
                    self.clear()
                got = self[word] = xxhash.xxh64_intdigest(word.translate(LOWER).encode("utf-8", "surrogatepass"))
                return got

        self.n, self.find, self.number = n, re.compile(WORD).findall, Words().__getitem__

    def __call__(self, text: str | None):
        import numpy as np

        words = self.find(text) if text else ()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        ids = np.fromiter(map(self.number, words), dtype=np.uint64, count=len(words))
        size = min(self.n, len(ids))
        with np.errstate(over="ignore"):
            h = np.full(len(ids) - size + 1, size, dtype=np.uint64)
            for j in range(size):
                h = _mix(h + ids[j : len(ids) - size + 1 + j])
        return np.unique(h)


class Pivots:
    """Sets of the pivots, looked up by n-gram; names: their regions' keys."""

    def __init__(self, sets, percent: int):
        import hashlib

        import numpy as np

        self.radius = (100 - percent) / 100
        self.sizes = np.array([len(g) for g in sets], dtype=np.int64)
        self.names = np.array([int.from_bytes(hashlib.blake2b(g.tobytes(), digest_size=8).digest(), "big", signed=True) for g in sets], dtype=np.int64)
        grams = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(grams, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.grams, self.starts = np.unique(grams[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(grams))

    def distances(self, grams):
        """Exact distances to all pivots."""
        import numpy as np

        if not len(self.sizes):
            return np.ones(0)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = at[self.grams[at] == grams]
        if not len(at):
            return np.ones(len(self.sizes))
        first, n = self.starts[at], self.ends[at] - self.starts[at]
        places = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        both = np.bincount(self.owners[places], minlength=len(self.sizes))
        return 1 - both / (self.sizes + len(grams) - both)

    def regions(self, grams):
        """(keys of the Voronoi regions with their windows, whether it is in the far region, pivots within the window)."""
        d = self.distances(grams)
        home = d.min() if len(d) else 1.0
        window = d <= home + 2 * self.radius + 1e-9
        near = self.names[window] if home < 1 - 2 * self.radius else self.names[:0]
        return near, home >= 1 - 3 * self.radius - 1e-9, int(window.sum())


class Sizes:
    """Groups of sizes: a set in the interval [bounds[g], bounds[g + 1]) is in group g and, unless it is too large to link
    with any set of the interval before, in group g - 1. Linked sets are in the group of the smaller one."""

    def __init__(self, percent: int):
        self.percent, self.bounds, self.parts = percent, [1], []

    def grow(self, size: int) -> None:
        from math import exp

        p = self.percent
        while self.bounds[-1] <= size:
            a = self.bounds[-1]
            b = max(a + 1, -(-a * 10_000 // (p * p)))
            most = (100 - p) * (b - 1 + self.top(b)) // (100 + p)  # n-grams in which a linked pair differs
            spare = SPARE
            while spare < most and (most + 1 + spare) * exp(-a / (most + 1 + spare)) * 1.5 + 1 > spare:
                spare += 1  # parts are seldom empty then
            self.bounds.append(b)
            self.parts.append((most, spare))

    def top(self, bound: int) -> int:
        """The greatest size that links with a size below the bound."""
        return (bound - 1) * 100 // self.percent

    def groups(self, size: int) -> list[tuple[int, int, int]]:
        """(group, D, S) of each group of a size."""
        from bisect import bisect_right

        self.grow(size)
        k = bisect_right(self.bounds, size) - 1
        return [(g, *self.parts[g]) for g in ((k, k - 1) if k and size <= self.top(self.bounds[k]) else (k,))]


def signatures(grams, sizes: Sizes, salt: int):
    """Region keys of one set: one for each part of the universe, for each group of its size."""
    import numpy as np

    out = []
    with np.errstate(over="ignore"):
        for group, most, spare in sizes.groups(len(grams)):
            if most < 1:
                continue  # only equal sets link, and those have the same fingerprint
            parts = most + 1 + spare
            h = _mix(grams + np.uint64((salt * 0x9E3779B1 + group * 0x1000193) & 0xFFFFFFFFFFFFFFFF))
            part = (h % np.uint64(parts)).astype(np.int64)
            count = np.bincount(part, minlength=parts)
            low = np.bincount(part, weights=(grams & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=parts)  # exact: below 2^53
            high = np.bincount(part, weights=(h >> np.uint64(32)).astype(np.float64), minlength=parts)
            key = _mix(low.astype(np.uint64) + np.uint64(group)) ^ (high.astype(np.uint64) * np.uint64(_M1))
            key = _mix(key + np.arange(parts, dtype=np.uint64) * np.uint64(_M2) + count.astype(np.uint64))
            if int((count == 0).sum()) <= spare:
                key = key[count > 0]
            out.append(key)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def sketch(grams, bits: int = SKETCH_BITS) -> list[int]:
    """Parities of the n-grams that hash to each of some bits."""
    import numpy as np

    with np.errstate(over="ignore"):
        at = (_mix(grams ^ np.uint64(_M2)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64).tolist()


def _met(batches):
    """key, x, p of the keys that more than one x has; rows come sorted by key and x, and p is the key's least x. Rows stream
    through, whatever a key holds."""
    import numpy as np
    import pyarrow as pa

    last, told = None, True  # the last row (key, x, p), and whether it has been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        k, x = batch.column("key").to_numpy(), batch.column("x").to_numpy()
        if last is not None:
            k, x = np.append(last[0], k), np.append(last[1], x)
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
        if last is not None:
            new[0] = True
        k, x = k[new], x[new]
        first = np.ones(len(k), dtype=bool)
        first[1:] = k[1:] != k[:-1]
        start = np.flatnonzero(first)
        p = np.repeat(x[start], np.diff(np.append(start, len(k))))
        if last is not None:
            p[: start[1] if len(start) > 1 else len(k)] = last[2]
        many = ~first
        many[:-1] |= ~first[1:]
        if last is not None:
            many[0] = not told and len(k) > 1 and not first[1]
        end = (k[-1:], x[-1:], p[-1])
        # The last row of a batch waits for the next one unless it is known to be among several.
        told = bool(not first[-1]) or (len(k) == 1 and last is not None and told)
        last = end
        yield pa.RecordBatch.from_arrays([pa.array(k[many]), pa.array(x[many]), pa.array(p[many])], names=["key", "x", "p"])


def _small_regions(percent: int):
    """Pairs of different components in each region that sizes and sketches don't exclude; rows come sorted by key."""

    def close(x, n, comp, bits):
        import numpy as np

        order = np.argsort(n, kind="stable")
        x, n, comp, bits = x[order], n[order], comp[order], bits[order]
        for i in range(len(x) - 1):
            to = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            js = np.arange(i + 1, to)
            js = js[comp[js] != comp[i]]
            if len(js):
                apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
                js = js[apart * (100 + percent) <= (100 - percent) * (n[js] + n[i])]
                for j in js.tolist():
                    yield (int(x[i]), int(x[j])) if x[i] > x[j] else (int(x[j]), int(x[i]))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows, key, found, sent = [], None, [], set()

        def done():
            if len(rows) > 1:
                x, n, comp, raw = zip(*rows)
                bits = np.array(raw, dtype=np.int64).view(np.uint64)
                for pair in close(np.array(x), np.array(n), np.array(comp), bits):
                    if pair not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(pair)
                        found.append(pair)
            rows.clear()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["x", "p"])
            found.clear()
            return got

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "n", "component", "sketch"))):
                if k != key:
                    done()
                    key = k
                rows.append(row)
            if len(found) > 100_000:
                yield out()
        done()
        yield out()

    return run


def _features(n: int, percent: int, pivots):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        of, sizes_, known, seen = Grams(n), Sizes(percent), pivots.value, set()
        none = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            sizes, prints, keys, sketches, wide, near, window = [], [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                g = of(text)
                sizes.append(len(g))
                sketches.append(sketch(g) if len(g) else None)
                wide.append(sketch(g, WIDE_BITS) if len(g) else None)
                prints.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                own, far, within = none, False, 0
                if len(g) and prints[-1] not in seen:  # further copies in this task share the first one's regions
                    if doc is not None and len(seen) < 1_000_000:
                        seen.add(prints[-1])
                    own, far, within = known.regions(g)
                keys.append(np.concatenate((own, signatures(g, sizes_, 0))) if far else own)
                near.append(len(own))
                window.append(within)
            lengths = np.cumsum([0, *map(len, keys)])
            flat = pa.array(np.concatenate(keys) if keys else none)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat), pa.array(sketches, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(near, pa.int32()), pa.array(window, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "print", "keys", "sketch", "wide", "near", "window"])

    return run


def _divide(n: int, pivots):
    """The regions, inside those of key, of pivots; 0 stands for what is far from all."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of, known = Grams(n), pivots.value
        for batch in slices(batches, 1_000_000):
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                near, far, _ = known.regions(of(t))
                own = np.append(near, 0) if far else near
                with np.errstate(over="ignore"):
                    out.append(_mix(_mix(own.view(np.uint64)) + np.uint64(k & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "x", "c")), pa.array(out, pa.list_(pa.int64()))], names=["key", "x", "c", "keys"])

    return run


def _compare(n: int, percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = Grams(n)
        last, pivot = None, None
        for batch in batches:
            shared, union = [], []
            for p, tx, tp in zip(batch.column("p").to_pylist(), map(str, batch.column("text_x")), map(str, batch.column("text_p"))):
                if p != last:
                    last, pivot = p, of(tp)
                x = of(tx)
                both = len(np.intersect1d(x, pivot, assume_unique=True))
                shared.append(both)
                union.append(len(x) + len(pivot) - both)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("p"), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["x", "p", "shared", "either"])

    return run


def _verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs x, p with shared, either (sizes of intersection and union) and linked."""
    a = pairs.join(texts.select(F.col("node").alias("x"), F.col("text").alias("text_x")).hint("merge"), "x")
    b = a.join(texts.select(F.col("node").alias("p"), F.col("text").alias("text_p")).hint("merge"), "p")  # so sorted by pivot
    out = b.select("x", "p", "text_x", "text_p").mapInArrow(_compare(n, percent), "x bigint, p bigint, shared bigint, either bigint")
    return table(out.withColumn("linked", 100 * F.col("shared") >= percent * F.col("either")), "jaccard-pairs")


def pivot_sets(docs: DataFrame, n: int = N, pivots: int = PIVOTS, salt: int = 0) -> list:
    """n-gram sets of about `pivots` documents chosen by hash, of PIVOT_GRAMS n-grams at most altogether."""
    total, h = docs.filter("doc_id is not null").count(), F.xxhash64(F.lit(salt), "doc_id")
    chosen = docs.filter((F.pmod(h, F.lit(max(1, total))) < pivots) & (F.length("text") <= PIVOT_CHARS))
    of, out, size = Grams(n), {}, 0
    for r in chosen.select("doc_id", "text").orderBy(h, "text").limit(2 * pivots).toLocalIterator():
        g = of(r.text)
        if len(g) and g.tobytes() not in out and size + len(g) <= PIVOT_GRAMS:
            out[g.tobytes()] = g
            size += len(g)
    return list(out.values())


def features(docs: DataFrame, n: int = N, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n, print, keys of regions, sketches, near (Voronoi regions, which come first), window (pivots within the home's window)."""
    sets = docs.sparkSession.sparkContext.broadcast(Pivots(pivot_sets(docs, n, pivots), percent))
    return docs.mapInArrow(_features(n, percent, sets), "doc_id bigint, n bigint, print binary, keys array<bigint>, sketch array<bigint>, wide array<bigint>, near int, window int")


def paths(docs: DataFrame, n: int = N, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """One row: distinct documents; those in Voronoi regions and their entries; those in the far region and their entries; and
    the entries that windows alone would make."""
    feats = features(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), n, percent, pivots).filter("n > 0 and window > 0")
    far = F.size("keys") > F.col("near")
    return feats.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("near") > 0).alias("near"),
        F.sum("near").alias("near_entries"),
        F.count_if(far).alias("far"),
        F.sum(F.size("keys") - F.col("near")).alias("far_entries"),
        F.sum("window").alias("window_entries"),
    )


def join(docs: DataFrame, n: int = N, percent: int = PERCENT, pivots: int = PIVOTS, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of docs; written once, and what led to it is deleted."""
    with temporary(docs.sparkSession):
        return table(_join(docs, n, percent, pivots, small), "jaccard-joined", keep=True)


def _several(entries: DataFrame) -> DataFrame:
    """key, x, p of the regions with more than one document; a region of any size is dealt to several tasks."""
    many = entries.groupBy("key").agg(F.min("x").alias("p"), F.max("x").alias("q")).filter("p <> q").select("key", "p")
    return entries.select("key", "x").join(many, "key")


def _prepared(feats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of the features: sizes (doc_id, n of each row); alias (doc_id, node of documents that equal a lesser one); regions (key,
    x, p); and what tells nodes apart (node, n, sketch, wide)."""
    sizes = table(feats.select("doc_id", "n"), "jaccard-sizes", keep=True)
    known = feats.filter("doc_id is not null and n > 0")
    nodes = table(known.groupBy("print").agg(F.min("doc_id").alias("node")), "jaccard-nodes")  # equal sets are one node
    member = known.select("doc_id", "print").join(nodes, "print")
    alias = table(member.filter("doc_id <> node").select("doc_id", "node").distinct(), "jaccard-copies", keep=True)
    # Voronoi regions hold any share of all documents and few entries; parts make many entries, nearly all of them alone with
    # their key, and no large regions, as pivots take those: each of their entries is shuffled once.
    voronoi = _several(known.select(F.explode(F.slice("keys", 1, F.col("near"))).alias("key"), F.col("doc_id").alias("x")))
    parts = known.select(F.explode(F.slice("keys", F.col("near") + 1, F.greatest(F.lit(0), F.size("keys") - F.col("near")))).alias("key"), F.col("doc_id").alias("x"))
    parts = parts.repartition("key").sortWithinPartitions("key", "x").mapInArrow(_met, "key bigint, x bigint, p bigint")
    regions = table(voronoi.unionByName(parts), "jaccard-regions", keep=True)
    info = known.groupBy(F.col("doc_id").alias("node")).agg(F.min("n").alias("n"), F.min("print").alias("a"), F.max("print").alias("b"), F.min("sketch").alias("sketch"), F.min("wide").alias("wide"))
    one_text = F.col("a") == F.col("b")  # else the sketches exclude nothing
    info = table(info.select("node", *[F.when(one_text, F.col(c)).alias(c) for c in ("n", "sketch", "wide")]), "jaccard-sketches", keep=True)
    return sizes, alias, regions, info


def _join(docs: DataFrame, n: int, percent: int, pivots: int, small: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    with temporary(spark):  # the keys of regions are most of the features, and are gone before texts are compared
        feats = table(features(docs, n, percent, pivots), "jaccard-features")
        sizes, alias, regions, info = _prepared(feats)

    def as_node(df: DataFrame, name: str) -> DataFrame:
        own = alias.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"))
        own = own.groupBy("_d").agg(F.min("_n").alias("_n"))
        return df.join(own, F.col(name) == F.col("_d"), "left").withColumn(name, F.coalesce("_n", name)).drop("_d", "_n")

    def tops(regions: DataFrame) -> DataFrame:
        """Pairs x, p with the least document of each region."""
        own = as_node(as_node(regions.filter("x <> p").select("x", "p").distinct(), "x"), "p").filter("x <> p")
        return own.select(F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p")).distinct()

    first = tops(regions)

    def possible(df: DataFrame) -> DataFrame:
        """Pairs x, p that sizes and sketches don't exclude."""
        a = info.select(F.col("node").alias("x"), F.col("n").alias("_nx"), F.col("wide").alias("_sx"))
        b = info.select(F.col("node").alias("p"), F.col("n").alias("_np"), F.col("wide").alias("_sp"))
        bits = F.zip_with("_sx", "_sp", lambda u, v: F.bit_count(u.bitwiseXOR(v)))
        apart = F.aggregate(bits, F.lit(0).cast("int"), lambda t, k: t + k.cast("int"))
        near = apart * (100 + percent) <= (100 - percent) * (F.col("_nx") + F.col("_np"))
        sizes = F.least("_nx", "_np") * 100 >= F.greatest("_nx", "_np") * percent
        return df.join(a, "x").join(b, "p").filter(F.coalesce(sizes & near, F.lit(True))).select("x", "p")

    first = table(possible(first), "jaccard-candidates")
    done = _verified(spark, first, _texts(docs, _ends(first)), n, percent)
    copies = alias.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    links = copies.unionByName(done.filter("linked").select(F.col("x").alias("u"), F.col("p").alias("v")))
    found = components(links)

    def labelled(df: DataFrame) -> DataFrame:
        return df.join(found.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))

    def split(df: DataFrame) -> DataFrame:
        """Regions that more than one component shares."""
        many = df.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
        return df.join(many, "key", "left_semi")

    own = info.select(F.col("node").alias("x"), "n", "sketch")
    mixed = not info.filter("n is null").isEmpty()  # one doc_id has several texts
    open_ = table(split(labelled(as_node(regions.select("key", "x", F.lit(None).cast("bigint").alias("before")), "x").distinct())), "jaccard-open")
    level = 0
    while not open_.isEmpty():
        level += 1
        now = open_.join(open_.groupBy("key").agg(F.count("*").alias("c")), "key")
        fits = F.col("c") <= small
        rows = now.filter(fits).select("key", "x", "component")
        large = table(now.filter(~fits).select("key", "x", "component", "c", (F.col("c") > 0.9 * F.col("before")).alias("stuck")), "jaccard-large")
        deeper = None
        if not large.isEmpty():
            texts = table(_texts(docs, large.select(F.col("x").alias("node")).distinct()).withColumnRenamed("node", "doc_id"), "jaccard-texts")
            sets = spark.sparkContext.broadcast(Pivots(pivot_sets(texts, n, pivots, level), percent))
            parts = large.filter("not coalesce(stuck, false)").join(texts.withColumnRenamed("doc_id", "x").hint("merge"), "x").select("key", "x", "c", "text")
            parts = table(parts.mapInArrow(_divide(n, sets), "key bigint, x bigint, c bigint, keys array<bigint>"), "jaccard-divided")
            better = parts.groupBy("key").agg(F.sum(F.size("keys")).alias("e"), F.max("c").alias("c")).filter(F.col("e") <= REPLICAS * F.col("c")).select("key")
            parts = parts.join(better, "key", "left_semi").select(F.explode("keys").alias("key"), "x", F.col("c").alias("before"))
            deeper = table(_several(parts), "jaccard-regions")
            above = parts.groupBy("key").agg(F.max("before").alias("before"))
            block = F.pmod(F.xxhash64("x"), F.ceil(F.col("c") / small)).cast("int")
            dealt = large.join(better, "key", "left_anti").select("key", "x", "component", block.alias("b"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("c") / small) - 1).cast("int"))).alias("j"))
            rows = rows.unionByName(dealt.select(F.xxhash64("key", F.least("b", "j"), F.greatest("b", "j")).alias("key"), "x", "component"))
        rows = rows.join(own, "x").select("key", "x", "n", "component", "sketch")
        pairs = rows.filter("n is not null").repartition("key").sortWithinPartitions("key").mapInArrow(_small_regions(percent), "x bigint, p bigint")
        if mixed:
            odd = rows.filter("n is null").select("key", F.col("x").alias("q"), F.col("component").alias("qc"))  # no sketch: met by all of its region
            odd = rows.join(odd, "key").filter(F.col("component") != F.col("qc")).select(F.greatest("x", "q").alias("x"), F.least("x", "q").alias("p"))
            pairs = pairs.unionByName(odd)
        if deeper is not None:
            pairs = pairs.unionByName(tops(deeper))
        pairs = possible(pairs.distinct())
        pairs = table(pairs.join(done.select("x", "p"), ["x", "p"], "left_anti"), "jaccard-candidates")
        got = _verified(spark, pairs, _texts(docs, _ends(pairs)), n, percent)
        done = table(done.select("x", "p", "linked").unionByName(got.select("x", "p", "linked")), "jaccard-pairs") if deeper is not None else done.select("x", "p", "linked").unionByName(got.select("x", "p", "linked"))
        if not got.filter("linked").isEmpty():
            links = copies.unionByName(done.filter("linked").select(F.col("x").alias("u"), F.col("p").alias("v")))
            found = components(links)
        if deeper is None:
            break
        open_ = table(split(labelled(deeper.select("key", "x").distinct().join(above, "key"))), "jaccard-open")
    of_doc = found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "p")).alias("node")).distinct()


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one text for each node (node, distinct). Other documents' texts aren't shuffled while the nodes are few."""
    nodes = nodes.withColumnRenamed("node", "doc_id")
    return docs.join(nodes.hint("broadcast" if nodes.count() <= FEW_IDS else "merge"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("node")).agg(F.max("text").alias("text"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with the least doc_id of each component; repeated rows of it once; rows without an id stay."""
    own = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_text"))
    leave = join(docs.select("doc_id", "text"), n, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = own.join(leave, F.col("_id") == F.col("_gone"), "left_anti")
    first = kept.filter("_id is not null").dropDuplicates(["_id"]).select("_row")
    return first.unionByName(kept.filter("_id is null").select("_row")).select("_row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
#: All pairs that share an n-gram, and what is reached over links.
SQL = {
    "op7_jaccard_join": r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') g from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) i from t where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on x = a.doc_id join n b on y = b.doc_id where 100 * c >= 90 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id node, doc_id comp from n union select e.y, r.comp from r join e on r.node = e.x and r.comp < e.y)
select t.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce((select min(comp) from r where node = t.doc_id), t.doc_id) component_id from t left join n using (doc_id)
"""
}
