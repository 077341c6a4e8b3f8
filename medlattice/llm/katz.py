"""LM scoring with a Katz backoff model, of word pairs unless another order is asked for.

Method: counts of words and of pairs (history, word) come from all training
documents and are discounted by Good-Turing (Katz's form, counts up to K);
backoff weights are computed for each history from its seen pairs so that
P(. | history) sums to exactly 1 over the vocabulary and one class of unknown
words. A token is scored recursively: the discounted pair if it was seen, else
weight(history) * P(word), where P is the discounted unigram or the unknown
mass. Counts and weights are stored as tables partitioned by kind.

Where the counts of counts can't give a discount in (0, 1) K is lowered; with
K = 0 absolute discounting is used. A history whose seen pairs leave no mass
gives one count's worth, c / (c(h) + 1), to what it hasn't been followed by.

Texts are handled in slices of bounded bytes. A slice asks once for each of its
distinct words and pairs: it sends one packed, sorted array of 64-bit hashes
and training counts to each range of hashes (a bucket), and gets the summed
counts back in the same order. Hashes spread evenly and a slice names each word
or pair once, so no bucket is hot; buckets grow in number with the tokens, so
none grows. Of the slices that hold a pair in training one is told that it owns
the pair; owners sum what a history's pairs leave over, which makes the weights
a second, smaller exchange. Two pairs with equal 64-bit hashes would share
their count, which is expected for one pair in 2**64 / (distinct pairs).

Orders other than 2 take `Tables`: counts, discounted probabilities and backoff
weights of each order are tables partitioned by order, and any documents are
scored from them by joins, from the highest order down. It gives the same for
order 2 (tested) and takes rows where the packed exchange takes bytes.

Defined cases: a null or empty text is the end token alone; repeated documents
count each time; an empty table gives no rows; without training documents all
words are unknown and score as with one pseudo-count; a null doc_id is in
training (its remainder is undefined) and scored; a doc_id that is no integer
fails the cast; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.llm.common import WORD, read, slices, table

K = 5
SLICE_CHARS = 12_000_000
BUCKET_KEYS = 2_000_000
LEAST_BUCKETS = 64
HELD_OUT = (7, 2)
LOWER = {c: c + 32 for c in range(65, 91)}
END, START = 1, 2  # hashes of the two marks, which are words 0 and 1 of each slice
WORDS, PAIRS = 0, 1
_SLICES = "slice string, doc_id array<bigint>, held array<boolean>, lengths array<int>, n_tokens bigint, tokens binary, words binary"
_ASKED = "kind int, bucket int, slice string, n int, keys binary, counts binary"
_COUNTED = "kind int, bucket int, slice string, n int, keys binary, counts binary, total bigint, seen_times array<bigint>"
_STATE = (
    "slice string, doc_id array<bigint>, held array<boolean>, lengths array<int>, known array<bigint>, base array<double>, part array<double>, open_n array<int>, open_at binary, open_back binary, "
    "asked array<struct<bucket:int,n:int,keys:binary,sums:binary>>"
)
_WEIGHED = "bucket int, slice string, n int, keys binary, weights binary"
_OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


def pack(values) -> bytes:
    """Unsigned integers as compressed planes of bytes, least significant first."""
    import numpy as np
    import pyarrow as pa

    v = np.ascontiguousarray(values, dtype="<u8")
    width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if width else b"")


def unpack(data: bytes, n: int):
    import numpy as np
    import pyarrow as pa

    out = np.zeros((n, 8), dtype=np.uint8)
    if width := data[0]:
        out[:, :width] = np.frombuffer(pa.decompress(memoryview(data)[1:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def bucket_starts(buckets: int):
    """The first hash of each bucket."""
    import numpy as np

    return np.array([b * 2**64 // buckets for b in range(buckets)], dtype=np.uint64)


def _dealt(hashes, buckets: int):
    """The order that sorts hashes, the sorted hashes and (bucket, from, to, packed gaps) of each bucket that has any."""
    import numpy as np

    order = np.argsort(hashes)
    got, starts = hashes[order], bucket_starts(buckets)
    cuts = [*np.searchsorted(got, starts).tolist(), len(got)]
    parts = [(b, i, j, pack(np.diff(got[i:j], prepend=starts[b]))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
    return order, got, parts


def _keys(data: bytes, n: int, start):
    import numpy as np

    return np.cumsum(unpack(data, n), dtype=np.uint64) + start


def _record(rows: list[dict], ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    kinds["array<struct<bucket:int,n:int,keys:binary,sums:binary>>"] = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())]))
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, kinds[k]) for c, k in (x.split() for x in ddl.split(", "))]))


def _slice(batches):
    import re
    import uuid

    import numpy as np
    import xxhash

    find = re.compile(WORD).findall

    def hashed(word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h if h not in (END, START) else h + 2

    for batch in slices(batches, SLICE_CHARS):
        ids = batch.column("doc_id").to_pylist()
        number: dict[str, int] = {}
        lower: dict[str, int] = {}

        def local(word: str) -> int:
            got = lower.get(word)
            if got is None:
                got = lower[word] = number.setdefault(word.translate(LOWER), len(number) + 2)
            return got

        parts = []
        for t in batch.column("text"):
            w = find(t.as_py() or "")
            a = np.zeros(len(w) + 1, dtype=np.uint32)  # 0: end
            a[:-1] = np.fromiter(map(local, w), dtype=np.uint32, count=len(w))
            parts.append(a)
        row = {"slice": uuid.uuid4().hex, "doc_id": ids, "held": [is_held_out(i) for i in ids], "lengths": [len(a) for a in parts], "n_tokens": sum(map(len, parts))}
        yield _record([row | {"tokens": pack(np.concatenate(parts)), "words": np.array([END, START, *map(hashed, number)], dtype="<u8").tobytes()}], _SLICES)


class _Slice:
    """tokens and their documents' lengths; words' hashes; for each distinct pair its two words and hash; pair: of each token."""

    def __init__(self, row: dict):
        import numpy as np

        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.tokens = unpack(row["tokens"], row["n_tokens"]).astype(np.int64)
        self.words = np.frombuffer(row["words"], dtype="<u8")
        self.size = len(self.words)
        before = np.concatenate(([1], self.tokens[:-1]))
        before[np.cumsum(self.lengths)[:-1]] = 1  # a text's first token follows the start
        codes, self.pair = np.unique(before * self.size + self.tokens, return_inverse=True)
        self.first, self.second = codes // self.size, codes % self.size
        self.train = ~np.repeat(np.array(row["held"], dtype=bool), self.lengths)

    def pair_hashes(self):
        import numpy as np

        def mixed(x):  # the finalizer of splitmix64
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        return mixed(mixed(self.words + np.uint64(0x9E3779B97F4A7C15))[self.first] + self.words[self.second])


def _ask(buckets: int):
    """What each slice asks of each bucket: its words and pairs, with their counts in training."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                s = _Slice(row)
                for kind, hashes, own in ((WORDS, s.words, s.tokens), (PAIRS, s.pair_hashes(), s.pair)):
                    order, _, parts = _dealt(hashes, buckets)
                    counts = np.bincount(own[s.train], minlength=len(hashes))[order]
                    yield _record([{"kind": kind, "bucket": b, "slice": row["slice"], "n": j - i, "keys": keys, "counts": pack(counts[i:j])} for b, i, j, keys in parts], _ASKED)

    return run


def _count(buckets: int):
    """A bucket's sums: one row of the model, and to each slice that asked twice the count of each of its keys, plus 1 if it owns the key."""

    def run(asked):
        import numpy as np
        import pyarrow as pa

        rows = asked.to_pylist()
        kind, b = rows[0]["kind"], rows[0]["bucket"]
        start = bucket_starts(buckets)[b]
        keys, at = np.unique(np.concatenate([_keys(r["keys"], r["n"], start) for r in rows]), return_inverse=True)
        counts = np.concatenate([unpack(r["counts"], r["n"]) for r in rows]).astype(np.int64)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, counts)
        trained = np.flatnonzero(counts)
        answer = 2 * sums[at]
        answer[trained[np.unique(at[trained], return_index=True)[1]]] += 1
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        out = [{"kind": kind, "bucket": b, "slice": r["slice"], "n": r["n"], "counts": pack(answer[i:j])} for r, i, j in zip(rows, [0, *ends], ends)]
        keys, sums = keys[sums > 0], sums[sums > 0]
        times = np.bincount(np.minimum(sums, K + 3), minlength=K + 4)[: K + 3]
        gaps = np.diff(keys, prepend=start) if len(keys) else keys
        out.append({"kind": kind, "bucket": b, "n": len(keys), "keys": pack(gaps), "counts": pack(sums), "total": int(sums.sum()), "seen_times": times.tolist()})
        return pa.Table.from_batches([_record(out, _COUNTED)])

    return run


def discounts(n: list[int], k: int = K) -> list[float]:
    """d[r] for counts r = 0..k (d[0] unused), from n[r], the number of events seen r times; counts above len(d) - 1 keep all."""
    for top in range(min(k, len(n) - 2), 0, -1):
        if not all(n[r] for r in range(1, top + 1)):
            continue
        rest = (top + 1) * n[top + 1] / n[1]
        if rest >= 1:
            continue
        d = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) for r in range(1, top + 1)]
        if all(0 < x < 1 for x in d):
            return [1.0, *d]
    part = n[1] / (n[1] + 2 * n[2]) if len(n) > 2 and n[1] and n[2] else 0.5
    return [1.0, *[(r - part) / r for r in range(1, k + 1)]]


def product(tokens: int, types: int) -> float:
    return (tokens + 1.0) * (types + 1)


def add_one(tokens: int, types: int) -> float:
    """N + 1 * (V + 1): one is added to each known word and to one class of unknown ones."""
    return tokens + 1.0 * (types + 1)


def _answer(buckets: int, d1: list[float], d2: list[float], tokens: int, below: float, unknown: float, scale: float):
    """Each slice's scores but for the weights, the tokens that wait for these, and its share of each history's sums."""

    def taken(c, d):
        out = c.astype(float)
        for r in range(1, len(d)):
            out[c == r] = d[r] * r
        return out

    def run(batches):
        import numpy as np

        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                s = _Slice(row)
                got = []
                for kind, hashes in ((WORDS, s.words), (PAIRS, s.pair_hashes())):
                    order = np.argsort(hashes)
                    got.append(np.zeros(len(hashes), np.int64))
                    got[-1][order] = np.concatenate([unpack(x["counts"], x["n"]) for x in sorted((x for x in row["answers"] if x["kind"] == kind), key=lambda x: x["bucket"])])
                c, c2, owned = got[0] >> 1, got[1] >> 1, (got[1] & 1).astype(bool)
                total = c.copy()
                total[1] = c[0]  # each training text starts and ends once
                p1 = np.where(c > 0, taken(c, d1) * scale / max(1, tokens), unknown)
                left = c2 - taken(c2, d2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    part = np.where(c2 > 0, np.log10((c2 - left) / total[s.first]), np.log10(p1)[s.second])
                base = np.log10((c + 1) / below)
                certain = np.bincount(s.first, weights=(c2 > 0) & (left > 1e-9), minlength=s.size) > 0  # its pairs leave some mass
                waits = ((c2 == 0) | ~certain[s.first])[s.pair]
                starts = np.concatenate(([0], np.cumsum(s.lengths)[:-1]))
                asks = np.zeros(s.size, bool)
                asks[s.first[owned]] = True
                asks[s.first[s.pair[waits]]] = True
                asked = np.flatnonzero(asks)
                order, _, parts = _dealt(s.words[asked], buckets)
                asked = asked[order]
                place = np.zeros(s.size, np.int64)
                place[asked] = np.arange(len(asked))
                sums = np.stack([np.bincount(s.first[owned], weights=x[owned], minlength=s.size)[asked] for x in (left, p1[s.second])] + [total[asked].astype(float)], axis=1)
                yield _record(
                    [
                        {
                            "slice": row["slice"],
                            "doc_id": row["doc_id"],
                            "held": row["held"],
                            "lengths": row["lengths"],
                            "known": np.add.reduceat((c > 0).astype(np.int64)[s.tokens], starts).tolist(),
                            "base": np.add.reduceat(base[s.tokens], starts).tolist(),
                            "part": np.add.reduceat(part[s.pair], starts).tolist(),
                            "open_n": np.add.reduceat(waits.astype(np.int64), starts).tolist(),
                            "open_at": pack(place[s.first[s.pair[waits]]]),
                            "open_back": pack((c2 == 0)[s.pair[waits]]),
                            "asked": [{"bucket": b, "n": j - i, "keys": keys, "sums": sums[i:j].tobytes()} for b, i, j, keys in parts],
                        }
                    ],
                    _STATE,
                )

    return run


def _weigh(buckets: int):
    """A bucket's histories: log10 of the backoff weight, and what a seen pair loses where no mass is left; one row of the model, and an answer to each slice."""

    def run(asked):
        import numpy as np
        import pyarrow as pa

        rows = asked.to_pylist()
        b = rows[0]["bucket"]
        start = bucket_starts(buckets)[b]
        keys, at = np.unique(np.concatenate([_keys(r["keys"], r["n"], start) for r in rows]), return_inverse=True)
        parts = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, 3) for r in rows])
        left, lower = (np.bincount(at, weights=parts[:, k], minlength=len(keys)) for k in (0, 1))
        total = np.zeros(len(keys))
        total[at] = parts[:, 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(left > 1e-9, left / total, 1 / (total + 1))
            weight = np.where(total > 0, np.log10(share / np.maximum(1 - lower, 1e-300)), 0.0)
            lost = np.where((total > 0) & (left <= 1e-9), np.log10(total / (total + 1)), 0.0)
        both = np.stack([weight, lost], axis=1)
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        out = [{"bucket": b, "slice": r["slice"], "n": r["n"], "weights": both[at[i:j]].tobytes()} for r, i, j in zip(rows, [0, *ends], ends)]
        out.append({"bucket": b, "n": len(keys), "keys": pack(np.diff(keys, prepend=start)), "weights": both.tobytes()})
        return pa.Table.from_batches([_record(out, _WEIGHED)])

    return run


def _finish(tokens: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                n = np.array(row["open_n"], np.int64)
                answers = [np.frombuffer(x["weights"]).reshape(-1, 2) for x in sorted(row["answers"] or (), key=lambda x: x["bucket"])]
                weights = np.concatenate(answers or [np.zeros((0, 2))])
                at, back = unpack(row["open_at"], int(n.sum())).astype(np.int64), unpack(row["open_back"], int(n.sum())).astype(bool)
                more = np.bincount(np.repeat(np.arange(len(n)), n), weights=np.where(back, weights[at, 0], weights[at, 1]), minlength=len(n))
                columns = [
                    pa.array(row["doc_id"], pa.int64()),
                    pa.array(row["held"], pa.bool_()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(row["known"], pa.int64()),
                    pa.array(np.full(len(n), tokens, np.int64)),
                    pa.array(row["base"], pa.float64()),
                    pa.array(np.array(row["part"]) + more),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])

    return run


class Model:
    """counts: packed rows of words and pairs (kind, bucket, n, keys, counts, total, seen_times; slice: to whom, null for the
    model itself); d1, d2: discounts; tokens, types: of the training documents; unknown: the mass of unknown words."""

    def __init__(self, slices_: DataFrame):
        n = slices_.agg(F.sum("n_tokens")).first()[0] or 0
        self.buckets = max(LEAST_BUCKETS, -(-n // BUCKET_KEYS))
        counted = slices_.mapInArrow(_ask(self.buckets), _ASKED).groupBy("kind", "bucket").applyInArrow(_count(self.buckets), _COUNTED)
        self.counts = table(counted.withColumn("model", F.col("slice").isNull()), "lm-counts", "model", "kind")
        stats = {WORDS: (0, 0, [0] * (K + 3)), PAIRS: (0, 0, [0] * (K + 3))}
        times = [F.sum(F.col("seen_times")[r]).alias(f"n{r}") for r in range(K + 3)]
        for r in self.counts.filter("model").groupBy("kind").agg(F.sum("total").alias("total"), F.sum("n").alias("types"), *times).collect():  # two rows
            stats[r.kind] = (r.total or 0, r.types or 0, [r[f"n{k}"] or 0 for k in range(K + 3)])
        self.tokens, self.types, seen_times = stats[WORDS]
        self.d1, self.d2 = discounts(seen_times), discounts(stats[PAIRS][2])
        seen = self.tokens - sum(r * seen_times[r] * (1 - self.d1[r]) for r in range(1, len(self.d1)))
        self.scale = 1.0
        self.unknown = 1 - seen / self.tokens if self.tokens else 1.0
        if self.unknown <= 1e-12:  # no word was seen but a few times: one pseudo-count
            self.unknown = 1 / (self.tokens + 1)
            self.scale = (1 - self.unknown) * self.tokens / seen if seen else 1.0


def _positions(order: int):
    """A row for each token: hashes g1 .. g<order> of the n-grams that end there, and h2 .. of the histories before it."""

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa
        import xxhash

        find = re.compile(WORD).findall
        known: dict[str, int] = {}

        def number(word: str) -> int:
            got = known.get(word)
            if got is None:
                if len(known) > 500_000:
                    known.clear()
                got = xxhash.xxh64_intdigest(word.translate(LOWER).encode("utf-8", "surrogatepass"))
                known[word] = got = got if got not in (END, START) else got + 2
            return got

        def mixed(x):  # the finalizer of splitmix64
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        names = ["rid", "doc_id", "held", *[f"g{k}" for k in range(1, order + 1)], *[f"h{k}" for k in range(2, order + 1)]]
        for batch in slices(batches, 1_000_000):
            for n in range(batch.num_rows):
                doc, text = batch.column("doc_id")[n].as_py(), batch.column("text")[n].as_py()
                w = np.array([*[START] * (order - 1), *map(number, find(text or "")), END], dtype=np.uint64)
                size = len(w) - order + 1
                grams, histories = [], []
                with np.errstate(over="ignore"):
                    for k in range(1, order + 1):
                        more = int(k < order)  # one place in front: the history of the first
                        h = np.full(size + more, k, dtype=np.uint64)
                        for j in range(order - k - more, order - more):
                            h = mixed(h + w[j : j + size + more] + np.uint64(0x9E3779B97F4A7C15))
                        grams.append(h[more:].view(np.int64))
                        histories.append(h[: len(h) - more].view(np.int64))
                rid = np.full(size, batch.column("rid")[n].as_py(), dtype=np.int64)
                columns = [pa.array(rid), pa.array([doc] * size, pa.int64()), pa.array([is_held_out(doc)] * size, pa.bool_()), *map(pa.array, grams), *map(pa.array, histories[: order - 1])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _token_rows(docs: DataFrame, order: int) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    longs = [f"g{k} bigint" for k in range(1, order + 1)] + [f"h{k} bigint" for k in range(2, order + 1)]
    return table(rows.mapInArrow(_positions(order), "rid bigint, doc_id bigint, held boolean, " + ", ".join(longs)), "lm-positions")


class Tables:
    """A Katz model of any order in stored tables: `grams` (order, g, c, p) and `weights` (order, h, w); tokens, types and
    unknown as in Model."""

    def __init__(self, docs: DataFrame, order: int):
        if order < 1:
            raise ValueError("the order is at least 1")
        self.order = order
        train = _token_rows(docs, order).filter("not held")
        counts = table(train.groupBy(F.col("g1").alias("g")).agg(F.count("*").alias("c")), "lm-words")
        d = self._discounts(counts)
        one = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.col("c") * self._part(d)).alias("kept")).first()
        self.tokens, self.types, kept = one.n or 0, one.v or 0, one.kept or 0.0
        scale = 1.0
        self.unknown = 1 - kept / self.tokens if self.tokens else 1.0
        if self.unknown <= 1e-12:
            self.unknown = 1 / (self.tokens + 1)
            scale = (1 - self.unknown) * self.tokens / kept if kept else 1.0
        now = counts.select(F.lit(1).alias("order"), "g", "c", (F.col("c") * self._part(d) * scale / max(1, self.tokens)).alias("p"))
        grams, weights = [table(now, "lm-grams", "order")], []
        for k in range(2, order + 1):
            counts = table(train.groupBy(F.col(f"g{k}").alias("g")).agg(F.count("*").alias("c"), F.min(f"h{k}").alias("h"), F.min(f"g{k - 1}").alias("low")), "lm-counts")
            part = self._part(self._discounts(counts))
            seen = counts.join(grams[-1].select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
            of = seen.groupBy("h").agg(F.sum("c").alias("total"), F.sum(F.col("c") * (1 - part)).alias("left"), F.sum("q").alias("lower"))
            of = table(of.withColumn("some", F.col("left") > 1e-9), "lm-histories")
            share = F.when(F.col("some"), F.col("left") / F.col("total")).otherwise(1 / (F.col("total") + 1))
            weight = F.log10(share / F.greatest(1 - F.col("lower"), F.lit(1e-300)))
            weights.append(table(of.select(F.lit(k).alias("order"), "h", weight.alias("w")), "lm-weights", "order"))
            p = F.when(F.col("some"), F.col("c") * part / F.col("total")).otherwise(F.col("c") / (F.col("total") + 1))
            grams.append(table(counts.join(of.select("h", "total", "some"), "h").select(F.lit(k).alias("order"), "g", "c", p.alias("p")), "lm-grams", "order"))
        self.grams, self.weights = grams, weights

    @staticmethod
    def _discounts(counts: DataFrame) -> list[float]:
        times = {r.c: r.n for r in counts.filter(F.col("c") <= K + 2).groupBy("c").agg(F.count("*").alias("n")).collect()}  # K + 2 rows
        return discounts([times.get(r, 0) for r in range(K + 3)])

    @staticmethod
    def _part(d: list[float]):
        """What a count keeps."""
        return F.coalesce(F.get(F.array(*map(F.lit, d)), F.col("c").cast("int")), F.lit(1.0)) if len(d) > 1 else F.lit(1.0)

    def score(self, docs: DataFrame, below=product) -> DataFrame:
        """Scores of any documents, from the stored tables."""
        rows = _token_rows(docs, self.order)
        for k in range(self.order, 0, -1):
            own = self.grams[k - 1].select(F.col("g").alias(f"g{k}"), F.col("p").alias(f"p{k}"), *([F.col("c").alias("c1")] if k == 1 else []))
            rows = rows.join(own, f"g{k}", "left")
            if k > 1:
                rows = rows.join(self.weights[k - 2].select(F.col("h").alias(f"h{k}"), F.col("w").alias(f"w{k}")), f"h{k}", "left")
        part = F.log10(F.coalesce("p1", F.lit(self.unknown)))
        for k in range(2, self.order + 1):  # the recursion: a seen n-gram, else its history's weight and the order below
            part = F.when(F.col(f"p{k}").isNotNull(), F.log10(f"p{k}")).otherwise(F.coalesce(f"w{k}", F.lit(0.0)) + part)
        base = F.log10((F.coalesce("c1", F.lit(0)) + 1) / below(self.tokens, self.types))
        got = rows.groupBy("rid").agg(F.min("doc_id").alias("doc_id"), F.min("held").alias("held_out"), F.count("*").alias("n_tokens"), F.count("c1").alias("n_known"), F.sum(base).alias("base_score"), F.sum(part).alias("score"))
        return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, order: int = 2, below=product) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all docs, by a model of those in training.

    base_score sums log10((c + 1) / below(N, V)) of the tokens; c: a token's count, N: of all, V: distinct ones in training."""
    if order != 2:
        return Tables(docs, order).score(docs, below)
    rows = table(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_slice, _SLICES), "lm-slices")
    m = Model(rows)
    answers = m.counts.filter("not model").groupBy("slice").agg(F.collect_list(F.struct("kind", "bucket", "n", "counts")).alias("answers"))  # of one slice
    run = _answer(m.buckets, m.d1, m.d2, m.tokens, below(m.tokens, m.types), m.unknown, m.scale)
    state = table(rows.join(answers, "slice").mapInArrow(run, _STATE), "lm-state")
    weighed = state.select("slice", F.inline("asked")).groupBy("bucket").applyInArrow(_weigh(m.buckets), _WEIGHED)
    weights = table(weighed.withColumn("model", F.col("slice").isNull()), "lm-weights", "model")
    answers = weights.filter("not model").groupBy("slice").agg(F.collect_list(F.struct("bucket", "weights")).alias("answers"))  # of one slice
    return state.drop("asked").join(answers, "slice", "left").mapInArrow(_finish(m.tokens), _OUT)


def perplexity(scored: DataFrame) -> DataFrame:
    """tokens and perplexity of the held-out documents."""
    n = F.sum("n_tokens")
    return scored.filter("held_out").agg(n.alias("tokens"), F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents").select("doc_id", "text"), below=add_one)


QUERIES = {"op3_lm_score": op3_lm_score}
SQL: dict[str, str] = {}
