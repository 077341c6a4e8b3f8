"""Token ids to binary files: rANS blocks over a shared frequency table.

Method: texts become ids of a public byte-level BPE tokenizer, each document
ends with id 0; ids go, in ascending doc_id order (null first), into blocks of
whole documents that `rans.encode` writes with one frequency table for all,
with checkpoints and checksums, so that any block and any segment of it can be
decoded alone. Blocks are binary values in Parquet files, committed by Spark's
writers: a task that is lost is written again.

Tokenizing: the tokenizer's pre-tokens never cross a place before a space or
between white space and other characters, so texts are cut there and each
distinct piece is encoded once by the library (cached, bounded). A piece of
letters is one pre-token, so it goes to the library's model directly. A text
that holds the string of an added token (such as "<|endoftext|>") goes to the
library as a whole, which encodes it as that token, as its `encode` does unless
told otherwise; `ordinary` makes such strings ordinary text instead.

Ids take 16 bits between the steps, or 32 where the vocabulary needs them.

Defined cases: a doc_id that is no integer fails the cast;
a null or empty text is the end id alone; repeated documents
and ids are encoded each time they occur, next to each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.llm.common import delete_path, read, scratch_path, slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
BLOCK_TOKENS = 1 << 19
PART_TOKENS = 1 << 26
CACHED_PIECES = 400_000
#: Unicode White_Space, fixed by the standard.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = r"!-&(-/:-@\[-`{-~"  # ASCII without the apostrophe, which starts pre-tokens like 's
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of letters before punctuation, white space or the end; punctuation before white space or the end; any other run without white space; white space.
PIECE = f" ?[{LETTERS}]+(?=[{PUNCTUATION}{WHITE}]|\\Z)|[{PUNCTUATION}]+(?=[{WHITE}]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]"


def byte_letters() -> dict[int, int]:
    """The letter for each byte in a byte-level vocabulary: printable bytes of Latin-1 stand for themselves, the others for what follows U+00FF in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: b if b in shown else 256 + others.index(b) for b in range(256)}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def id_kind(tokenizer) -> str:
    """The array type that holds all ids."""
    return "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class Encoder(dict):
    """Ids of whole texts, equal to the library's; the dictionary holds the ids of pieces as bytes."""

    def __init__(self, path: str, ordinary: bool = False, cached: int = CACHED_PIECES):
        import json
        import re

        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__()
        self.t = Tokenizer.from_file(path)
        before, model = self.t.pre_tokenizer, self.t.model
        if self.t.normalizer or not isinstance(model, models.BPE) or not isinstance(before, pre_tokenizers.ByteLevel) or before.add_prefix_space or not before.use_regex:
            raise ValueError("not a byte-level BPE vocabulary without a prefix space")
        self.kind = id_kind(self.t)
        self.t.encode_special_tokens = ordinary
        added = [x["content"] for x in json.loads(self.t.to_str())["added_tokens"] if not (ordinary and x["special"])]
        self.marks = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.tokenize, self.letters, self.word = model.tokenize, byte_letters(), re.compile(f" ?[{LETTERS}]+").fullmatch
        self.cut, self.cached, self.new = re.compile(PIECE).findall, cached, []

    def __missing__(self, piece: str) -> bytes:
        from array import array

        if self.word(piece):
            ids = [x.id for x in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.t.encode(piece, add_special_tokens=False).ids
        self.new.append(piece)
        got = self[piece] = array(self.kind, ids).tobytes()
        return got

    def whole(self, text: str) -> bytes:
        from array import array

        return array(self.kind, self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of `kind`, without an end."""
        of, marks = self.__getitem__, self.marks
        out = [(self.whole(t) if marks(t) else b"".join(map(of, self.cut(t)))) if t else b"" for t in texts]
        if len(self) > self.cached:  # full: what came first, so most common pieces, stays
            for p in self.new:
                del self[p]
        self.new.clear()
        return out


#: One encoder for each vocabulary in a Python worker: what a task has cached serves the next one.
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _tokenize(path: str, end: int, ordinary: bool):
    def run(batches):
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa

        from medlattice.llm import tokens  # the worker's module: this function's own globals are a copy

        if (path, ordinary) not in tokens._ENCODERS:
            tokens._ENCODERS[path, ordinary] = Encoder(path, ordinary)
        encoder = tokens._ENCODERS[path, ordinary]
        kind = np.dtype(encoder.kind)
        tail, size = end.to_bytes(kind.itemsize, "little"), max(end + 1, encoder.t.get_vocab_size())
        gc.disable()  # millions of strings in lists and no cycles
        try:
            for batch in slices(batches, 8_000_000):
                ids = [b + tail for b in encoder.encode(batch.column("text").to_pylist())]
                packed = [pa.compress(b, codec="zstd", asbytes=True) for b in ids]
                counts = np.bincount(np.frombuffer(b"".join(ids), dtype=kind), minlength=size).astype("<u4").tobytes()
                counts = [*[None] * (len(ids) - 1), pa.compress(counts, codec="zstd", asbytes=True)]  # of the slice, in its last row
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) // kind.itemsize for b in ids], pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "ids", "counts"])
        finally:
            gc.enable()

    return run


def _unpack(n: int, blob: bytes, kind):
    import numpy as np
    import pyarrow as pa

    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


def _count(size: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for b in batch.column("counts").to_pylist():
                counts += np.frombuffer(pa.decompress(b, 4 * size, codec="zstd", asbytes=True), dtype="<u4")
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    return run


def _pack(tables, block_tokens: int, kind: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from medlattice.llm import rans

        t, part, block = rans.Tables(tables.value), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def out():
            data = rans.encode(np.concatenate(held), ids, np.array([len(x) for x in held]), t)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "block", "n_tokens", "data"])

        for batch in batches:
            for i, n, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                if held and size + n > block_tokens:
                    yield out()
                    ids, held, size, block = [], [], 0, block + 1
                ids.append(i)
                held.append(_unpack(n, b, kind))
                size += n
        if held:
            yield out()

    return run


def _decode(tables, with_ids: bool):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        from medlattice.llm import rans

        t = rans.Tables(tables.value)
        for batch in batches:
            for row in range(batch.num_rows):
                block = rans.Block(batch.column("data")[row].as_py())
                tokens, ends = block.tokens(t), np.cumsum(block.lengths)
                if batch.column("n_tokens")[row].as_py() != len(tokens):
                    raise ValueError("a block has other tokens than its row says")
                starts = ends - block.lengths + batch.column("first")[row].as_py()
                docs, raw = np.split(tokens, ends[:-1]), pa.nulls(len(ends), pa.binary())
                if with_ids:
                    raw = pa.array([d.tobytes() for d in docs], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array(starts), pa.array(block.lengths), pa.array([zlib.crc32(d) for d in docs], pa.int64()), raw],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, ordinary: bool = False) -> None:
    """Write path/blocks (part, block, n_tokens, data) and path/table (id, frequency)."""
    from medlattice.llm import rans

    spark = docs.sparkSession
    import numpy as np

    vocabulary = vocabulary or vocabulary_path()
    size = max(end_id + 1, vocabulary_size(vocabulary))
    kind = "H" if size <= 1 << 16 else "I"
    schema = "doc_id bigint, n bigint, ids binary, counts binary"
    held = scratch_path(spark, "token-ids")
    docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_tokenize(vocabulary, end_id, ordinary), schema).write.option("compression", "none").parquet(held)
    ids = spark.read.schema(schema).parquet(held)
    counts = np.zeros(size, dtype=np.int64)  # a row for each id of the vocabulary at most
    for r in ids.select("counts").filter("counts is not null").mapInArrow(_count(size), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    freq = rans.frequencies(counts)
    seen = np.flatnonzero(freq).tolist()
    spark.createDataFrame([(i, int(freq[i])) for i in seen], "id bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/table")
    tokens = int(counts.sum())
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // PART_TOKENS)
    order = [F.col("doc_id").asc_nulls_first(), F.col("n").asc(), F.xxhash64("ids").asc()]  # rows of one id, and rows without one, spread too
    ordered = ids.drop("counts").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(_pack(spark.sparkContext.broadcast(freq), block_tokens, kind), "part bigint, block bigint, n_tokens bigint, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    delete_path(spark, held)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless they aren't wanted, ids (little-endian uint32) of every document, decoded and verified."""
    import numpy as np

    rows = spark.read.schema("id bigint, frequency bigint").parquet(f"{path}/table").collect()  # one for each id of the vocabulary at most
    freq = np.zeros(max((r.id for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        freq[r.id] = r.frequency
    blocks = spark.read.schema("part bigint, block bigint, n_tokens bigint, data binary").parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    places = blocks.select("part", "block", "n_tokens")
    inside = places.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("at"))
    first = inside.join(before, "part").select("part", "block", (F.col("at") + F.col("base")).alias("first"))
    placed = blocks.join(F.broadcast(first) if _small(first) else first, ["part", "block"])
    return placed.select("first", "n_tokens", "data").mapInArrow(_decode(spark.sparkContext.broadcast(freq), with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def _small(first: DataFrame, rows: int = 1_000_000) -> bool:
    """Whether the places of all blocks (three numbers each) may be broadcast."""
    return first.limit(rows + 1).count() <= rows


def token_digests(docs: DataFrame) -> DataFrame:
    """docs written and read back; what the files hold, without the ids."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path, with_ids=False).drop("ids")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents"))


QUERIES = {"op5_token_output": op5_token_output}
SQL: dict[str, str] = {}
