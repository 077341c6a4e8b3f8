"""Static range asymmetric numeral system over token ids, in interleaved lanes.

A block is decoded on its own: header, table of its documents, checkpoints
(state of every lane and place in the payload, every `STEPS` steps) with a
checksum of the tokens up to the next checkpoint, payload. All blocks share one
frequency table. States are 64-bit in [2^31, 2^63), renormalised by 32-bit words.

Layout (little-endian): magic "RNS1", uint32 lanes, uint32 documents,
uint64 tokens, uint32 checkpoints, uint32 payload words, uint32 crc32 of the
rest, then int64 document ids, uint8 null marks, uint64 document lengths,
uint32 segment checksums, uint32 payload places, uint64 lane states, payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20  # bits of the frequency table's sum, at least; more for more than 2^18 symbols
LANES = 2048
STEPS = 128
MAGIC = b"RNS1"
_HEAD = struct.Struct("<4sIIQIII")
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^scale, a power of 2; every symbol that occurs keeps 1 at least."""
    counts = np.asarray(counts, dtype=np.int64)
    seen = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(seen):
        return out
    scale = max(SCALE, len(seen).bit_length() + 1)
    c = counts[seen]
    room = (1 << scale) - len(seen)
    exact = c * (room / c.sum())
    got = np.floor(exact).astype(np.int64)
    order = np.lexsort((seen, got - exact))  # largest remainder first, then the smaller id
    got[order[: room - int(got.sum())]] += 1
    out[seen] = got + 1
    return out


class Tables:
    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.pad = int(np.argmax(self.freq))
        self.scale = max(1, int(self.freq.sum())).bit_length() - 1
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(tokens: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, t: Tables, lanes: int = LANES, steps: int = STEPS) -> bytes:
    """One block of whole documents; sum(lengths) tokens."""
    n = len(tokens)
    total = -(-n // lanes)
    padded = np.full(total * lanes, t.pad, dtype=np.int64)
    padded[:n] = tokens
    f, c = t.freq[padded].reshape(total, lanes), t.cum[padded].reshape(total, lanes)
    if n and not f.min():
        raise ValueError("a token is not in the frequency table")
    x, words, states = np.full(lanes, _LOW, dtype=np.uint64), [], {}
    shift, scale = np.uint64(63 - t.scale), np.uint64(t.scale)
    for s in range(total - 1, -1, -1):
        fs = f[s]
        out = x >= (fs << shift)
        words.append(x[out].astype(np.uint32))
        x = np.where(out, x >> _32, x)
        q = x // fs
        x = (q << scale) + (x - q * fs) + c[s]
        if s % steps == 0:
            states[s] = x
    words.reverse()
    places = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.uint32)
    marks = range(0, total, steps)
    raw = np.ascontiguousarray(tokens, dtype="<u4")
    sums = np.array([zlib.crc32(raw[s * lanes : (s + steps) * lanes].tobytes()) for s in marks], dtype="<u4")
    body = b"".join(
        [
            np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(),
            np.array([i is None for i in doc_ids], dtype=np.uint8).tobytes(),
            np.asarray(lengths, dtype="<u8").tobytes(),
            sums.tobytes(),
            places[list(marks)].astype("<u4").tobytes() if total else b"",
            b"".join(states[s].astype("<u8").tobytes() for s in marks),
            np.concatenate(words).astype("<u4").tobytes() if words else b"",
        ]
    )
    return _HEAD.pack(MAGIC, lanes, len(doc_ids), n, len(marks), int(places[-1]), zlib.crc32(body)) + struct.pack("<I", steps) + body


class Block:
    """A block read back; segments between checkpoints decode independently."""

    def __init__(self, data: bytes):
        magic, self.lanes, docs, self.n, self.marks, words, crc = _HEAD.unpack_from(data)
        (self.steps,) = struct.unpack_from("<I", data, _HEAD.size)
        body = memoryview(data)[_HEAD.size + 4 :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, dtype=kind, count=count, offset=at)
            at += got.nbytes
            return got

        ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.sums, self.places = take("<u4", self.marks), take("<u4", self.marks)
        self.states = take("<u8", self.marks * self.lanes).reshape(self.marks, self.lanes)
        self.payload = take("<u4", words)

    def segment(self, k: int, t: Tables) -> np.ndarray:
        """Tokens from checkpoint k up to the next one."""
        first = k * self.steps
        count = min(self.steps, -(-self.n // self.lanes) - first)
        x, at = self.states[k].astype(np.uint64), int(self.places[k])
        out = np.empty((count, self.lanes), dtype=np.uint32)
        mask, scale = np.uint64((1 << t.scale) - 1), np.uint64(t.scale)
        for s in range(count):
            slot = x & mask
            symbol = t.slots[slot]
            out[s] = symbol
            x = t.freq[symbol] * (x >> scale) + slot - t.cum[symbol]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << _32) | self.payload[at : at + len(low)].astype(np.uint64)
                at += len(low)
        got = out.reshape(-1)[: self.n - first * self.lanes].astype("<u4")
        if zlib.crc32(got.tobytes()) != int(self.sums[k]):
            raise ValueError("damaged segment")
        return got

    def tokens(self, t: Tables) -> np.ndarray:
        return np.concatenate([self.segment(k, t) for k in range(self.marks)]) if self.marks else np.zeros(0, dtype="<u4")
