"""Secret scans with structural confirmation.

Method: simple patterns find candidates; before a candidate of the confirmed
kinds is reported it is decoded (base64, base64url or hex) and its structure
is parsed: a signed token needs a JSON header naming an algorithm, a JSON
payload and a signature of the algorithm's length; a key in DER needs a
SEQUENCE whose nested lengths fill exactly their parents and hold the fields
of a key; an SSH key needs length-prefixed fields that fill the blob and a
known algorithm name or the private container's magic. Lines that follow a body
without padding look like more of it, so a body ends where the key's own lengths
say, if the text has the end of a line, padding or a dashed line there. Hex that
is the whole of a key or of a signed token is reported as such.

The base kinds (assign, access, hex) come from their patterns alone and always
stay; confirmed kinds (jwt, der, ssh) are added.

Defined cases: a null or empty text has no spans; repeated documents are
scanned row by row; an empty table gives no rows; texts of any length are
scanned whole; columns of the input named like a result column give way to it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.llm.common import quoted, read, slices

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
BODY = re.compile(r"(?:M[A-P]|AAAA|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{30,}")
ENCODED = re.compile(rf"(?<![A-Za-z0-9+/_-]){BODY.pattern}(?:\r?\n[A-Za-z0-9+/_-]+)*={{0,2}}")
#: Hex of a SEQUENCE, of a field's length or the private container's magic, or of a token's first letters.
HEX_KEY = re.compile(r"(?i)(?<![0-9a-f])(?:30|000000|6f70656e7373682d6b65792d7631|65794a)[0-9a-f]{48,}")
MAX_KEY = 1 << 16  # bytes; a body that claims more is no key
#: Signature bytes by algorithm (0: none; None: the length of the key).
SIGNATURES = {"none": 0, "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}
#: Names of SSH key algorithms.
SSH_NAMES = {"ssh-rsa", "ssh-dss", "ssh-ed25519", "ecdsa-sha2-nistp256", "ecdsa-sha2-nistp384", "ecdsa-sha2-nistp521", "sk-ssh-ed25519@openssh.com", "sk-ecdsa-sha2-nistp256@openssh.com"}
SSH_MAGIC = b"openssh-key-v1\x00"
#: Fields of a public key blob, where they aren't three.
SSH_FIELDS = {"ssh-dss": 5, "ssh-ed25519": 2, "sk-ecdsa-sha2-nistp256@openssh.com": 4}


def _base64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    raw = [_base64(x) for x in (header, payload, signature)]
    if raw[0] is None or raw[1] is None or raw[2] is None:
        return False
    try:
        head, body = json.loads(raw[0].decode("utf-8")), json.loads(raw[1].decode("utf-8"))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or head.get("alg") not in SIGNATURES:
        return False
    size = SIGNATURES[head["alg"]]
    return len(raw[2]) >= 128 if size is None else len(raw[2]) == size


def der_elements(data: bytes, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the elements that fill data[start:end] exactly; None if they don't."""
    end, out = len(data) if end is None else end, []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end or not data[at]:
                return None
            size = int.from_bytes(data[at : at + count], "big")
            at += count
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def _nested(data: bytes, a: int, b: int, depth: int = 0) -> bool:
    """Whether the nested lengths of all constructed elements fit."""
    inner = der_elements(data, a, b)
    return inner is not None and depth < 12 and all(not tag & 0x20 or _nested(data, x, y, depth + 1) for tag, x, y in inner)


def is_der_key(data: bytes | None) -> bool:
    """PKCS#1, PKCS#8, SEC1, encrypted PKCS#8 or a public key: one SEQUENCE, nested lengths that fit, a key's fields."""
    if not data or data[0] != 0x30 or len(data) < 40:
        return False
    top = der_elements(data)
    if not top or len(top) != 1 or not _nested(data, top[0][1], top[0][2]):
        return False
    parts = der_elements(data, top[0][1], top[0][2]) or []
    tags = [t for t, _, _ in parts]
    first_oid = lambda a, b: (e := der_elements(data, a, b)) and e[0][0] == 0x06 or bool(e and e[0][0] == 0x30 and (i := der_elements(data, e[0][1], e[0][2])) and i[0][0] == 0x06)
    if len(tags) >= 8 and all(t == 0x02 for t in tags[:9]):
        return True  # RSA or DSA private key
    if tags[:3] == [0x02, 0x30, 0x04] and first_oid(*parts[1][1:]):
        return True  # PKCS#8
    if tags[:2] == [0x02, 0x04] and data[parts[0][1] : parts[0][2]] == b"\x01" and parts[1][2] - parts[1][1] in (28, 32, 48, 66):
        return True  # SEC1
    if tags == [0x30, 0x03] or tags == [0x30, 0x04]:
        return bool(first_oid(*parts[0][1:]))  # public key, encrypted PKCS#8
    return False


def is_ssh_key(data: bytes | None) -> bool:
    """A public key blob or the private container, whose length-prefixed fields fill it."""
    if not data:
        return False
    at, private = (len(SSH_MAGIC), True) if data.startswith(SSH_MAGIC) else (0, False)
    fields, keys, seen = [], 1, 0
    while at < len(data):
        if private and seen == 3:
            keys, at, seen = int.from_bytes(data[at : at + 4], "big"), at + 4, 4
            continue
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return False
        fields.append(data[at : at + size])
        at, seen = at + size, seen + 1
    if private:
        return len(fields) == 3 + keys + 1 and keys >= 1 and all(map(is_ssh_key, fields[3 : 3 + keys]))
    return len(fields) >= 2 and fields[0].decode("latin-1") in SSH_NAMES and all(fields[1:])


def der_size(data: bytes) -> int | None:
    """Bytes of the SEQUENCE at the start, by its own length."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    count = data[1] & 0x7F if data[1] & 0x80 else 0
    return 2 + data[1] if not data[1] & 0x80 else 2 + count + int.from_bytes(data[2 : 2 + count], "big") if 1 <= count <= 4 else None


def ssh_size(data: bytes) -> int | None:
    """Bytes of the public key blob or private container at the start, by its fields' lengths."""

    def skip(at: int, fields: int) -> int:
        for _ in range(fields):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            if at > len(data):
                break
        return at

    if data.startswith(SSH_MAGIC):
        at = skip(len(SSH_MAGIC), 3)
        return skip(at + 4, int.from_bytes(data[at : at + 4], "big") + 1)
    name = data[4 : 4 + int.from_bytes(data[:4], "big")].decode("latin-1")
    return skip(0, SSH_FIELDS.get(name, 3)) if name in SSH_NAMES else None


def _key_at(run: str) -> tuple[str, int] | None:
    """Kind and length in characters of the encoded key at the start of a run of lines."""
    run = run[: 2 * MAX_KEY]  # its lines and their ends; more than a key of MAX_KEY bytes takes
    flat = re.sub(r"[\s=]", "", run).replace("-", "+").replace("_", "/")
    data = base64.b64decode(flat + "A" * (-len(flat) % 4))[: len(flat) * 3 // 4]
    kind, test, size = ("der", is_der_key, der_size(data)) if data[:1] == b"\x30" else ("ssh", is_ssh_key, ssh_size(data))
    if size and size <= len(data) and test(data[:size]):
        left = -(-size * 4 // 3)
        for line in re.finditer(r"[^\s=]+", run):
            if left <= len(line[0]):
                rest = run[line.start() + left :]
                if not rest or rest.startswith(("\r", "\n", "=", "-----")):
                    return kind, len(run) - len(rest.lstrip("="))
                break
            left -= len(line[0])
    return (kind, len(run)) if test(_base64(run)) else None


def _keys(run: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the keys in a run of encoded lines, each at the start of a line."""
    out, end = [], 0
    for line in re.finditer(r"[^\s=]+", run):
        if line.start() >= end and BODY.match(run, line.start()) and (key := _key_at(run[line.start() :])):
            end = line.start() + key[1]
            out.append((line.start(), key[0], end))
    return out


def _hex_kind(digits: str) -> str | None:
    """What a run of hex digits is the whole of."""
    if len(digits) % 2:
        return None
    data = bytes.fromhex(digits)
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    token = TOKEN.fullmatch(data.decode("latin-1"))
    return "jwt" if token and is_signed_token(*token.groups()) else None


def find(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start, then kind as in KINDS."""
    if not text:
        return []
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), "jwt", m.end()) for m in TOKEN.finditer(text) if is_signed_token(*m.groups())]
    for m in ENCODED.finditer(text):
        out += [(m.start() + a, kind, m.start() + b) for a, kind, b in _keys(m[0])]
    for m in HEX_KEY.finditer(text):
        if kind := _hex_kind(m[0]):
            out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _scan(columns: list[str]):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in find(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, kind)], names=[*columns, "secrets"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """docs with secrets: array of kind, start, end (code points, end exclusive)."""
    kept = [c for c in docs.columns if c.lower() != "secrets"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("secrets", T.ArrayType(_SPAN))])
    return docs.select([f"`{c}`" for c in kept]).mapInArrow(_scan(kept), schema)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs whose texts have every span (overlapping ones together) replaced by mask."""
    found = scan(docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("kept_row"), "text"))
    text = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask)).alias("out"), x["end"].alias("at"))).otherwise(
            F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))
        ),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    return found.select([text.alias("text") if c == "text" else F.col(f"kept_row.`{c}`").alias(c) for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), *[count(k) for k in KINDS[3:]])


QUERIES = {"op4_secrets": op4_secrets}
SQL: dict[str, str] = {}
