"""Secrets in whole texts: patterned assignments, and keys and tokens confirmed by decoding them.

Beside three base patterns, candidates in base64 or hexadecimal are decoded and reported only if their structure holds:
DER key encodings whose nested lengths all add up, OpenSSH key files whose length-prefixed parts do, armoured
blocks around either, and signed tokens whose header and claims are JSON objects.

Places count code points, ends are exclusive. Every pattern takes time linear in the text, so very long texts are scanned whole.
Defined cases: a null or empty text has no spans; spans of different kinds may
overlap, those of one kind do not; repeated rows are scanned row by row; an empty table gives no rows. Columns other than doc_id and text are not read
(``redact`` keeps all columns).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspan.llm import common

KINDS = ("assign", "access", "hex", "pem", "jwt", "base64_key", "hex_key")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so shorter ones need not be matched and dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
#: Maximal runs of what a signed token may hold. Each is matched once and parted at its dots, so the time is linear in the text.
TOKENS = re.compile(r"[A-Za-z0-9_.-]+")
JSON_OPENS = ("ey", "ew")  # an opening brace, and what may follow it, in base64
#: A DER sequence's first byte is 0x30: "M" in base64, "30" in hexadecimal. OpenSSH's magic begins with "b3Blbn".
DER64 = re.compile(r"M[A-Za-z0-9+/_-]{39,}={0,2}")
SSH64 = re.compile(r"b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]{39,}={0,2}")
DER16 = re.compile(r"30[0-9a-fA-F]{62,}")
_JOINS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _decoded(text: str) -> bytes | None:
    text = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _elements(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, first, end) of the DER values that fill this range exactly, else None."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = raw[at], raw[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(raw[at : at + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(raw: bytes) -> bool:
    """A private key: PKCS#1, PKCS#8 (also encrypted), SEC 1 or DSA, its lengths adding up at every level it is read to."""
    top = _elements(raw, 0, len(raw))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = _elements(raw, *top[0][1:])
    if not parts:
        return False
    tags, value = [p[0] for p in parts], raw[parts[0][1] : parts[0][2]]
    if tags[:2] == [0x30, 0x04]:  # encrypted: algorithm, octets
        inner = _elements(raw, *parts[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and len(parts) == 2
    if tags[0] != 0x02 or value not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [0x30, 0x04]:  # algorithm, octets
        inner = _elements(raw, *parts[1][1:])
        return bool(inner) and inner[0][0] == 0x06
    if value == b"\1" and tags[1] == 0x04:  # SEC 1: octets, then tagged parameters
        return 16 <= parts[1][2] - parts[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    return tags in ([0x02] * 9, [0x02] * 6) and all(b > a for _, a, b in parts)


def is_openssh_key(raw: bytes) -> bool:
    """Magic; cipher, derivation and its options; a number of keys, that many public keys, and the private part."""
    if not raw.startswith(b"openssh-key-v1\0"):
        return False

    def text(at: int) -> int | None:
        end = at + 4 + int.from_bytes(raw[at : at + 4], "big")
        return end if at + 4 <= end <= len(raw) and at + 4 <= len(raw) else None

    at: int | None = 15
    for _ in range(3):
        if (at := text(at)) is None:
            return False
    n, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    if not 1 <= n <= 16:
        return False
    for _ in range(n + 1):
        if (at := text(at)) is None:
            return False
    return at == len(raw)


def is_key(raw: bytes | None) -> bool:
    return bool(raw) and (is_der_key(raw) or is_openssh_key(raw))


def is_signed_token(text: str) -> bool:
    """Header and claims are JSON objects, and the header names its algorithm."""
    parts = text.split(".")
    try:
        head, claims = (json.loads(_decoded(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def _alone(text: str, match: re.Match) -> bool:
    return not match.start() or text[match.start() - 1] not in _JOINS


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Two or three parts between dots of which the first two decode to JSON objects."""
    for run in TOKENS.finditer(text):
        if run.end() - run.start() < 7 or (".ey" not in run[0] and ".ew" not in run[0]) or not _alone(text, run):
            continue
        parts = run[0].split(".")
        starts = [run.start()]
        for p in parts:
            starts.append(starts[-1] + len(p) + 1)
        k = 0
        while k + 1 < len(parts):
            if all(p.startswith(JSON_OPENS) and len(p) > 2 for p in parts[k : k + 2]) and is_signed_token(".".join(parts[k : k + 2])):
                last = min(k + 3, len(parts))
                yield starts[k], starts[last] - 1
                k = last
            else:
                k += 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", m.start(), m.end()) for m in PEM.finditer(text) if is_key(_decoded(m[2]))]
    if ".ey" in text or ".ew" in text:
        out += [("jwt", a, b) for a, b in signed_tokens(text)]
    found = [m for p in (DER64, SSH64) for m in p.finditer(text)]
    out += [("base64_key", m.start(), m.end()) for m in found if _alone(text, m) and is_key(_decoded(m[0]))]
    for m in DER16.finditer(text):
        if _alone(text, m) and len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
            out.append(("hex_key", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and its spans: an array of (kind, start, end)."""
    common.arrow_rows(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t.as_py() or "")] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])

    return common.texts(docs).mapInArrow(scan, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redacted(text: str, mark: str) -> str:
    out, at = [], 0
    for _, start, end in spans(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, each run of overlapping spans in ``text`` replaced by the mark and n_chars, if there, set anew."""
    common.arrow_rows(docs.sparkSession)
    columns = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, mark) for t in batch["text"].to_pylist()]
            made = {"text": pa.array(texts, batch["text"].type)}
            if "n_chars" in columns:
                made["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, batch["n_chars"].to_pylist(), strict=True)], batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays([made.get(c, batch[c]) for c in columns], columns)
        common.rest()

    return docs.mapInArrow(clean, T.StructType(docs.schema.fields))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(common.read(spark, sf_dir, "documents"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
