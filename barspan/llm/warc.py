"""WARC archives compressed record by record with a Zstandard dictionary built from the archive's own records.

An archive begins with a skippable frame that holds the dictionary; each record after it is a frame of its own, so
any record can be read alone. Payloads of at least ``MIN_REVISIT`` bytes that occur again are written once, as the response of
the least page_id; the others are revisit records that name it. Archives are rows of a table in the shared folder; ``common.export`` writes
them out as files of their own.

Defined cases: a null html is an empty payload; a null url is written as an empty target; repeated rows of one page_id are records
of their own, with their own record ids, and all of them responses if they are the first of their payload; a null page_id counts as greater
than all others and is written as an empty number; an empty table gives no archives. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm import common

MIN_REVISIT = 100
#: Payload bytes after which an archive is closed; a longer payload makes a longer archive.
ARCHIVE_BYTES = 32 << 20
#: Dictionary size, and bytes of records it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
LEVEL = 3
#: The first of the frame numbers that decoders skip is 0x184D2A50; this one marks a dictionary.
DICTIONARY_FRAME = 0x184D2A5D

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(name: str, page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """A response with its payload, or without one a revisit of another page's, found by that page's number and the payload's digest."""
    headers = [
        ("WARC-Record-ID", name),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
    ]
    if payload is None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
        return record("revisit", [*headers, ("Content-Type", "application/http; msgtype=response")], _HTTP % size)
    return record("response", [*headers, ("Content-Type", "application/http; msgtype=response")], _HTTP % size + payload)


def archive(records: list[bytes]) -> bytes:
    """Dictionary frame, then a frame for each record."""
    sample, size = [], 0
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        if size < DICTIONARY_BYTES or len(sample) < 8:
            raise zstandard.ZstdError("too little to build a dictionary from")
        raw = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=1024, d=8, steps=1, threads=0).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(sample)[-DICTIONARY_BYTES:]  # few records: their own bytes serve as the dictionary
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *(pack.compress(r) for r in records)])


def records(file: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case, the kind under "warc-type") and block of each record."""
    mark, size = struct.unpack_from("<II", file)
    if mark != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(file[8 : 8 + size]))
    at, view = 8 + size, memoryview(file)
    while at < len(file):
        one = unpack.decompressobj()
        raw = one.decompress(view[at:])
        at = len(file) - len(one.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        yield headers, rest[: int(headers["content-length"])]


ARCHIVES = "archive long, n_records long, file binary"


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """A written table of archives (archive, n_records, file) of ``pages`` (page_id, url, html)."""
    common.arrow_rows(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("size", F.length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # Only digests are grouped. Payloads are dealt by page and digest, so a payload that very many pages share meets nowhere.
    known = rows.where(F.col("size") >= MIN_REVISIT).select("page_id", "digest").distinct()
    firsts = known.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = known.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select(F.col("page_id").alias("again"), F.col("digest").alias("same"), F.col("first.page_id").alias("refers_to"))
    placed = rows.join(common.written(revisits, "revisits"), F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")
    placed = placed.select("page_id", "url", "size", "digest", "refers_to", F.when(F.col("same").isNull(), F.col("payload")).alias("payload"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, k = [], 0, 0

        def number() -> int:
            return (TaskContext.get().partitionId() << 32) + k

        def closed() -> pa.RecordBatch:
            row = [number(), len(held), archive([record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{number()}>"), ("WARC-Date", "1970-01-01T00:00:00Z")], b"format: WARC File Format 1.1\r\n"), *held])]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["archive", "n_records", "file"])

        for batch in batches:
            for page, url, n, digest, refers, body in zip(*(batch[c] for c in ("page_id", "url", "size", "digest", "refers_to", "payload")), strict=True):
                held.append(page_record(f"<urn:archive:{number()}:record:{len(held) + 1}>", page.as_py(), url.as_py(), n.as_py(), digest.as_py(), body.as_py(), refers.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()
                    held, size, k = [], 0, k + 1
        if held:
            yield closed()

    return common.written(placed.mapInArrow(files, ARCHIVES), "archives", "none")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and with ``payload`` the bytes.

    A response's length and digest are taken from its payload as read; a revisit's from its headers.
    """
    common.arrow_rows(archives.sparkSession)
    types = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}
    types |= {"payload": "binary"} if payload else {}
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["file"]:
                out: list[tuple] = []
                size = 0
                for head, block in records(file.as_py()):
                    kind, body = head["warc-type"], None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                        told = len(body), hashlib.sha256(body).hexdigest()
                    elif kind == "revisit":
                        told = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    else:
                        continue
                    out.append((number(head["x-page-id"]), unquote(head["warc-target-uri"]), *told, kind, number(head.get("x-refers-to-page")), body))
                    size += len(body or b"") if payload else 0
                    if size > 16 << 20:
                        yield made(out)
                        out, size = [], 0
                if out:
                    yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in zip(zip(*rows, strict=True), types.values(), strict=False)], list(types))

    return archives.select("file").mapInArrow(pages, ", ".join(f"{k} {v}" for k, v in types.items()))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(common.read(spark, sf_dir, "pages").select("page_id", "url", "html")), payload=False).drop("url")


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM r
"""
