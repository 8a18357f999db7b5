"""Token ids kept as wavelet matrices: one compressed file per shard that answers access, rank and select.

A file holds a run of documents in doc_id order. Its ids, numbered within the file's own alphabet, stand in bit-planes from the highest bit
down; each plane is the ids' bits after a stable partition by the bits above, with counts of ones per
block. Planes are compressed one by one, so a reader takes only what it needs.

Files are rows of a table in the shared folder; ``common.export`` writes them out as files of their own.

Defined cases: a null text is empty; every document has at least its end id; repeated doc_ids keep all
their rows, ordered by a hash of the text; a null doc_id sorts first; an empty table gives no files. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm import common, tok

MAGIC = b"BSWM0002"
#: Bits between stored counts of ones.
BLOCK = 512
#: Ids of a plane worked on at once: they stay in a core's cache. A multiple of BLOCK.
CHUNK = 1 << 16
#: Ids after which a shard's file is closed; a longer document makes a longer file.
SHARD_IDS = 1 << 22

FILES = "shard long, n_docs long, n_ids long, file binary"


def _packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """One file from the ids of whole documents in a row."""
    # Ids that do not occur take no bits: the file's alphabet is the ids that do, ascending.
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    bits = max(1, (len(alphabet) - 1).bit_length())
    number = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if bits <= 16 else np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    now = number[ids]
    high = np.empty_like(now)
    parts, zeros = [], []
    for level in range(bits - 1, -1, -1):
        padded = np.zeros(-(-len(now) // BLOCK) * BLOCK // 64, "<u8")
        low = ones = 0
        for k in range(0, len(now), CHUNK):
            part = now[k : k + CHUNK]
            one = (part & now.dtype.type(1 << level)) != 0
            packed = np.packbits(one, bitorder="little")
            padded.view(np.uint8)[k // 8 : k // 8 + len(packed)] = packed
            up, down = np.compress(one, part), np.compress(~one, part)
            high[ones : ones + len(up)] = up
            now[low : low + len(down)] = down
            low, ones = low + len(down), ones + len(up)
        now[low:] = high[:ones]
        counts = np.cumsum(np.bitwise_count(padded).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32), dtype="<u4")
        parts += [_packed(padded.tobytes()), _packed(counts.tobytes())]
        zeros.append(low)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    parts += [_packed(np.packbits(known).tobytes()), _packed(np.diff(docs, prepend=0).tobytes()), _packed(np.asarray(lengths, "<u4").tobytes()), _packed(np.diff(alphabet, prepend=0).astype("<u4").tobytes())]
    head = struct.pack("<8sQQB", MAGIC, len(ids), len(docs), bits) + np.array([*zeros, *map(len, parts)], "<u8").tobytes()
    return b"".join([head, *parts])


class WaveletShard:
    """A file's ids: ``access``, ``rank``, ``count``, ``select``, ``locate`` and whole documents."""

    def __init__(self, file: bytes):
        magic, self.n, self.n_docs, self.bits = struct.unpack_from("<8sQQB", file)
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        at = struct.calcsize("<8sQQB")
        table = np.frombuffer(file, "<u8", self.bits + 2 * self.bits + 4, at)
        self.zeros = [int(z) for z in table[: self.bits]]
        ends = at + table.nbytes + np.cumsum(table[self.bits :], dtype=np.int64)
        starts = ends - table[self.bits :].astype(np.int64)
        self._part = lambda k: zstandard.ZstdDecompressor().decompress(file[starts[k] : ends[k]])
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.alphabet = np.cumsum(np.frombuffer(self._part(2 * self.bits + 3), "<u4"), dtype=np.int64)

    def _number(self, token: int) -> int | None:
        """The token's number in the alphabet, if it occurs."""
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the plane, and ones before each block."""
        if level not in self._planes:
            ones = np.frombuffer(self._part(2 * level + 1), "<u4")
            self._planes[level] = np.frombuffer(self._part(2 * level), "<u8"), np.concatenate(([0], ones)).astype(np.int64)
        return self._planes[level]

    def _rank1(self, level: int, at: int) -> int:
        words, ones = self._plane(level)
        block, word = at // BLOCK, at // 64
        got = int(ones[block]) + int(np.bitwise_count(words[block * BLOCK // 64 : word]).sum())
        return got + (int(words[word]) & ((1 << at % 64) - 1)).bit_count() if at % 64 else got

    def _select(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) bit of this value."""
        words, ones = self._plane(level)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        inside = np.unpackbits(words[block * BLOCK // 64 : (block + 1) * BLOCK // 64].view(np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            words, _ = self._plane(level)
            bit = int(words[at // 64]) >> at % 64 & 1
            value = value << 1 | bit
            at = self.zeros[level] + self._rank1(level, at) if bit else at - self._rank1(level, at)
        return int(self.alphabet[value])

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the numbered token's occurrences before ``end`` stand after the last plane."""
        lo, hi = 0, end
        for level in range(self.bits):
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = (self.zeros[level] + self._rank1(level, x) for x in (lo, hi))
            else:
                lo, hi = (x - self._rank1(level, x) for x in (lo, hi))
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """Occurrences before a place."""
        if (number := self._number(token)) is None:
            return 0
        lo, hi = self._range(number, min(max(end, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        token = self._number(token)
        at = self._range(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if bit else at, bit)
        return at

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        above = np.empty_like(now)
        for level in range(self.bits - 1, -1, -1):
            plane, low, high = self._plane(level)[0].view(np.uint8), 0, self.zeros[level]
            for k in range(0, self.n, CHUNK):
                part = above[k : k + CHUNK]
                one = np.unpackbits(plane[k // 8 : (k + CHUNK) // 8], count=len(part), bitorder="little").view(bool)
                up, down = np.flatnonzero(one), np.flatnonzero(~one)
                part[down] = now[low : low + len(down)]
                part[up] = now[high : high + len(up)] | kind(1 << (self.bits - 1 - level))
                low, high = low + len(down), high + len(up)
            now, above = above, now
        return self.alphabet.astype("<u4")[now] if self.n else now.astype("<u4")

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids and numbers of ids."""
        k = 2 * self.bits
        known = np.unpackbits(np.frombuffer(self._part(k), np.uint8), count=self.n_docs)
        docs = np.cumsum(np.frombuffer(self._part(k + 1), "<i8"))
        lengths = np.frombuffer(self._part(k + 2), "<u4").astype(np.int64)
        return [int(d) if ok else None for d, ok in zip(docs, known, strict=True)], lengths


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt by ranges of doc_id and sorted within.

    The hash deals rows that share a doc_id, or have none, to many tasks; the salt does so for rows that are equal, whose order is all one.
    """
    order = ["doc_id", "h", "salt"]
    rows = common.texts(docs).withColumn("h", F.xxhash64("text")).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def write_shards(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files, in doc_id order over ``shard``; a written table, a row per file."""
    path = path or tok.vocabulary()
    common.arrow_rows(docs.sparkSession)
    dealt = in_order(docs)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, n, k = tok.encoder(path), [], 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            file = build(ids, sum((x[1] for x in held), []), np.concatenate([x[2] for x in held]))
            row = [(TaskContext.get().partitionId() << 32) + k, sum(len(x[1]) for x in held), len(ids), file]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "n_docs", "n_ids", "file"])

        for batch in batches:
            for a, m in tok.in_parts(batch["text"], min(shard_ids, 4_000_000)):
                counts, ids = tok.with_end(*encode(batch["text"].slice(a, m)))
                held.append((ids, batch["doc_id"].slice(a, m).to_pylist(), counts))
                n += len(ids)
                if n >= shard_ids:
                    yield closed()
                    held, n, k = [], 0, k + 1
        if held:
            yield closed()
            held = []
        encode.rest()

    return common.written(dealt.mapInArrow(shards, FILES), "token-files", "none")


def read_shards(files: DataFrame, of_document: Callable[[np.ndarray], object] = lambda ids: ids.tobytes(), kind: str = "binary", name: str = "ids") -> DataFrame:
    """The documents in the files: doc_id, start (ids of all documents before), n_tokens, and a value made from the ids."""
    schema = f"shard long, doc_id long, inside long, n_tokens long, {name} {kind}"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = pa.binary() if kind == "binary" else pa.int64()
        for batch in batches:
            for shard, file in zip(batch["shard"].to_pylist(), batch["file"], strict=True):
                held = WaveletShard(file.as_py())
                (docs, lengths), ids = held.documents(), held.ids()
                ends = np.cumsum(lengths)
                made = [of_document(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(made, value)], ["shard", "doc_id", "inside", "n_tokens", name])

    common.arrow_rows(files.sparkSession)
    # One row per file of millions of ids.
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    found = files.select("shard", "file").mapInArrow(documents, schema)
    return found.join(starts, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", name)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import zlib

    files = write_shards(common.read(spark, sf_dir, "documents"))
    return read_shards(files, lambda ids: zlib.crc32(ids.tobytes()), "long", "ids_crc32")
