"""Packing along a space-filling curve: like documents share sequences, and almost nothing is padding.

Each document's ids are summed up as a hashed vector, projected to a few dimensions, and placed on a Hilbert curve. Along
the curve all ids form one stream; every ``length`` ids of it are a sequence. A document is cut where a sequence ends,
so only the very last sequence can be short. The curve is cut into ranges at quantiles of the documents' places; a range's ids are
summed up first, so each range knows where in the stream it begins.

Defined cases: a null text is empty; every document has at least its end id; repeated rows and repeated or null doc_ids are
packed row by row; an empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm import common, tok

LENGTH = 4096
#: Dimensions of the curve and bits of each.
DIMENSIONS, BITS = 4, 10
#: Size of the hashed document vector.
HASHED = 1 << 12
#: Ids in a range of the curve, of which one task cuts one, and most ranges.
PART_TOKENS, MOST_PARTS = 1 << 21, 1 << 14
#: Bits of the hash that parts rows of one cell.
TIES = 23
#: Bytes of pieces that leave a task at once.
PIECE_BYTES = 2 << 20


@functools.cache
def _projection() -> np.ndarray:
    return np.random.default_rng(4096).standard_normal((HASHED, DIMENSIONS)).astype(np.float32)


def project(bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Mean random projection of the hashed ids of each run; runs are not empty."""
    at = (ids * np.uint32(2654435761)) >> np.uint32(20)
    # Ids are numbered by how early, so how often, their letters came together: rarer ones count for more.
    weight = np.log2(ids.astype(np.float32) + 2)
    sums = np.stack([np.add.reduceat(column[at] * weight, bounds[:-1]) for column in _projection().T], axis=1)
    return sums / np.add.reduceat(weight, bounds[:-1])[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows x dimensions, each under 2**bits).

    Undoes the curve's reflections and exchanges from the highest bit down, takes the Gray code of the
    axes, and interleaves their bits.
    """
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for k in range(bits - 1, 0, -1):
        top, low = one << np.uint64(k), (one << np.uint64(k)) - one
        for axis in range(len(x)):
            set_ = (x[axis] & top) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (one << np.uint64(k)), (one << np.uint64(k)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            key = key << one | (x[axis] >> np.uint64(k)) & one
    return key.astype(np.int64)


def curve_keys(bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    spread = np.tanh(project(bounds, ids) * 4)
    return hilbert(np.clip((spread + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A written table of the documents' ids: row (its number), doc_id, doc_tokens, place (on the curve, rows of one cell in hashed order), packed ids."""
    path = path or tok.vocabulary()
    common.arrow_rows(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = tok.encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, m in tok.in_parts(batch["text"]):
                counts, ids = tok.with_end(*encode(batch["text"].slice(a, m)))
                bounds = np.concatenate(([0], np.cumsum(counts)))
                small = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                width = small.itemsize
                raw = small.tobytes()
                packed = [bytes([width]) + pack.compress(raw[x * width : y * width]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, m), pa.array(counts), pa.array(curve_keys(bounds, ids)), pa.array(packed, pa.binary())], ["doc_id", "doc_tokens", "key", "ids"])
        encode.rest()

    found = common.texts(docs).mapInArrow(rows, "doc_id long, doc_tokens long, key long, ids binary").withColumn("row", F.monotonically_increasing_id())
    # The hash parts rows of one cell, so that a range may end between them: a third of all texts may be alike.
    place = F.shiftleft("key", TIES).bitwiseOR(F.xxhash64("row").bitwiseAND(F.lit((1 << TIES) - 1)))
    return common.written(found.select("row", "doc_id", "doc_tokens", place.alias("place"), "ids"), "encoded", "none")


def ranges(rows: DataFrame, part_tokens: int = PART_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each range of the curve but the first, ids before each range): at most MOST_PARTS numbers each."""
    total = rows.agg(F.sum("doc_tokens")).first()[0] or 0
    n = min(MOST_PARTS, max(1, -(-total // part_tokens)))
    cuts: list[int] = []
    if n > 1:
        cuts = rows.agg(F.percentile_approx("place", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
    bounds = np.unique(np.array(cuts, np.int64))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            np.add.at(sums, np.searchsorted(bounds, batch["place"].to_numpy(), "right"), batch["doc_tokens"].to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["part", "n"])

    sums = np.zeros(len(bounds) + 1, np.int64)
    for part, n in rows.select("place", "doc_tokens").mapInArrow(summed, "part long, n long").groupBy("part").agg(F.sum("n")).collect():
        sums[part] = n
    return bounds, np.cumsum(sums) - sums


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, payload: bool = True, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``payload`` their ids (unsigned, 32 bits).

    The packed ids cross the network once, to their range of the curve, and are cut there, so that the pieces of a sequence lie together.
    """
    rows = encoded(docs, path)
    bounds, before = ranges(rows, part_tokens)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * payload

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds, batch["place"].to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", *batch.schema.names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out, held, part, at = zstandard.ZstdDecompressor(), [[] for _ in names], 0, -1, 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in zip(names, out, strict=True)], names)

        for batch in batches:
            for p, doc, n, file in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["doc_tokens"].to_pylist(), batch["ids"], strict=True):
                if p != part:
                    part, at = p, int(before[p])
                file = file.as_py()
                ids = memoryview(np.frombuffer(unpack.decompress(file[1:]), f"<u{file[0]}").astype("<u4").tobytes())
                start = 0
                while start < n:
                    sequence, offset = divmod(at, length)
                    m = min(n - start, length - offset)
                    piece = ids[4 * start : 4 * (start + m)]
                    for column, v in zip(out, (doc, start, m, zlib.crc32(piece), n, sequence, offset), strict=False):
                        column.append(v)
                    if payload:
                        out[-1].append(bytes(piece))
                    start, at, held = start + m, at + m, held + 64 + 4 * m * payload
                    if held > PIECE_BYTES:
                        yield made()
                        out, held = [[] for _ in names], 0
        if held:
            yield made()
        common.rest()

    placed = rows.mapInArrow(dealt, "part int, row long, doc_id long, doc_tokens long, place long, ids binary")
    placed = placed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "place", "row").select("part", "doc_id", "doc_tokens", "ids")
    return placed.mapInArrow(cut, ", ".join(f"`{c}` {'binary' if c == 'ids' else 'long'}" for c in names))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its ids in order; pieces of a sequence are never more than its length."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op9_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"), payload=False)
