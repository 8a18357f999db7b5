"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector's code is the signs of its rotated components, packed, with its length and one correction scalar: the inner product of the
vector's direction with its own code. From the code and a query's rotated, quantised components, population counts estimate the inner
product, and the scalar bounds the estimate's error. Candidates whose upper bound reaches the k-th largest lower bound, or the k-th
score so far, are reranked on the vectors themselves; the tasks' best are merged.

Candidates are scanned where they lie and never cross the network: queries go to them, in chunks of at most ``QUERY_BYTES``, and each
task keeps its k best of each query of the chunk, whose k-th score is the bar for all candidates that it still meets. Scores are
summed component by component in order, so equal vectors have equal scores wherever they lie.

Recall: with ``DEVIATIONS`` = 2.2 the bound holds for about 97 pairs in 100; a neighbour is lost only where it fails by more than
the slack of the k-th lower bound. Measured recall is in the tests.

Defined cases: null and zero vectors, and those with null or non-finite components, take no part, as queries or candidates; vectors of
different lengths are never compared; of repeated rows of one vec_id the least vector counts; ties go to the smaller vec_id; with fewer
than k candidates all are returned; rows with a null vec_id are left out; an empty table gives no rows. Columns other than vec_id and
embedding are not read.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm import common
from barspan.llm.embed_dups import packed, unpacked, usable

K = 20
#: Queries are the rows whose vec_id this divides.
EVERY = 20
DEVIATIONS = 2.2
#: Bits of a quantised query component.
QUERY_BITS = 8
#: Bytes of query vectors that are sent to all tasks at once, and queries that meet a batch of candidates at once.
QUERY_BYTES, TILE = 32 << 20, 64


@functools.cache
def rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dimension, 13]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def lengths(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)
    return (top * np.sqrt(((vectors / top) ** 2).sum(axis=1, keepdims=True)))[:, 0]


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs as 64-bit words, length, correction scalar) of each row."""
    length, dimension = lengths(vectors), vectors.shape[1]
    turned = (vectors / length[:, None]) @ rotation(dimension).T
    bits = np.packbits(turned > 0, axis=1, bitorder="little")
    words = np.zeros((len(vectors), -(-dimension // 64) * 8), np.uint8)
    words[:, : bits.shape[1]] = bits
    return words.view("<u8"), length, np.abs(turned).sum(axis=1) / math.sqrt(dimension)


@dataclasses.dataclass
class Queries:
    """Queries of one dimension (a row each), with their rotated components in QUERY_BITS bits, as bit-planes."""

    ids: np.ndarray
    vectors: np.ndarray
    planes: np.ndarray
    size: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray

    def __getitem__(self, some) -> Queries:
        return Queries(**{f.name: getattr(self, f.name)[some] for f in dataclasses.fields(self)})


def prepared(ids: np.ndarray, vectors: np.ndarray) -> Queries:
    size, dimension = lengths(vectors), vectors.shape[1]
    turned = (vectors / size[:, None]) @ rotation(dimension).T
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
    level = np.zeros((len(vectors), -(-dimension // 64) * 64), np.int64)
    level[:, :dimension] = np.rint((turned - low[:, None]) / step[:, None])
    planes = np.stack([np.packbits((level >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(QUERY_BITS)], axis=1)
    return Queries(ids, vectors, planes, size, low, step, level.sum(axis=1))


def estimates(words: np.ndarray, length: np.ndarray, scalar: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner product, bound of its error), queries x codes."""
    dimension = queries.vectors.shape[1]
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.float64)
    dot = np.zeros((len(queries.ids), len(words)), np.uint16 if dimension <= 256 else np.uint32)
    for b in range(QUERY_BITS - 1, -1, -1):
        dot <<= 1
        for w in range(words.shape[1]):
            dot += np.bitwise_count(words[None, :, w] & queries.planes[:, b, w, None])
    root, (size, low, step, total) = math.sqrt(dimension), (x[:, None] for x in (queries.size, queries.low, queries.step, queries.total))
    around = dot * (2 * step / root)
    around += 2 * low / root * ones
    around -= (low * dimension + step * total) / root
    scale = length / scalar
    around *= scale * size
    error = (DEVIATIONS * np.sqrt(np.maximum(1 - scalar * scalar, 0) / max(dimension - 1, 1)) * scale)[None, :] + step / 2 * root * scale
    error *= size
    return around, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of the one with the same row of the other, summed from the first component on."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


class Nearest:
    """The k best candidates of each query so far."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.ids, self.scores = np.zeros((len(queries.ids), k), np.int64), np.full((len(queries.ids), k), -np.inf)
        self.held = np.zeros(len(queries.ids), np.int64)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, words: np.ndarray, length: np.ndarray, scalar: np.ndarray) -> None:
        for a in range(0, len(self.queries.ids), TILE):
            own = self.queries[a : a + TILE]
            around, error = estimates(words, length, scalar, own)
            other = ids[None, :] != own.ids[:, None]
            # The k-th score, or else the k-th largest lower bound, of what there is to choose from.
            bar = np.where(self.held[a : a + TILE] < self.k, -np.inf, self.scores[a : a + TILE].min(axis=1))
            if len(ids) > self.k and np.isinf(bar).any():
                lower = np.where(other, around - error, -np.inf)
                bar = np.maximum(bar, np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            around += error
            near, about = other & (around >= bar[:, None]), np.abs(vectors).max() * np.finfo(float).eps * vectors.shape[1] * 4
            pairs = []
            for q in np.flatnonzero(near.any(axis=1)):
                # Products that are quick, but right only to the last bits, tell which are worth the sum in order.
                some, vector = np.flatnonzero(near[q]), own.vectors[q]
                quick, slack = vectors[some] @ vector, about * np.abs(vector).sum()
                least = self.scores[a + q].min() if self.held[a + q] == self.k else -np.inf
                if len(some) > self.k:
                    least = max(least, np.partition(quick, len(some) - self.k)[len(some) - self.k])
                some = some[quick >= least - 2 * slack]
                if len(some):
                    pairs.append((np.full(len(some), q), some))
            if pairs:
                query, candidate = (np.concatenate(x) for x in zip(*pairs, strict=True))
                self._merge(a, query, ids[candidate], products(vectors[candidate], own.vectors[query]))

    def _merge(self, a: int, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        some = np.unique(query)
        had, place = np.nonzero(np.arange(self.k) < self.held[a + some][:, None])
        query = np.concatenate((some[had], query))
        ids, scores = np.concatenate((self.ids[a + some[had], place], ids)), np.concatenate((self.scores[a + some[had], place], scores))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < self.k
        self.ids[a + query[best], rank[best]], self.scores[a + query[best], rank[best]] = ids[best], scores[best]
        self.held[a + some] = np.minimum(np.bincount(query, minlength=some[-1] + 1)[some], self.k)

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.queries.ids[query]), pa.array(self.ids[query, place]), pa.array(self.scores[query, place])], ["query_id", "vec_id", "score"])


def index(vectors: DataFrame) -> DataFrame:
    """vec_id, size, vector, words, length, scalar of every vector that takes part; nothing is fitted."""
    common.arrow_rows(vectors.sparkSession)
    fine = vectors.where("vec_id is not null").where(usable("embedding"))
    fine = fine.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.transform("embedding", lambda v: v.cast("double"))).alias("embedding"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            size = np.diff(lists.offsets.to_numpy())
            rows = np.split(lists.flatten().to_numpy(), np.cumsum(size)[:-1])
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                x = np.stack([rows[r] for r in own])
                words, length, scalar = codes(x)
                out = [batch["vec_id"].take(pa.array(own)), pa.array(np.full(len(own), n, np.int32)), pa.array([packed(v) for v in x], pa.binary()), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(length), pa.array(scalar)]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "size", "vector", "words", "length", "scalar"])

    return fine.mapInArrow(encode, "vec_id long, size int, vector binary, words binary, length double, scalar double")


def search(indexed: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each of ``queries`` (rows of the index) among all others."""
    indexed = common.written(indexed, "codes")
    asked = common.written(indexed.select("vec_id", "size", "vector").join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi"), "queries")
    total = asked.agg(F.sum(F.col("size") * 8 + 64)).first()[0] or 0
    chunks = max(1, -(-total // QUERY_BYTES))
    found = [_chunk(indexed, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == n), k) for n in range(chunks)]
    # Of each chunk at most k rows a query and task; a chunk's are written before the next one's queries are fetched.
    rows = functools.reduce(DataFrame.unionByName, (common.written(f, "found") if chunks > 1 else f for f in found))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _chunk(indexed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Each task's best of the queries of one chunk, whose vectors (about QUERY_BYTES) go to all tasks."""
    table = asked.toArrow()
    ids, sizes, raw = table["vec_id"].to_numpy(), table["size"].to_numpy(), table["vector"].to_pylist()
    held = {}
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        held[n] = ids[own], unpacked([raw[i] for i in own], n)
    shared = indexed.sparkSession.sparkContext.broadcast(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Nearest(prepared(*q), k) for n, q in shared.value.items()}
        for batch in batches:
            size = batch["size"].to_numpy()
            for n in np.unique(size).tolist():
                if n in best:
                    own = batch if (size == n).all() else batch.filter(pa.array(size == n))
                    words = np.frombuffer(b"".join(own["words"].to_pylist()), "<u8").reshape(len(own), -1)
                    best[n].meet(own["vec_id"].to_numpy(), unpacked(own["vector"].to_pylist(), n), words, own["length"].to_numpy(), own["scalar"].to_numpy())
        for b in best.values():
            yield b.rows()

    return indexed.mapInArrow(compare, "query_id long, vec_id long, score double")


def op7_bit_search(spark, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings")
    return search(index(vectors), vectors.where(F.col("vec_id") % EVERY == 0))


#: Brute force; the sum runs from the first component on, as in ``products``.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
