"""Text quality by naive Bayes support vectors.

A text is the set of its hashed n-grams: single words, pairs of words, and runs of up to three word shapes, where a
shape says how a word is cased, what marks it holds and whether it repeats the word before. Indicators are scaled by
the log ratio of their smoothed class frequencies; a linear hinge-loss model is fitted to the scaled indicators by dual
coordinate descent; a logistic curve, fitted to margins of texts held back, turns margins into scores.

Fitting takes a bounded sample of labelled rows (``MAX_ROWS`` rows of the lowest hash, and of those as many as stay within
``MAX_ENTRIES`` indicators); every text is scored, whole.

Defined cases: null and empty texts are the empty set and get the score of the model's bias; labels that are null, or whose
document is missing, are not used; of several labels of a document the least counts; with one class only, or no labels,
every score is the share of label 1 (0.5 without labels). Columns beside those named are carried along or not read.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspan.llm import common, shingles, tok

BUCKETS = 1 << 18
MAX_ROWS = 4000
MAX_ENTRIES = 3_000_000
#: Rejected below this score.
ACCEPT = 0.3

_SEEDS = shingles.mixed(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shapes(data: np.ndarray, raw_starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small number for each word: which kinds of characters it holds, and its last byte if that is a mark."""
    kinds = np.zeros(256, np.uint16)
    kinds[0x61:0x7B] = 1
    kinds[0x41:0x5B] = 2
    kinds[0x30:0x3A] = 4
    kinds[0x80:] = 8
    for k, c in enumerate(b".,:;!?|#$%&*"):
        kinds[c] = 16 << k
    kinds[[c for c in range(0x21, 0x7F) if not kinds[c]]] = 16 << 11
    got = np.bitwise_or.reduceat(kinds[data], raw_starts) if len(raw_starts) else kinds[:0]
    capital = (data[raw_starts] >= 0x41) & (data[raw_starts] < 0x5B)
    length = np.minimum(ends - raw_starts, 31) // 8
    return got.astype(np.uint64) | capital.astype(np.uint64) << np.uint64(16) | length.astype(np.uint64) << np.uint64(17)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, distinct hashed n-grams of each text)."""
    data, _, starts, ends = places = shingles.word_places(texts)
    first, words = shingles.word_hashes(texts, False, places)
    n = len(words)
    if not n:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    # Blanks after a word have no kind, so the run up to the next word's start has the word's kinds.
    shape = _shapes(data, starts, ends)
    # At a text's first words, what stands before them is nothing.
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    word_before = np.concatenate((words[:1], words[:-1]))
    same = (words == word_before) & (place > 0)
    shape = shape | same.astype(np.uint64) << np.uint64(20)
    shape_before = np.where(place > 0, np.concatenate((shape[:1], shape[:-1])), np.uint64(1) << np.uint64(40))
    shape_before2 = np.where(place > 1, np.concatenate((shape_before[:1], shape_before[:-1])), np.uint64(1) << np.uint64(41))
    grams = (
        words ^ _SEEDS[0],
        shingles.mixed(np.where(place > 0, word_before, np.uint64(0)) * np.uint64(3) + words) ^ _SEEDS[1],
        shape ^ _SEEDS[2],
        (shape_before << np.uint64(21)) + shape ^ _SEEDS[3],
        shingles.mixed((shape_before2 << np.uint64(21)) + shape_before) + shape ^ _SEEDS[4],
    )
    all_ = np.stack([(shingles.mixed(g) >> np.uint64(46)).astype(np.int64) for g in grams], axis=1)
    stamp, parts = np.empty(BUCKETS, np.int64), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = all_[a:b].ravel()
        stamp[own] = at = np.arange(len(own))
        parts.append(own[stamp[own] == at])
    return np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.concatenate(parts)


@dataclasses.dataclass
class Model:
    """Margins are of indicators scaled and brought to unit length."""

    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, bounds: np.ndarray, found: np.ndarray) -> np.ndarray:
        out = np.full(len(bounds) - 1, self.bias)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            # Sums over a text's own entries, so that its score does not depend on its neighbours.
            up, square = (np.add.reduceat(x[found], bounds[:-1][full]) for x in (self.weights * self.scale, self.scale**2))
            out[full] += up / np.sqrt(np.where(square > 0, square, 1))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(texts)) + self.shift, -30, 30)))


def _dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss: one dual variable at a time in random order, each held to [0, cost]; rows have unit length."""
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norms = [float(np.sqrt((scale[r] ** 2).sum())) for r in rows]
    square = [2.0 if n else 1.0 for n in norms]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = scale[r] / (norms[i] or 1.0)
            slope = y[i] * (float(w[r] @ v) + b) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, towards smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * theta)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0], np.cumsum([len(r) for r in rows]))), np.concatenate([*rows, np.zeros(0, np.int32)])


def fit(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray, cost: float = 1.0, smooth: float = 1.0) -> Model:
    """``rows``: each text's distinct n-grams; the ``held`` ones only serve for the logistic curve."""
    share = float(labels.mean()) if len(labels) else 0.5
    if min(labels.sum(), (1 - labels).sum()) < 1:
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if any(len(set(labels[x])) < 2 for x in (held, ~held)):
        held = np.zeros(len(rows), bool)
    learned, y = [r for r, h in zip(rows, held, strict=True) if not h], labels[~held]
    counts = [np.bincount(_joined([r for r, k in zip(learned, y, strict=True) if k == c])[1], minlength=BUCKETS) + smooth for c in (1, 0)]
    scale = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    # Both classes weigh alike in the loss.
    costs = cost * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    weights, bias = _dual_descent(learned, scale, 2 * y - 1, costs)
    model = Model(weights, scale, bias)
    curve = held if held.any() else ~held
    margins = model.margins(*_joined([r for r, h in zip(rows, curve, strict=True) if h]))
    model.slope, model.shift = _logistic(margins, labels[curve])
    return model


def in_test(doc_id: int | None) -> bool:
    """Held out: crc32 of the doc_id as text, modulo 5, is 0."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES) -> Model:
    """A model of ``labels`` (doc_id, 0 or 1 in ``column``) that are not held out."""
    common.arrow_rows(docs.sparkSession)
    usable = labels.where(f"doc_id is not null and {column} in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    usable = usable.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    # At most max_rows rows of 12 bytes.
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, m in tok.in_parts(batch["text"]):
                bounds, grams = features(batch["text"].slice(a, m))
                raw = [grams[x:y].astype("<i4").tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, m), batch["label"].slice(a, m), pa.array(raw, pa.binary())], ["doc_id", "label", "grams"])
        common.rest()

    rows = common.texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(found, "doc_id long, label int, grams binary")
    # A repeated doc_id counts once.
    rows = common.written(rows.groupBy("doc_id", "label").agg(F.min("grams").alias("grams")), "training")
    sizes = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), (F.length("grams") / 4).cast("long").alias("n"))
    before = F.sum("n").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    within = sizes.select("doc_id", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < max_entries).select("doc_id")
    kept = rows.join(F.broadcast(within), "doc_id").collect()  # at most max_rows rows and about max_entries entries of 4 bytes
    kept.sort(key=lambda r: r.doc_id)
    common.drop_written(rows)
    grams = [np.frombuffer(r.grams, "<i4") for r in kept]
    held = np.array([zlib.crc32(f"curve {r.doc_id}".encode()) % 4 == 0 for r in kept], bool)
    return fit(grams, np.array([r.label for r in kept], np.int64), held)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, and the score of ``text`` (a column of that name is replaced)."""
    common.arrow_rows(docs.sparkSession)
    names = [c for c in docs.columns if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.scores(batch["text"].slice(a, m)) for a, m in tok.in_parts(batch["text"], 2_000_000)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(np.concatenate([*values, np.zeros(0)]))], [*names, column])
        common.rest()

    docs = docs.select(*names)
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.texts(common.read(spark, sf_dir, "documents"))
    out = scored(docs, train(docs, common.read(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
