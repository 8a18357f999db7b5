"""Near-duplicate vectors by a forest of random-projection trees with spill.

Each tree splits the vectors in two again and again along random directions at medians; a vector near a split goes to both sides.
Vectors that meet in a leaf of any tree are compared by cosine in double precision. A pair that meets in several leaves is counted
in the first of them, so links are counted exactly without a list of pairs; what leaves a task is each vector's number of
links and enough of the links to connect what is connected.

Trees are fitted to a bounded sample (``SAMPLE_BYTES`` of the vectors of the lowest hash); every vector is dealt and compared. A node is
split until the sample says that a leaf holds about ``LEAF`` vectors, or that no direction parts it (vectors all near each other). Equal vectors
are compared once and counted as often as they occur. Large leaves are compared block by block over many tasks.

Recall: two vectors at a cosine of 0.95 part at a split with a chance of about 0.033, closer ones more rarely. The number of trees follows
from the depth, so that of ten thousand pairs at the threshold itself one meets in no leaf. A vector's places therefore grow slowly with the
table, about as its 0.16th power; tests measure both.

Defined cases: null and zero vectors, and those with null or non-finite components, link with nothing and are kept; vectors of
different lengths link with nothing; repeated rows of one vec_id are vectors of their own that share its row; rows with a null vec_id
are left out; an empty table gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.llm import common

THRESHOLD = 0.95
#: Vectors that a leaf is meant to hold: as many comparisons as cost about what sending a vector does.
LEAF = 768
#: Distance from a split, in lengths of a unit vector times 1/sqrt(dimension), within which a vector goes to both sides.
SPILL = 0.12
#: Shares of vectors that go to both sides, and chance that a split parts two at a cosine of 0.95.
BOTH, PARTS = 0.096, 0.033
#: Chance that two at the threshold meet in no tree.
MISSED = 1e-4
#: Bytes (of 8 a component) of the vectors that trees are fitted to, and least of them in a node that is split.
SAMPLE_BYTES, LEAST = 32 << 20, 16
#: Random directions of a tree; each node uses one.
DIRECTIONS = 64
#: Vectors of a leaf that are compared with as many others in one task.
BLOCK = 1024


def usable(column: str) -> Column:
    """The vector takes part: it is there, not zero, and all its components are finite numbers."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@functools.cache
def _directions(tree: int, dimension: int) -> np.ndarray:
    d = np.random.default_rng([tree, 77]).standard_normal((dimension, DIRECTIONS))
    return d / np.sqrt((d * d).sum(0))


def trees_for(count: int, leaf: int) -> int:
    """Trees for so many vectors: what a pair's chance to stay together down one tree asks for."""
    depth = max(0.0, math.log(max(1, count) / leaf) / math.log(2 / (1 + BOTH)))
    together = (1 - PARTS) ** depth
    return 1 if together > 1 - 1e-9 else max(2, math.ceil(math.log(MISSED) / math.log(1 - together)))


@dataclasses.dataclass
class Tree:
    """Nodes in rows: the direction and value they split at, and the lower of their two children, which follow each other; 0 for a leaf."""

    along: np.ndarray
    split: np.ndarray
    child: np.ndarray


@dataclasses.dataclass
class Forest:
    dimension: int
    trees: list[Tree]

    @functools.cached_property
    def first(self) -> np.ndarray:
        """Number of each tree's first node among all trees' nodes."""
        return np.concatenate(([0], np.cumsum([len(t.child) for t in self.trees])))

    def leaves(self, vectors: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of each place, its leaf): a row has one place for each leaf it is in."""
        own = self.trees[tree]
        projected = vectors @ _directions(tree, self.dimension)
        rows, nodes, margin = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), SPILL / math.sqrt(self.dimension)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            child = own.child[nodes]
            at_end = child == 0
            done.append((rows[at_end], nodes[at_end]))
            rows, nodes, child = rows[~at_end], nodes[~at_end], child[~at_end]
            off = projected[rows, own.along[nodes]] - own.split[nodes]
            low, high = off < margin, off >= -margin
            rows, nodes = np.concatenate((rows[low], rows[high])), np.concatenate((child[low], child[high] + 1))
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done]) + self.first[tree]

    def places(self, vectors: np.ndarray, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same over all trees, or over those up to the one that has the leaf ``before``."""
        trees = len(self.trees) if before is None else int(np.searchsorted(self.first, before, "right"))
        found = [self.leaves(vectors, tree) for tree in range(trees)]
        return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])


def grow(sample: np.ndarray, count: int, leaf: int | None = None) -> Forest:
    """Trees for ``count`` vectors of which this is a sample: nodes split at the sample's medians until ``leaf`` is reached."""
    leaf = leaf or LEAF
    dimension, share = sample.shape[1], max(1, count) / max(1, len(sample))
    margin, trees = SPILL / math.sqrt(max(1, dimension)), []
    for tree in range(trees_for(count, leaf)):
        projected = (sample @ _directions(tree, dimension)).astype(np.float32)
        rng = np.random.default_rng([tree, 78])
        along, split, child, members = [0], [0.0], [0], [np.arange(len(sample))]
        node = 0
        while node < len(child):
            own, members[node] = members[node], None
            if len(own) * share > leaf and len(own) >= LEAST:
                # Of a few random directions the first that parts the node: near-equal vectors would all go to both sides.
                for direction in rng.integers(0, DIRECTIONS, 4).tolist():
                    values = projected[own, direction]
                    middle = float(np.median(values))
                    low, high = own[values < middle + margin], own[values >= middle - margin]
                    if len(low) + len(high) <= 1.4 * len(own):
                        along[node], split[node], child[node] = direction, middle, len(child)
                        along += [0, 0]
                        split += [0.0, 0.0]
                        child += [0, 0]
                        members += [low, high]
                        break
            node += 1
        trees.append(Tree(np.array(along), np.array(split), np.array(child)))
    return Forest(dimension, trees)


def packed(vector: np.ndarray) -> bytes:
    """Four bytes a component where that is exact, else eight."""
    small = vector.astype("<f4")
    return small.tobytes() if (small == vector).all() else vector.astype("<f8").tobytes()


def unpacked(raw: list[bytes], size: int, padded: int | None = None) -> np.ndarray:
    """Rows of doubles, filled up with zeros to ``padded`` components."""
    out = np.zeros((len(raw), padded or size))
    for k, r in enumerate(raw):
        out[k, :size] = np.frombuffer(r, "<f4" if len(r) == 4 * size else "<f8")
    return out


def _labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id that each row of a symmetric matrix reaches."""
    far = np.iinfo(np.int64).max
    now = ids.copy()
    while True:
        least = np.minimum(now, np.where(linked, now[None, :], far).min(axis=1, initial=far))
        if (least == now).all():
            return now
        now = least


def compared(table: pa.Table, forest: Forest, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, links counted here, least vector it reaches here) of a block: one leaf's part with itself or with another."""
    leaf, size, i, j = (table[c][0].as_py() for c in ("leaf", "size", "i", "j"))
    ids, weight, part = (table[c].to_numpy() for c in ("rep", "n", "part"))
    vectors = unit(unpacked(table["vector"].to_pylist(), size, forest.dimension))
    linked = vectors @ vectors.T >= threshold
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= part[:, None] != part[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return ids[:0], ids[:0], ids[:0]
    linked, ids, weight = linked[np.ix_(some, some)], ids[some], weight[some]
    rows, places = forest.places(vectors[some], leaf)
    before = places < leaf
    known, column = np.unique(places[before], return_inverse=True)
    member = np.zeros((len(some), max(1, len(known))), np.float32)
    member[rows[before], column] = 1
    first = linked & (member @ member.T == 0)  # in no earlier leaf together
    return ids, first @ weight, _labels(linked, ids)


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    common.arrow_rows(spark)
    named = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # Adding 0 makes -0.0 and 0.0 equal.
    fine = named.where(usable("embedding")).select("vec_id", F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("embedding"))
    # A vector's two hashes stand for it where only its class is asked for: its rows may be many and are joined as two numbers.
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    # Equal vectors are one from here on.
    classes = common.written(fine.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    count, dimension = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if count:
        found = _links(classes, count, dimension, threshold)
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        parts = common.components(found.where("least <> rep").select(F.col("rep").alias("a"), F.col("least").alias("b")))
        of_class = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        of_class = of_class.select(*hashes, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        linked = fine.select("vec_id", *hashes).join(of_class, ["h1", "h2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    else:
        linked = spark.createDataFrame([], "vec_id long, n_links long, component_id long")
    out = named.select("vec_id").distinct().join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(classes: DataFrame, count: int, dimension: int, threshold: float) -> DataFrame:
    """A written table of (rep, links, least): what each block says of the vectors that have links there."""
    rows = max(1, SAMPLE_BYTES // (8 * max(1, dimension)))
    chosen = classes.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("embedding").toArrow()["embedding"].combine_chunks()
    size = np.diff(chosen.offsets.to_numpy())
    sample = np.zeros((len(chosen), dimension))
    sample[np.arange(dimension)[None, :] < size[:, None]] = chosen.flatten().to_numpy()
    forest = classes.sparkSession.sparkContext.broadcast(grow(unit(sample), count))

    def route(payload: bool):
        names = ["leaf", "size"] + ["rep", "n", "vector"] * payload

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch["embedding"]
                size = np.diff(lists.offsets.to_numpy())
                raw = [packed(v) for v in np.split(lists.flatten().to_numpy(), np.cumsum(size)[:-1])]
                x = np.zeros((len(raw), dimension))
                x[np.arange(dimension)[None, :] < size[:, None]] = lists.flatten().to_numpy()
                rows, leaves = forest.value.places(unit(x))
                for a in range(0, len(rows), 16384):
                    r = rows[a : a + 16384]
                    out = [pa.array(leaves[a : a + 16384]), pa.array(size[r], pa.int32())]
                    if payload:
                        out += [batch["rep"].take(pa.array(r)), batch["n"].take(pa.array(r)), pa.array([raw[k] for k in r], pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, names)

        return classes.mapInArrow(dealt, ", ".join(f"{n} {t}" for n, t in (("leaf", "long"), ("size", "int"), ("rep", "long"), ("n", "long"), ("vector", "binary")) if n in names))

    large = route(False).groupBy("leaf", "size").count().where(F.col("count") > BLOCK)
    large = common.written(large.select("leaf", "size", F.ceil(F.col("count") / BLOCK).alias("parts")), "leaves")
    rows = route(True).join(large, ["leaf", "size"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep", "vector"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("leaf", "size", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "n", "vector")

    def compare(table: pa.Table) -> pa.Table:
        return pa.table(list(compared(table.combine_chunks(), forest.value, threshold)), ["rep", "links", "least"])

    return common.written(rows.groupBy("leaf", "size", "i", "j").applyInArrow(compare, "rep long, links long, least long"), "links")


def op3_vector_dups(spark, sf_dir: str) -> DataFrame:
    return link_vectors(common.read(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (
  SELECT DISTINCT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT COUNT(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
