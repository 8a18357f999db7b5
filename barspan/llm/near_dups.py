"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, whole shingle sets decide.

Each text's set of five-word shingles gets MinHash samples. Bands of samples put documents into buckets. The
samples also fold into a parity bitmap (an odd sketch): the population count of two sketches' XOR estimates
their similarity, closely when it is high, and drops pairs that are far off. Pairs that remain are confirmed on the
whole sets, as 64-bit hashes.

Texts with equal sets are one class and are compared once. Within a bucket, members are first compared with one
centre, then with a second one chosen for each bucket, and what is still apart is compared outside the bucket's largest part.
So a group of copies costs in proportion to its size, and no two texts that share a bucket stay unlinked unless compared.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are kept; a text of one to four words is
one shingle; repeated rows of one doc_id are one document if their sets are equal, else each set links on its own and the
document's row takes the least component; rows with a null doc_id are left out; an empty table gives no rows; very long texts are compared
whole, in blocks of fewer members. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm import common, shingles, tok

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: At a similarity of 0.75 a pair shares no bucket with a chance of 2e-5; chains of links make up for most of that.
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Pairs estimated below this go unconfirmed. The estimate's standard error at 0.75 is about 0.036.
ESTIMATE = 0.58
#: Members confirmed in one task together with their centre.
BLOCK = 64
#: Shares that a bucket's members are dealt into where they are joined to what is known of the bucket; a bit each of a long.
SALTS = 64
#: Members of a bucket that meet in one task: outside its largest part, and of all.
CROSS = 256, 512
#: Shingles, and so bytes of text, that a task holds of one side: blocks of long texts have fewer members.
SHINGLES = 1 << 20
#: Links (16 bytes each) whose components one task finds; beyond, they are found in rounds over all tasks.
LINKS = 1 << 18


@functools.cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, SAMPLES, np.uint32)


def samples(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """MinHash samples (runs x SAMPLES) of runs of hashes, none of them empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    low *= np.uint32(0x85EBCA6B)
    low ^= low >> np.uint32(15)
    out = np.empty((len(bounds) - 1, SAMPLES), np.uint32)
    for k, (a, b) in enumerate(zip(*_family(), strict=True)):
        out[:, k] = np.minimum.reduceat((low ^ b) * a, bounds[:-1])
    return out


def sketch(minima: np.ndarray) -> np.ndarray:
    """Odd sketches (runs x SKETCH_BITS / 64): each sample, with its number, flips one bit."""
    bit = shingles.mixed(minima.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flips = np.zeros((len(minima), SKETCH_BITS), np.uint8)
    np.add.at(flips, (np.arange(len(minima))[:, None], bit.astype(np.int64)), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view("<i8")


def least_flips(similarity: float) -> int:
    """Most differing bits at which the estimate is still this similarity."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


SIGNED = "doc_id long, n_shingles long, same long, same2 long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Per document: its number of shingles, two hashes of its set, band keys and odd sketch (null without shingles)."""
    common.arrow_rows(docs.sparkSession)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            for a, m in tok.in_parts(batch["text"], 2_000_000):
                bounds, hashes = shingles.distinct_in_runs(*shingles.shingle_hashes(batch["text"].slice(a, m), WORDS))
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                kept = np.concatenate((bounds[:-1][full], bounds[-1:]))
                n = len(full)
                out = [np.zeros(m, np.int64) for _ in range(2)]
                if n:
                    minima = samples(kept, hashes)
                    key = np.zeros((n, BANDS), np.uint64)
                    for r in range(ROWS):
                        key = shingles.mixed(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS] + number)
                    out[0][full] = np.add.reduceat(hashes, kept[:-1]).view(np.int64)
                    out[1][full] = np.bitwise_xor.reduceat(shingles.mixed(hashes), kept[:-1]).view(np.int64)
                    bands, bits = key.view(np.int64).ravel(), sketch(minima).ravel()
                else:
                    bands = bits = np.zeros(0, np.int64)
                none = pa.array(sizes == 0)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(sizes > 0, w, 0)))), pa.int32()), pa.array(v), mask=none) for w, v in ((BANDS, bands), (SKETCH_BITS // 64, bits))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, m), pa.array(sizes), *map(pa.array, out), *lists], ["doc_id", "n_shingles", "same", "same2", "bands", "sketch"])
        common.rest()

    return common.texts(docs).where("doc_id is not null").mapInArrow(signed, SIGNED)


def _near(x: str, y: str):
    """The two sketches may belong to linked texts."""
    flips = functools.reduce(lambda p, q: p + q, [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(SKETCH_BITS // 64)])
    return flips <= F.lit(least_flips(ESTIMATE))


def _salts():
    """Of a group of members: the shares that have any, as bits."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def _salt(member: str):
    """The share that a member is in."""
    return F.pmod(F.xxhash64(member, F.lit(3)), F.lit(SALTS)).cast("int").alias("salt")


def _of_bucket(members: DataFrame, buckets: DataFrame, key: str = "key") -> DataFrame:
    """Members with the columns of their bucket's (or centre's) row, which goes once to each share: no task gets a large one whole."""
    shares = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1) = 1)"))
    return members.join(buckets.withColumn("salt", shares).drop("salts"), [key, "salt"])


def _blocks(members, shingles_, most: int):
    """Into how many blocks so many members with so many shingles go."""
    return F.greatest(F.ceil(members / most), F.ceil(shingles_ / SHINGLES))


def met(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of centres and members, each once: a, b, b's number of shingles n and sketch sb, its share."""
    pairs = pairs.where("a <> b").groupBy("b").agg(F.collect_set("a").alias("centres"))  # at most BANDS
    pairs = pairs.join(reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n"), F.col("sketch").alias("sb")), "b")
    return pairs.select(F.explode("centres").alias("a"), "b", "n", "sb", _salt("b"))


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs that ``met`` (a table) those (a, b) whose sketches, and then whole shingle sets, are similar enough.

    A text goes once to each block of at most about BLOCK partners of one centre, fewer if they are long, and to those where it is a
    partner. Blocks are counted before sketches are compared, so that a centre's sketch and its number of blocks travel together.
    """
    common.arrow_rows(docs.sparkSession)
    held = pairs.groupBy("a").agg(_blocks(F.count("*"), F.sum("n"), BLOCK).alias("blocks"), _salts())
    held = held.join(reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a")
    near = _of_bucket(pairs.drop("n"), held, "a").where(_near("sa", "sb")).select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b")
    dealt = near.groupBy("a", "block").agg(F.collect_set("b").alias("partners"))
    rows = dealt.select("a", "block", F.explode(F.concat(F.array("a"), "partners")).alias("doc_id")).withColumn("centre", F.col("doc_id") == F.col("a"))
    rows = rows.join(docs.select("doc_id", "text"), "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bounds, hashes = shingles.distinct_in_runs(*shingles.shingle_hashes(table["text"].combine_chunks(), WORDS))
        sets = [hashes[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        centre, ids = table["centre"].to_pylist(), table["doc_id"].to_pylist()
        whole = {s.tobytes(): s for s, c in zip(sets, centre, strict=True) if c}
        out = []
        for one in whole.values():
            for other, c, doc in zip(sets, centre, ids, strict=True):
                if not c:
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(one) + len(other) - both):
                        out.append(doc)
        return pa.table({"a": pa.array([table["a"][0].as_py()] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return rows.groupBy("a", "block").applyInArrow(compare, "a long, b long")


def sided(members: DataFrame) -> DataFrame:
    """Members (key, salt, doc_id, part, n_shingles) of the buckets in several parts: whether each is in its bucket's largest, and the bucket's blocks."""
    sizes = members.groupBy("key", "part").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("n"), _salts()).groupBy("key")
    sizes = sizes.agg(F.max(F.struct("count", "part", "n")).alias("main"), F.sum("count").alias("all"), F.sum("n").alias("n"), F.bit_or("salts").alias("salts"))
    sizes = sizes.select("key", "salts", "all", "n", F.col("main.part").alias("main"), F.col("main.count").alias("largest"), F.col("main.n").alias("largest_n")).where(F.col("largest") < F.col("all"))
    parts = [_blocks(F.col("all") - F.col("largest"), F.col("n") - F.col("largest_n"), CROSS[0]), _blocks(F.col("all"), F.col("n"), CROSS[1])]
    known = sizes.select("key", "salts", "main", *(p.alias(n) for p, n in zip(parts, ("rows", "columns"), strict=True)))
    return _of_bucket(members, known).select("key", "doc_id", "part", (F.col("part") == F.col("main")).alias("in_main"), "rows", "columns")


def across(members: DataFrame, docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) between different parts of a bucket, from members as ``sided`` has them.

    Members outside the bucket's largest part meet all its members, in blocks of bounded size that compare
    sketches and then whole sets and only emit links. A pair is compared in the first bucket that both are in.
    """
    one, each = F.pmod(F.xxhash64("doc_id", F.lit(1)), "rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j")
    small = members.where("not in_main").select("key", "doc_id", "part", "in_main", F.lit(True).alias("left"), one, each)
    one, each = F.pmod(F.xxhash64("doc_id", F.lit(2)), "columns").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i")
    whole = members.select("key", "doc_id", "part", "in_main", F.lit(False).alias("left"), each, one)
    held = members.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # at most BANDS
    held = held.join(sketches, "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = small.unionByName(whole).join(held, "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        left = table["left"].to_numpy()
        key = table["key"][0].as_py()
        bounds, hashes = shingles.distinct_in_runs(*shingles.shingle_hashes(table["text"].combine_chunks(), WORDS))
        sizes = np.diff(bounds)
        bits = np.array(table["sketch"].to_pylist(), np.int64)
        part, doc, main = (table[c].to_numpy() for c in ("part", "doc_id", "in_main"))
        # Buckets before this one, as columns: their product counts the earlier buckets that two members share.
        lists = table["keys"].to_pylist()
        number = {k: n for n, k in enumerate({k for ks in lists for k in ks if k < key})}
        earlier = np.zeros((len(lists), max(1, len(number))), np.float32)
        for n, ks in enumerate(lists):
            earlier[n, [number[k] for k in ks if k in number]] = 1
        rows, columns = np.flatnonzero(left & (sizes > 0)), np.flatnonzero(~left & (sizes > 0))  # a doc_id may also come without words
        out = []
        for r in rows:
            flips = np.bitwise_count((bits[r] ^ bits[columns]).view(np.uint64)).sum(1)
            near = (flips <= least_flips(ESTIMATE)) & (part[r] != part[columns]) & (main[columns] | (doc[r] < doc[columns])) & (earlier[columns] @ earlier[r] == 0)
            near = columns[near]
            if len(near):
                one = hashes[bounds[r] : bounds[r + 1]]
                others = np.concatenate([hashes[bounds[c] : bounds[c + 1]] for c in near])
                hit = one[np.minimum(np.searchsorted(one, others), len(one) - 1)] == others
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
                out += [(doc[r], doc[c]) for c in near[100 * both >= PERCENT * (len(one) + sizes[near] - both)]]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (it is its component's least)."""
    since = common.tables_written()
    signed = common.written(signatures(docs), "signatures")
    sets = signed.where("n_shingles > 0")
    # Of the rows of one doc_id and set any will do: they are equal.
    first = F.min_by(F.struct("n_shingles", "bands", "sketch"), "doc_id").alias("row")
    reps = common.written(sets.groupBy("same", "same2").agg(F.min("doc_id").alias("doc_id"), first).select("doc_id", "same", "same2", "row.*"), "classes")
    keys = reps.select("doc_id", "n_shingles", _salt("doc_id"), F.explode("bands").alias("key"))
    # Only members of buckets that hold more than one class go on.
    crowd = keys.groupBy("key").agg(F.count("*").alias("size"), _salts()).where("size > 1")
    shared = common.written(_of_bucket(keys, crowd), "buckets")
    # The member that shares the most places is the centre of its buckets: the text that others are copies of, if it is there.
    company = F.sum("size").over(Window.partitionBy("doc_id"))  # at most BANDS rows
    ranked = shared.withColumn("company", company).groupBy("key").agg(F.max_by("doc_id", F.struct("company", -F.col("doc_id"))).alias("a"), _salts())
    # Whole texts cross the network once, and only those that have company in a bucket are kept for comparing.
    # Rows that repeat a doc_id with its text count once, else they would multiply wherever they meet.
    rows = common.texts(docs).join(shared.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
    docs = common.written(rows.groupBy("doc_id", "h").agg(F.first("text").alias("text")).drop("h"), "candidates")

    def now(parts: DataFrame) -> DataFrame:
        """Members of the buckets of three or more, with their components so far. Both members of a bucket of two have been compared."""
        found = shared.where("size > 2").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return found.select("key", "salt", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("part"))

    def joined(parts: DataFrame, found: DataFrame) -> DataFrame:
        return common.components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(found), at_once=LINKS)

    # First one centre for each bucket; buckets of one group mostly have the same, and ask for the same pairs.
    pairs = common.written(met(_of_bucket(shared, ranked).select("a", F.col("doc_id").alias("b")), reps), "pairs")
    parts = common.components(common.written(confirmed(pairs, reps, docs), "links"), at_once=LINKS)
    # Then a centre of its own for each bucket that is still in parts.
    members, own = now(parts), F.min_by(F.struct("doc_id", "part"), F.xxhash64("doc_id", "key")).alias("c")
    centre = members.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), own, _salts()).where("p < q").drop("p", "q")
    pairs = _of_bucket(members, centre).where("part <> c.part").select(F.col("c.doc_id").alias("a"), F.col("doc_id").alias("b"))
    pairs = common.written(met(pairs, reps), "pairs")
    if not pairs.isEmpty():
        found = common.written(confirmed(pairs, reps, docs), "links")
        if not found.isEmpty():
            parts = joined(parts, found)
        # Then all that is still apart, outside each bucket's largest part, against all other parts.
        members = common.written(sided(now(parts)), "open")
        if not members.isEmpty():
            found = common.written(across(members, docs, reps.select("doc_id", "sketch")), "links")
            if not found.isEmpty():
                parts = joined(parts, found)
    # Classes take their components, rows those of their classes; of a doc_id's rows the least counts.
    classes = reps.select("same", "same2", F.col("doc_id").alias("node")).join(parts, "node", "left").select("same", "same2", F.coalesce("component", "node").alias("component"))
    rows = sets.select("doc_id", "n_shingles", "same", "same2").join(classes, ["same", "same2"]).select("doc_id", "n_shingles", "component")
    rows = rows.unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    out = rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component_id"))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    # Three numbers a document: with them written, sketches, buckets and candidate texts can go.
    return common.written_alone(out, "classified", since).withColumn("kept", F.col("component_id") == F.col("doc_id"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS g FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
