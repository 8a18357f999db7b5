"""Mixing sources to target weights by systematic sampling of whole documents.

Targets are a share of all words, dealt by weight and capped at a multiple of each source's own words, the excess going to the
others by weight. Within a source every document is expected to come as often as the target is the source's size.
These expectations are summed up along the source, in order of size, from one random offset, and a document is emitted once
per whole number its own part crosses. Copies of a document so never differ by more than one, and the words taken by the source
stray from its target by about one document, whatever the sizes. Order and offset come from hashes, so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words has target 0
and none of its documents are taken; repeated rows count row by row; an empty table gives none. Columns other than
doc_id, text and source are not read by ``mix`` and all kept by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm import common

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word there is, and most copies of a document.
SHARE, MOST = 1.5, 2.0
SEED = 20240517

SIZE = r"[^\x20\x09-\x0D]+"


def _number(of, digits: int):
    """The first hexadecimal digits of the MD5 hash, as a number."""
    return F.conv(F.substring(F.md5(of), 1, digits), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), a row per source.

    Resharing an excess by weight until none is above its cap fills all sources to one level per weight, or to
    their caps: with sources in order of cap per weight, the level is what is left after the lower caps, by the weight left.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    # One row per source: the sources of a mix are few, as each has a weight.
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - below) / left)
    # The first source that the level leaves under its cap ends the filling.
    rows = rows.withColumn("place", F.row_number().over(up))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    rows = rows.withColumn("fill", level["level"])
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("fill") * F.col("w"), "cap")).alias("target"))


def _narrow(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, h (hash of id and text, which orders texts of one size), and more columns as they are."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SIZE)).cast("long")
    said = F.concat(F.when(F.col("text").isNull(), "n").otherwise(F.concat(F.lit("t"), "text")), F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("doc_id", "source", size.alias("size"), _number(said, 15).alias("h"), *more)


def _drawn(narrow: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """The narrow table with source_size, target and copies."""
    # Sorted by size, neighbours are alike, so which of them the whole numbers hit hardly matters to the words taken.
    order = ["size", "h", "doc_id", *narrow.columns[4:]]
    placed = common.prefix_sums(narrow.withColumn("one", F.lit(1).cast("long")), order, "one", "before", group="source")
    placed = common.written(placed.drop("one"), "placed")
    # Between 0 and 1, and the same for a source in every run; of 16 bits, so that sums with whole numbers stay exact.
    offset = _number(F.concat(F.lit(f"{seed} "), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), 4) / F.lit(float(1 << 16))
    # A row per source. As a written table its size is known, so Spark broadcasts it only while it is small.
    sizes = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("offset", offset)
    sizes = common.written(sizes, "targets")
    joined = placed.alias("d").join(sizes.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.offset")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(F.col("offset") + (F.col("before") + 1) * rate) - F.floor(F.col("offset") + F.col("before") * rate)
    return joined.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (size times copies)."""
    drawn = _drawn(common.written(_narrow(docs), "sizes"), weights, share, most, seed)
    return drawn.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """All columns of the documents taken, a row for each time one is taken.

    Rows are written with a number of their own and joined by it, so that no number of equal rows, or of null ids, meets in one task.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"), F.monotonically_increasing_id().alias("row"))
    whole = common.written(whole, "numbered")
    narrow = common.written(_narrow(whole.select("all.doc_id", "all.source", "all.text", "row"), "row"), "sizes")
    drawn = _drawn(narrow, weights, share, most, seed).where("copies > 0").select("row", F.array_repeat(F.lit(1), F.col("copies").cast("int")).alias("times"))
    return whole.join(drawn, "row").select("all", F.explode("times")).select("all.*")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Fixed values of the query: weights 5, 2, 1, 150 %, twice, and the seed.
OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SIZE}')) AS BIGINT) AS size,
    CAST('0x' || md5(CASE WHEN text IS NULL THEN 'n' ELSE 't' || text END || ' ' || coalesce(CAST(doc_id AS VARCHAR), ''))[:15] AS BIGINT) AS h FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) - 1 AS before FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM s),
c AS (
  SELECT *, sum(n) OVER () * 1.5 - coalesce(sum(n * 2.0) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER up AS place
  FROM w WINDOW up AS (ORDER BY n * 2.0 / w, source NULLS LAST)),
f AS (SELECT arg_min(rest / weights, place) AS level FROM c WHERE rest / weights * w <= n * 2.0),
t AS (
  SELECT source, n, least(n * 2.0, coalesce(level * w, n * 2.0)) AS target,
    CAST('0x' || md5('{SEED} ' || coalesce('s' || source, 'n'))[:4] AS BIGINT) / 65536.0::DOUBLE AS o FROM c, f)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
  CAST(size * (CASE WHEN n > 0 THEN floor(o + (before + 1) * (target / n)) - floor(o + before * (target / n)) ELSE 0 END) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
