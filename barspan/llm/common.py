"""What the operators share: shared-folder tables, global prefix sums, connected components."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspan import tables

#: Arrow batches between JVM and Python end at so many rows or bytes: documents and files can be long.
ARROW_ROWS, ARROW_BYTES = 4000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as a 64-bit number, and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_THREAD = threading.local()


def _folders() -> list[str]:
    """Folders of the tables that this thread has written, oldest first."""
    return _THREAD.__dict__.setdefault("folders", [])


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here and no executor's loss can undo it."""
    path = tables.new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    _folders().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a ``written`` table that nothing reads any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        tables.delete(df.sparkSession, folder)


def written_alone(df: DataFrame, name: str, since: int) -> DataFrame:
    """``written``, and then all tables that this thread wrote after its first ``since`` go: they only led to this one."""
    out, folders = written(df, name), _folders()
    for folder in folders[since:-1]:
        tables.delete(df.sparkSession, folder)
    del folders[since:-1]
    return out


def tables_written() -> int:
    return len(_folders())


def arrow_rows(spark: SparkSession) -> None:
    """Bound the memory of each Arrow batch, unless the session bounds it more closely."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**31 - 1), "2147483647b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def export(files: DataFrame, folder: str, number: str, suffix: str) -> DataFrame:
    """Write each row's ``file`` under ``folder`` (a URI that all executors reach) as its own file; path and size of each.

    Names come from ``number``, and a file gets its name once it is whole, so a task that runs again leaves the same files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            paths = [f"{top}/{k:016x}{suffix}" for k in batch["number"].to_pylist()]
            for path, file in zip(paths, batch["file"], strict=True):
                with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as out:
                    out.write(file.as_buffer())
                store.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([len(f.as_buffer()) for f in batch["file"]], pa.int64())], ["path", "bytes"])

    arrow_rows(files.sparkSession)
    return files.select(F.col(number).alias("number"), "file").mapInArrow(put, "path string, bytes long")


def rest() -> None:
    """Give memory that a Python worker no longer uses back to the machine: workers stay, idle, beside the next stage's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before this one in the order, within ``group`` if given.

    The rows are dealt by range, so that neither a large group nor many equal keys meet in one task;
    each range's sums are few and are summed again over the ranges. ``order`` should be unique, else
    equal rows take their places in any order. Pass few and narrow columns: they are written once.
    """
    keys = [group] if group else []
    dealt = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part") if not group else Window.partitionBy(group).orderBy("_part")
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same: Column = F.col("a._part") == F.col("b._part")
    if group:
        same = same & F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))
    # One row per range and group that meet: at most ranges + groups, since ranges are consecutive.
    joined = run.alias("a").join(offsets.alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("_inside") + F.col("_before")).alias(out))


def least_reachable(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the smallest node that each can reach."""
    nodes, places = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    x, y = places[: len(lo)], places[len(lo) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # of two roots the larger one hangs on to the smaller
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, at_once: int = 0) -> DataFrame:
    """``node``, ``component``: each node of the edges with the smallest node it can reach.

    Up to ``at_once`` edges (cheap to read twice) go to one task, where rounds of shuffles would be most of the work. Beyond, it
    alternates large-star and small-star steps until the edges no longer change (logarithmically many rounds);
    each round's edges are a written table. Minima are pre-aggregated before they are shuffled, and a node
    with very many neighbours meets them in a join whose large side Spark can split.
    """
    edges = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi")
    if at_once and edges.count() <= at_once:

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(x["lo"].to_numpy(), x["hi"].to_numpy()) for x in batches] or [(np.zeros(0, np.int64),) * 2]
            nodes, least = least_reachable(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

        arrow_rows(edges.sparkSession)
        return written(edges.coalesce(1).mapInArrow(found, "node long, component long"), "components")
    now = written(edges.distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo < hi").distinct()
        lower = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        # Small-star: hi's other lower neighbours, and hi itself, hang on to its smallest one.
        small = large.withColumnRenamed("hi", "u").join(lower, "u").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(lower.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        new = written(small.where("lo < hi").distinct(), "edges")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        drop_written(now)
        now = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
