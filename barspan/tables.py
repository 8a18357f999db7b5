"""Tables kept between steps: lineage and plans end there, and losing an executor loses nothing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that this process has written and not deleted.
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, one of this machine, and only if the executors run here, too."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="barspan-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for a table, deleted with the others by ``release`` or when the process ends, if not before."""
    if not _WRITTEN:
        atexit.register(_at_exit)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN.pop(folder, None)


def release(spark: SparkSession) -> int:
    """Delete all tables written between steps so far, once nothing reads the results that were made from them; how many there were."""
    folders = [f for f, s in _WRITTEN.items() if s is spark]
    for folder in folders:
        delete(spark, folder)
    return len(folders)


def _at_exit() -> None:
    for folder, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the session may have ended, and its gateway with it
            delete(spark, folder)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Written once as Parquet, and read from there by all that use it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
