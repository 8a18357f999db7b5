"""Bars as Parquet files partitioned by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.sources import schema


def write_bars(bars: DataFrame, root: str) -> str:
    """Canonical bars under ``root``; only the tickers present are replaced. Dates are sorted within a ticker's files, for row-group pruning."""
    rows = schema.normalise(bars)
    dealt = rows.repartition("ticker").sortWithinPartitions("ticker", "date")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(str(root))
    return str(root)


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(str(root))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_bars(spark: SparkSession, root: str, tickers: list[str] | None = None) -> DataFrame:
    """Canonical bars, in no order: sort where an order shows. The schema is given, so that tickers like 007 stay text; ``tickers`` prunes partitions."""
    if not _exists(spark, root):
        raise FileNotFoundError(root)
    bars = spark.read.schema(schema.BAR_SCHEMA).parquet(str(root))
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(list(tickers)))
    return bars.select(*schema.BAR_COLUMNS)


def write_panel(panel: DataFrame, out: str) -> str:
    """A wide panel (a column per ticker) as one Parquet file: it is a hand-over format for small universes."""
    panel.orderBy("date").coalesce(1).write.mode("overwrite").parquet(str(out))
    return str(out)
