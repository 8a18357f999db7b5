"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def spark_session(name: str = "barspan", master: str | None = None, **conf) -> SparkSession:
    """UTC, adaptive plans, Arrow; shuffle partitions are coalesced at run time, so their number is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
