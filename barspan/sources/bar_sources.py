"""Where bars come from: generators, files, vendors; and the same generator as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barspan.sources import schema, synthetic


@runtime_checkable
class BarSource(Protocol):
    def fetch(self) -> DataFrame:
        """Canonical bars."""


class SyntheticSource:
    """Seeded bars; ``truth`` names the cointegrated pairs."""

    def __init__(self, spark: SparkSession, n: int = 1000, *, n_pairs: int = 3, n_noise: int = 4, seed: int = 7):
        self.spark = spark
        self.panel = synthetic.simulate_panel(n, np.random.default_rng(seed), n_pairs=n_pairs, n_noise=n_noise)
        # A stream of its own: prices do not depend on how bars are drawn around them.
        self._rows = list(synthetic.bar_rows(self.panel, np.random.default_rng(seed + 1)))

    @property
    def truth(self) -> list[tuple[str, str]]:
        return list(self.panel.truth)

    @property
    def tickers(self) -> list[str]:
        return list(self.panel.prices)

    def fetch(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, schema.BAR_SCHEMA)


class FileSource:
    """Bars in files that Spark reads: parquet, csv, json or orc, in our column names or a vendor's."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet", **options):
        self.spark, self.path, self.kind, self.options = spark, path, kind, options

    def fetch(self) -> DataFrame:
        reader = self.spark.read.format(self.kind).options(**self.options)
        if self.kind == "csv":
            reader = reader.option("header", True).option("inferSchema", True)
        return schema.rename_vendor(reader.load(self.path))


class VendorSource:
    """Bars that a download function returns per ticker, as DataFrames in vendor columns."""

    def __init__(self, tickers: list[str], start: str, end: str | None = None, *, download=None):
        if not tickers:
            raise ValueError("no tickers")
        self.tickers, self.start, self.end, self.download = list(tickers), start, end, download

    def fetch(self) -> DataFrame:
        if self.download is None:
            raise RuntimeError("no download function: there is no network here")
        found = [schema.rename_vendor(frame, t) for t in self.tickers if (frame := self.download(t, self.start, self.end)) is not None]
        if not found or all(f.isEmpty() for f in found):
            raise RuntimeError("the vendor returned nothing")
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out


class _Part(InputPartition):
    def __init__(self, ticker: str):
        self.ticker = ticker


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.settings = {k: int(options.get(k, d)) for k, d in (("n", 1000), ("pairs", 3), ("noise", 4), ("seed", 7))}

    def _rows(self):
        s = self.settings
        panel = synthetic.simulate_panel(s["n"], np.random.default_rng(s["seed"]), n_pairs=s["pairs"], n_noise=s["noise"])
        return synthetic.bar_rows(panel, np.random.default_rng(s["seed"] + 1))

    def partitions(self):
        s = self.settings
        names = [f"P{k}{side}" for k in range(s["pairs"]) for side in "ab"] + [f"N{k}" for k in range(s["noise"])]
        return [_Part(t) for t in names] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        # The streams are sequential, so each task draws them all and keeps its ticker.
        return (row for row in self._rows() if row[1] == partition.ticker)


class SyntheticBars(DataSource):
    """``spark.read.format("synthetic_bars").option("n", 400).option("seed", 42).load()``"""

    @classmethod
    def name(cls) -> str:
        return "synthetic_bars"

    def schema(self):
        return schema.BAR_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
