import datetime as dt
import re

import numpy as np
import pytest
from barspan.operators import panel
from barspan.sources import bar_sources, schema, storage, synthetic
from pyspark.sql import functions as F


def test_schema_is_checked_without_a_job(spark):
    good = bar_sources.SyntheticSource(spark, 5, n_pairs=1, n_noise=0).fetch()
    schema.validate_schema(good)
    schema.validate_schema(good.withColumn("date", F.to_date("date")).withColumn("volume", F.col("volume").cast("int")).withColumn("more", F.lit(1)))
    for bad in (good.drop("open"), good.withColumn("date", F.lit("x")), good.withColumn("low", F.lit("x"))):
        with pytest.raises(schema.SchemaError):
            schema.validate_schema(bad)


def test_nan_becomes_null_and_vendor_names_ours(spark):
    raw = spark.createDataFrame([(dt.date(2020, 1, 2), 1.0, 2.0, 0.5, 1.5, 10), (dt.date(2020, 1, 3), float("nan"), 2.0, 0.5, None, 10)], "Date date, Open double, High double, Low double, Close double, Volume int")
    rows = schema.rename_vendor(raw, "007").collect()
    assert len(rows) == 1 and rows[0].ticker == "007" and rows[0].adj_close == 1.5
    assert schema.normalise(schema.rename_vendor(raw.na.fill(1.0, ["Close"]), "t")).where("open is null").count() == 1


def test_seeds_repeat_and_bars_are_consistent(spark):
    a, b = (bar_sources.SyntheticSource(spark, 60, n_pairs=2, n_noise=1, seed=5) for _ in range(2))
    assert a.truth == [("P0a", "P0b"), ("P1a", "P1b")] and a.tickers == ["P0a", "P0b", "P1a", "P1b", "N0"]
    assert a.fetch().collect() == b.fetch().collect()
    assert isinstance(a, bar_sources.BarSource)
    assert a.fetch().where("low > least(open, close) or high < greatest(open, close) or volume < 1e6 or adj_close <> close").count() == 0
    assert a.fetch().where("dayofweek(date) in (1, 7)").count() == 0


def test_spark_reads_the_generator(spark):
    spark.dataSource.register(bar_sources.SyntheticBars)
    read = spark.read.format("synthetic_bars").options(n=40, pairs=1, noise=2, seed=9).load()
    assert sorted(read.collect()) == sorted(bar_sources.SyntheticSource(spark, 40, n_pairs=1, n_noise=2, seed=9).fetch().collect())


def test_paths(rng=None):
    rng = np.random.default_rng(3)
    params = synthetic.OUParams(0.1, 2.0, 0.3)
    path = synthetic.simulate_ou(50_000, params, rng)
    assert path[0] == 2.0 and abs(path.std() / params.stationary_std - 1) < 0.05
    assert params.half_life == pytest.approx(np.log(2) / 0.1)
    state = rng.bit_generator.state
    assert synthetic.simulate_ou(1, params, rng, x0=7.0).tolist() == [7.0] and rng.bit_generator.state == state
    assert synthetic.simulate_random_walk(10, rng, x0=4.0)[0] == 4.0
    for f in (lambda: synthetic.simulate_ou(0, params, rng), lambda: synthetic.simulate_random_walk(0, rng), lambda: synthetic.OUParams(0, 0, 1), lambda: synthetic.OUParams(1, 0, 0), lambda: synthetic.simulate_panel(5, rng, n_pairs=-1)):
        with pytest.raises(ValueError):
            f()


def test_write_replaces_only_its_tickers(spark, tmp_path):
    bars = bar_sources.SyntheticSource(spark, 30, n_pairs=1, n_noise=1, seed=5).fetch().replace("N0", "007", "ticker")
    root = storage.write_bars(bars, f"{tmp_path}/deep/bars")
    storage.write_bars(bars.where("ticker = '007'").limit(10), root)
    read = storage.read_bars(spark, root)
    assert read.columns == list(schema.BAR_COLUMNS)
    assert {r.ticker: r["count"] for r in read.groupBy("ticker").count().collect()} == {"007": 10, "P0a": 30, "P0b": 30}
    assert [tuple(r) for r in read.where("ticker = 'P0a'").collect()] == [tuple(r) for r in schema.normalise(bars).where("ticker = 'P0a'").orderBy("date").collect()]
    pruned = storage.read_bars(spark, root, ["P0a"])
    assert re.search(r"PartitionFilters: \[[^\]]*ticker", pruned._jdf.queryExecution().toString()) and pruned.count() == 30
    assert storage.read_bars(spark, root, []).count() == 0
    with pytest.raises(FileNotFoundError):
        storage.read_bars(spark, f"{tmp_path}/none")


def test_file_and_vendor_sources(spark, tmp_path):
    bars = bar_sources.SyntheticSource(spark, 8, n_pairs=1, n_noise=0).fetch()
    bars.write.option("header", True).csv(f"{tmp_path}/csv")
    assert bar_sources.FileSource(spark, f"{tmp_path}/csv", "csv").fetch().count() == 16
    vendor = bar_sources.VendorSource(["P0a", "P0b"], "2015-01-01", download=lambda t, a, b: bars.where(F.col("ticker") == t).drop("ticker").withColumnRenamed("close", "Close"))
    assert vendor.fetch().count() == 16
    with pytest.raises(ValueError):
        bar_sources.VendorSource([], "2015-01-01")
    with pytest.raises(RuntimeError):
        bar_sources.VendorSource(["a"], "2015-01-01", download=lambda *a: None).fetch()
    with pytest.raises(RuntimeError):
        bar_sources.VendorSource(["a"], "2015-01-01").fetch()


def test_panel_takes_the_last_value_in_input_order(spark):
    rows = [(1, "A", 1.0), (1, "A", 2.0), (1, "A", None), (2, "A", None), (2, "B", 5.0), (3, "B", None)]
    day = [dt.datetime(2020, 1, d) for d in (1, 2, 3, 4)]
    bars = spark.createDataFrame([(day[d], t, *(v,) * 5, 1.0, n) for n, (d, t, v) in enumerate(rows)], "date timestamp_ntz, ticker string, open double, high double, low double, close double, adj_close double, volume double, _row_ord long")
    found = {(r.date, r.ticker): r.px for r in panel.price_panel(bars).collect()}
    assert found == {(day[1], "A"): 2.0, (day[2], "B"): 5.0}
    assert panel.wide(panel.price_panel(bars)).columns == ["date", "A", "B"]
    with pytest.raises(schema.SchemaError):
        panel.price_panel(bars, "ticker")
