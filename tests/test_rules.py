import datetime as dt

import pytest
from barspan.operators import quality_rules
from barspan.plans import fixture
from barspan.sources.bar_sources import SyntheticSource
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def clean(spark):
    return SyntheticSource(spark, 250, n_pairs=1, n_noise=1, seed=3).fetch()


def codes(bars, **settings):
    return [(i.severity, i.code, i.ticker) for i in quality_rules.validate_bars(bars, **settings).issues]


def test_clean_bars_pass(clean):
    report = quality_rules.validate_bars(clean)
    assert report.ok and not report.errors and [i.code for i in report.warnings] in ([], ["calendar_gap"] * 0)


@pytest.mark.parametrize(
    "change,code",
    [
        (lambda b, first: b.withColumn("close", F.when(first, -1.0).otherwise(F.col("close"))), "nonpositive_price"),
        (lambda b, first: b.withColumn("volume", F.when(first, -1.0).otherwise(F.col("volume"))), "negative_volume"),
        (lambda b, first: b.withColumn("high", F.when(first, F.col("low") - 1).otherwise(F.col("high"))), "ohlc_inconsistent"),
        (lambda b, first: b.withColumn("low", F.when(first, F.lit(None)).otherwise(F.col("low"))), "ohlc_inconsistent"),
        (lambda b, first: b.unionByName(b.where(first)), "unsorted_dates"),
    ],
)
def test_each_error(clean, change, code):
    first = (F.col("ticker") == "N0") & (F.col("date") == clean.agg(F.min("date")).first()[0])
    found = codes(change(clean, first))
    assert ("error", code, "N0") in found and all(t in ("N0", None) for _, _, t in found)
    assert (("error", "duplicate_rows", None) in found) == (code == "unsorted_dates")


def test_warnings(clean):
    gap = clean.where("not (ticker = 'N0' and date between '2015-03-02' and '2015-03-12')")
    assert ("warning", "calendar_gap", "N0") in codes(gap)
    split = clean.withColumn("adj_close", F.when(F.col("ticker").eqNullSafe("N0") & (F.col("date") > F.lit("2015-06-01").cast("timestamp_ntz")), F.col("adj_close") / 2).otherwise(F.col("adj_close")))
    assert ("warning", "possible_corporate_action", "N0") in codes(split)
    assert codes(split, split_ratio_threshold=0.6) == codes(clean)
    assert quality_rules.validate_bars(split).ok


def test_zero_and_missing_prices_do_not_stop_it(spark, clean):
    rows = [(dt.datetime(2020, 1, k), "Z", 1.0, 1.0, 1.0, 1.0, a, 1.0) for k, a in ((1, 0.0), (2, 0.0), (3, 5.0), (4, None), (5, 1.0))]
    report = quality_rules.validate_bars(spark.createDataFrame(rows, clean.schema))
    assert {i.code for i in report.issues} == {"nonpositive_price", "possible_corporate_action"}
    assert [i.message for i in report.warnings] == ["1 moves of more than 40%"]
    assert len(report) == 2


def test_order_of_issues(spark):
    found = codes(fixture.dirty_bars(spark, "/root/testdata/sf0.01"))
    assert found[0] == ("error", "duplicate_rows", None)
    assert [t for _, _, t in found[1:]] == sorted(t for _, _, t in found[1:])
    assert {c for _, c, _ in found} == {"duplicate_rows", "unsorted_dates", "nonpositive_price", "negative_volume", "ohlc_inconsistent", "calendar_gap", "possible_corporate_action"}
