import datetime as dt
import math

import numpy as np
import pytest
from barspan.operators.universe import Membership, PointInTimeUniverse
from barspan.sources.bar_sources import SyntheticSource
from pyspark.sql import functions as F

PX = "date timestamp_ntz, ticker string, px double"


def days(n):
    return [dt.datetime(2021, 1, 4) + dt.timedelta(days=k + 2 * (k // 5)) for k in range(n)]


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame([(d, t, base + k) for k, d in enumerate(days(10)) for t, base in (("AAA", 100.0), ("BBB", 200.0))], PX)


@pytest.fixture(scope="module")
def bars_universe(spark):
    return PointInTimeUniverse.from_bars(SyntheticSource(spark, 80, n_pairs=1, n_noise=1, seed=4).fetch()).keep()


def test_constructor_checks(spark, prices):
    with pytest.raises(TypeError):
        PointInTimeUniverse(prices.withColumn("date", F.lit("x")))
    with pytest.raises(ValueError):
        PointInTimeUniverse(prices.union(prices))
    assert PointInTimeUniverse(prices).tickers() == ["AAA", "BBB"]


def test_reads_stop_at_their_date(prices):
    u = PointInTimeUniverse(prices)
    for k, d in enumerate(days(10)):
        seen = u.as_of(d)
        assert seen.agg(F.max("date")).first()[0] == d and seen.count() == 2 * (k + 1)
        assert u.price_as_of(d, "AAA") == 100.0 + k
    weekend = dt.datetime(2021, 1, 9)
    assert u.asof_date(weekend) == dt.datetime(2021, 1, 8) and u.asof_date("2020-01-01") is None
    assert u.price_as_of(weekend, "BBB") == 204.0
    assert {r.ticker: r.px for r in u.close_row(weekend).collect()} == {"AAA": 104.0, "BBB": 204.0}
    assert u.window(weekend, 3).count() == 6
    with pytest.raises(ValueError):
        u.window(weekend, 0)


def test_appending_days_changes_no_earlier_read(spark, prices):
    whole = PointInTimeUniverse(prices)
    for d in days(10)[2:9:3]:
        cut = PointInTimeUniverse(prices.where(F.col("date") <= F.lit(d)))
        assert sorted(cut.as_of(d).collect()) == sorted(whole.as_of(d).collect())


def test_membership(spark, prices):
    late = prices.where("not (ticker = 'BBB' and date < '2021-01-11')")
    u = PointInTimeUniverse(late)
    assert u.members_as_of("2021-01-05") == ["AAA"] and u.members_as_of("2021-01-12") == ["AAA", "BBB"]
    assert u.price_as_of("2021-01-05", "BBB") is None and not u.membership.is_member("CCC", "2021-01-05")
    spans = spark.createDataFrame([("AAA", days(10)[0], days(10)[9]), ("BBB", days(10)[0], days(10)[2])], "ticker string, first_date timestamp_ntz, last_date timestamp_ntz")
    u = PointInTimeUniverse(prices, membership=Membership(spans))
    assert u.price_as_of(days(10)[5], "BBB") is None and u.as_of(days(10)[5]).where("ticker = 'BBB'").count() == 0
    assert u.as_of(days(10)[5], members_only=False).where("ticker = 'BBB'").count() == 6
    assert [r.ticker for r in u.close_row(days(10)[3]).collect()] == ["AAA"]
    on = u.membership.on(u.trading_days())
    assert on.where("ticker = 'BBB'").count() == 3


def test_features(bars_universe):
    u = bars_universe
    px = {(r.date, r.ticker): r.px for r in u._prices.collect()}
    volume = {(r.date, r.ticker): r.volume for r in u._volume.collect()}
    dates = sorted({d for d, _ in px})
    rows = {(r.date, r.ticker): r for r in u.features().collect()}
    assert len(rows) == len(px)
    for t in u.tickers():
        for k in (0, 1, 2, 5, 25, 79):
            r = rows[dates[k], t]
            logs = np.log([px[d, t] for d in dates[: k + 1]])
            moves = np.diff(logs)[-20:]
            assert r.vol == (pytest.approx(moves.std()) if len(moves) >= 2 else None)
            assert r.adv == pytest.approx(np.mean([volume[d, t] for d in dates[max(0, k - 19) : k + 1]]))
    d, t = dates[30], u.tickers()[0]
    assert u.volume_as_of(d, t) == pytest.approx(rows[d, t].adv) and u.volatility_as_of(d, t) == pytest.approx(rows[d, t].vol)
    assert u.open_price(d, t) == pytest.approx(rows[d, t].adj_open) and u.open_price("1999-01-01", t) is None
    assert u.volume_as_of("1999-01-01", t) is None and u.volatility_as_of(dates[1], t) is None


def test_volatility_spans_gaps(spark):
    d = days(5)
    px = spark.createDataFrame([(d[0], "A", 1.0), (d[1], "A", 2.0), (d[3], "A", 1.0), (d[2], "B", 1.0)], PX)
    vol = PointInTimeUniverse(px).volatility_as_of(d[4], "A")
    assert vol == pytest.approx(math.log(2))
