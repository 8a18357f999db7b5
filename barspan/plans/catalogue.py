"""Registered queries over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspan import tables
from barspan.functions import distributions
from barspan.operators import backtest, discovery, panel, quality_rules, signals, walkforward
from barspan.plans import fixture
from barspan.sources import bar_sources, schema, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A day in the middle of the bars, and strategy settings at which the bars trade.
DAY = "1996-06-30"
TRADE = {"entry": 1.0, "exit": 0.25, "stop": 2.0}
ANALYSED = ("AO", "AF")


def query(sql: str | None = None, dirty: bool = False):
    """Register a function by its name, with SQL over ``bars`` (date, ticker, ...), or over ``dirty``, if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            more = f", dirty AS ({fixture.DIRTY_SQL})" if dirty else ""
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {fixture.WALKS_SQL}, bars AS ({fixture.BARS_SQL}){more}{sql}"
        return f

    return register


def r(name: str, digits: int = 8, of=None):
    return F.round(F.col(name) if of is None else of, digits).alias(name)


# Bars, panels, returns.


@query(" SELECT date, ticker, open, high, low, close, adj_close, volume FROM bars")
def bars_daily(spark, sf):
    """Values are the same to the last bit, so they are not rounded."""
    return fixture.derived_bars(spark, sf).select("date", "ticker", "open", "high", "low", "close", "adj_close", "volume")


@query(" SELECT date, MAX(CASE WHEN ticker = 'AF' THEN adj_close END) AS AF, MAX(CASE WHEN ticker = 'AO' THEN adj_close END) AS AO, MAX(CASE WHEN ticker = 'NF' THEN adj_close END) AS NF, MAX(CASE WHEN ticker = 'NO' THEN adj_close END) AS NO, MAX(CASE WHEN ticker = 'RF' THEN adj_close END) AS RF, MAX(CASE WHEN ticker = 'RO' THEN adj_close END) AS RO FROM bars GROUP BY date")
def price_panel(spark, sf):
    return panel.wide(panel.price_panel(fixture.derived_bars(spark, sf)), tickers=["AF", "AO", "NF", "NO", "RF", "RO"])


@query(" SELECT date, ticker, ROUND(open * adj_close / close, 8) AS adj_open FROM bars")
def adjusted_open(spark, sf):
    return panel.adjusted_open(fixture.derived_bars(spark, sf)).select("date", "ticker", r("adj_open"))


_RETURNS = """, clock AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS day_no FROM (SELECT DISTINCT date FROM bars) d),
p AS (SELECT b.date, b.ticker, c.day_no, LN(b.adj_close) AS lpx FROM bars b JOIN clock c ON c.date = b.date),
ret AS (SELECT *, CASE WHEN LAG(day_no) OVER (PARTITION BY ticker ORDER BY day_no) = day_no - 1 THEN lpx - LAG(lpx) OVER (PARTITION BY ticker ORDER BY day_no) END AS ret FROM p)"""


@query(_RETURNS + " SELECT date, ticker, day_no, ROUND(lpx, 8) AS lpx, ROUND(ret, 8) AS ret FROM ret")
def log_returns(spark, sf):
    return panel.log_returns(panel.price_panel(fixture.derived_bars(spark, sf))).select("date", "ticker", F.col("day_no").cast("long").alias("day_no"), r("lpx"), r("ret"))


@query(f" SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS day_no FROM (SELECT DISTINCT date FROM bars WHERE date BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '{DAY} 00:00:00') d")
def trading_days(spark, sf):
    days = panel.trading_days(panel.price_panel(fixture.derived_bars(spark, sf)), "1995-01-01", DAY)
    return days.select("date", F.col("day_no").cast("long").alias("day_no"))


@query(" SELECT COUNT(DISTINCT ticker) AS tickers, COUNT(*) AS bars FROM bars")
def ticker_count(spark, sf):
    return fixture.derived_bars(spark, sf).agg(F.count_distinct("ticker").alias("tickers"), F.count("*").alias("bars"))


@query(f" SELECT date, ticker, ROUND(adj_close, 8) AS adj_close FROM bars WHERE ticker IN ('AF', 'RO') AND date <= TIMESTAMP '{DAY} 00:00:00'")
def stored_bars(spark, sf):
    """Written by ticker, and read again with two partitions."""
    import uuid

    from barspan.sources import storage
    from barspan.tables import shared_folder

    root = storage.write_bars(fixture.derived_bars(spark, sf), f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}")
    return storage.read_bars(spark, root, ["AF", "RO"]).where(F.col("date") <= F.lit(DAY).cast("timestamp_ntz")).select("date", "ticker", r("adj_close"))


# Rules.


@query(" SELECT COUNT(*) - COUNT(DISTINCT ticker || CAST(date AS VARCHAR)) AS repeated FROM dirty", dirty=True)
def validate_duplicates(spark, sf):
    found = quality_rules.issues(fixture.dirty_bars(spark, sf)).where("code = 'duplicate_rows'")
    return found.select(F.regexp_extract("message", r"^(\d+)", 1).cast("long").alias("repeated"))


_ORDERED = """, o AS (SELECT *, LAG(date) OVER (PARTITION BY ticker ORDER BY date) AS pd, LAG(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS pa FROM dirty)"""


@query(_ORDERED + """ SELECT ticker, COUNT(date) - COUNT(DISTINCT date) AS repeated_dates, BOOL_OR(close <= 0) AS bad_close, BOOL_OR(volume < 0) AS bad_volume,
  BOOL_AND(low <= LEAST(open, close) + 1e-9 AND high >= GREATEST(open, close) - 1e-9) AS consistent,
  COUNT(*) FILTER (WHERE EXTRACT(EPOCH FROM date) - EXTRACT(EPOCH FROM pd) >= 6 * 86400) AS gaps, COUNT(*) FILTER (WHERE ABS((adj_close - pa) / pa) > 0.4) AS jumps FROM o GROUP BY ticker""", dirty=True)
def validate_rules(spark, sf):
    m = quality_rules.measures(fixture.dirty_bars(spark, sf))
    return m.select("ticker", "repeated_dates", "bad_close", "bad_volume", "consistent", "gaps", "jumps")


@query(""", i AS (SELECT ticker, COUNT(date) > COUNT(DISTINCT date) AS a, BOOL_OR(close <= 0) AS b, BOOL_OR(volume < 0) AS c, NOT BOOL_AND(low <= LEAST(open, close) + 1e-9 AND high >= GREATEST(open, close) - 1e-9) AS d FROM dirty GROUP BY ticker)
  SELECT ticker, code FROM (SELECT ticker, 'unsorted_dates' AS code FROM i WHERE a UNION ALL SELECT ticker, 'nonpositive_price' FROM i WHERE b UNION ALL SELECT ticker, 'negative_volume' FROM i WHERE c UNION ALL SELECT ticker, 'ohlc_inconsistent' FROM i WHERE d UNION ALL SELECT NULL, 'duplicate_rows') x""", dirty=True)
def validate_errors(spark, sf):
    return quality_rules.issues(fixture.dirty_bars(spark, sf)).where("severity = 'error'").select("ticker", "code")


@query(_ORDERED + """, g AS (SELECT ticker, COUNT(*) FILTER (WHERE EXTRACT(EPOCH FROM date) - EXTRACT(EPOCH FROM pd) >= 6 * 86400) AS gaps, COUNT(*) FILTER (WHERE ABS((adj_close - pa) / pa) > 0.4) AS jumps FROM o GROUP BY ticker)
  SELECT ticker, 'calendar_gap' AS code FROM g WHERE gaps > 0 UNION ALL SELECT ticker, 'possible_corporate_action' FROM g WHERE jumps > 0""", dirty=True)
def validate_warnings(spark, sf):
    found = quality_rules.validate_bars(fixture.dirty_bars(spark, sf)).warnings
    return spark.createDataFrame([(i.ticker, i.code) for i in found], "ticker string, code string")


# Sources.


def _vendor(spark, sf) -> DataFrame:
    """The bars under a vendor's column names, some without a close, and a column more."""
    bars = fixture.derived_bars(spark, sf)
    close = F.when(F.dayofmonth("date") != 13, F.col("close"))
    return bars.select(F.col("date").alias("Date"), F.col("ticker").alias("Symbol"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), close.alias("Close"), F.col("volume").alias("Volume"), F.lit("x").alias("Exchange"))


_VENDOR_SQL = " SELECT date, ticker, open, high, low, close, close AS adj_close, volume FROM bars WHERE EXTRACT(DAY FROM date) <> 13"


@query(_VENDOR_SQL)
def vendor_columns(spark, sf):
    """Vendor names to ours; a missing adjusted close is the close."""
    return schema.rename_vendor(_vendor(spark, sf))


@query(_VENDOR_SQL)
def file_source(spark, sf):
    """Bars in vendor columns written as files and fetched through a source."""
    path = tables.new_folder(spark, "vendor")
    _vendor(spark, sf).write.parquet(path)
    return bar_sources.FileSource(spark, path).fetch()


@query(_VENDOR_SQL + " AND ticker IN ('AF', 'RO')")
def vendor_source(spark, sf):
    """Bars that a download function gives ticker by ticker."""
    rows = _vendor(spark, sf)
    return bar_sources.VendorSource(["AF", "RO"], "1990-01-01", download=lambda ticker, start, end: rows.where(F.col("Symbol") == ticker).drop("Symbol")).fetch()


@query(" SELECT * FROM (VALUES ('bars', true), ('no volume', false), ('text for a price', false), ('text for a date', false), ('a column more', true)) v(case_name, fine)")
def schema_check(spark, sf):
    """Which tables are bar tables."""
    bars = fixture.derived_bars(spark, sf)
    cases = {"bars": bars, "no volume": bars.drop("volume"), "text for a price": bars.withColumn("open", F.lit("x")), "text for a date": bars.withColumn("date", F.lit("x")), "a column more": bars.withColumn("more", F.lit(1))}

    def fine(table: DataFrame) -> bool:
        try:
            schema.validate_schema(table)
        except schema.SchemaError:
            return False
        return True

    return spark.createDataFrame([(name, fine(t)) for name, t in cases.items()], "case_name string, fine boolean")


@query(" SELECT CAST(d AS TIMESTAMP) AS date FROM generate_series(TIMESTAMP '2015-01-01 00:00:00', TIMESTAMP '2025-01-01 00:00:00', INTERVAL 1 DAY) g(d) WHERE EXTRACT(ISODOW FROM d) < 6 ORDER BY d LIMIT 1000")
def business_days(spark, sf):
    return spark.createDataFrame([(d,) for d in synthetic.business_days(1000, "2015-01-01")], "date timestamp_ntz")


# Point-in-time reads.


@query(" SELECT DISTINCT ticker FROM bars")
def universe_tickers(spark, sf):
    return spark.createDataFrame([(t,) for t in fixture.universe(spark, sf).tickers()], "ticker string")


@query(f""", lp AS (SELECT ticker, ARG_MAX(adj_close, date) AS px, ARG_MAX(CASE WHEN date = TIMESTAMP '{DAY} 00:00:00' THEN open * adj_close / close END, date) AS adj_open FROM bars WHERE date <= TIMESTAMP '{DAY} 00:00:00' GROUP BY ticker),
  lk AS (SELECT ticker, volume, LN(adj_close) - LAG(LN(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS rr, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE date <= TIMESTAMP '{DAY} 00:00:00'),
  ft AS (SELECT ticker, AVG(volume) AS adv, STDDEV_POP(rr) AS vol FROM lk WHERE k <= 20 GROUP BY ticker)
  SELECT lp.ticker, ROUND(px, 8) AS px, ROUND(adj_open, 8) AS adj_open, ROUND(adv, 4) AS adv, ROUND(vol, 8) AS vol FROM lp JOIN ft ON ft.ticker = lp.ticker WHERE lp.ticker IN ('AF', 'RO')""")
def single_reads(spark, sf):
    """The reads of one ticker at one time, each through its own method."""
    u = fixture.universe(spark, sf)
    rows = [(t, u.price_as_of(DAY, t), u.open_price(DAY, t), u.volume_as_of(DAY, t), u.volatility_as_of(DAY, t)) for t in ("AF", "RO")]
    return spark.createDataFrame(rows, "ticker string, px double, adj_open double, adv double, vol double").select("ticker", r("px"), r("adj_open"), r("adv", 4), r("vol"))



@query(" SELECT ticker, MIN(date) AS first_date, MAX(date) AS last_date FROM bars GROUP BY ticker")
def membership(spark, sf):
    return fixture.universe(spark, sf).membership.intervals


@query(" , m AS (SELECT ticker, MIN(date) AS a, MAX(date) AS b FROM bars GROUP BY ticker) SELECT d.date, COUNT(*) AS members, MIN(m.ticker) AS first_ticker FROM (SELECT DISTINCT date FROM bars) d JOIN m ON d.date BETWEEN m.a AND m.b GROUP BY d.date")
def members_as_of(spark, sf):
    u = fixture.universe(spark, sf)
    return u.membership.on(u.trading_days()).groupBy("date").agg(F.count("*").alias("members"), F.min("ticker").alias("first_ticker"))


_MEMBERS = f", m AS (SELECT ticker FROM bars GROUP BY ticker HAVING TIMESTAMP '{DAY} 00:00:00' BETWEEN MIN(date) AND MAX(date))"


@query(_MEMBERS + f" SELECT date, ticker, ROUND(adj_close, 8) AS px FROM bars WHERE date <= TIMESTAMP '{DAY} 00:00:00' AND ticker IN (SELECT ticker FROM m)")
def as_of_panel(spark, sf):
    return fixture.universe(spark, sf).as_of(DAY).select("date", "ticker", r("px"))


@query(_MEMBERS + f" SELECT date, ticker, ROUND(adj_close, 8) AS px FROM bars WHERE ticker IN (SELECT ticker FROM m) AND date IN (SELECT DISTINCT date FROM bars WHERE date <= TIMESTAMP '{DAY} 00:00:00' ORDER BY date DESC LIMIT 30)")
def window_panel(spark, sf):
    return fixture.universe(spark, sf).window(DAY, 30).select("date", "ticker", r("px"))


@query(_MEMBERS + f" SELECT ticker, ROUND(adj_close, 8) AS px FROM bars WHERE ticker IN (SELECT ticker FROM m) AND date = (SELECT MAX(date) FROM bars WHERE date <= TIMESTAMP '{DAY} 00:00:00')")
def close_row(spark, sf):
    return fixture.universe(spark, sf).close_row(DAY).select("ticker", r("px"))


@query(f" SELECT MAX(date) AS date FROM bars WHERE date <= TIMESTAMP '{DAY} 12:00:00'")
def asof_date(spark, sf):
    return spark.createDataFrame([(fixture.universe(spark, sf).asof_date(f"{DAY} 12:00:00"),)], "date timestamp_ntz")


@query(""", x AS (SELECT date, ticker, adj_close, volume, ROUND(open * adj_close / close, 8) AS adj_open, LN(adj_close) - LAG(LN(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS rr FROM bars)
  SELECT date, ticker, ROUND(adj_close, 8) AS px, adj_open, ROUND(AVG(volume) OVER w20, 4) AS adv,
    ROUND(CASE WHEN COUNT(rr) OVER w20 >= 2 THEN STDDEV_POP(rr) OVER w20 END, 8) AS vol
  FROM x WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def features_asof(spark, sf):
    """Price, adjusted open, daily volume and volatility that an order meets."""
    return fixture.universe(spark, sf).features().select("date", "ticker", r("px"), r("adj_open"), r("adv", 4), r("vol"))


@query(""", d AS (SELECT DISTINCT date FROM bars), t AS (SELECT ticker, MIN(date) AS a, MAX(date) AS b FROM bars GROUP BY ticker),
  x AS (SELECT d.date, t.ticker, b.adj_close FROM d CROSS JOIN t LEFT JOIN bars b ON b.date = d.date AND b.ticker = t.ticker WHERE d.date BETWEEN t.a AND t.b)
  SELECT date, ticker, ROUND(LAST_VALUE(adj_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS px FROM x""")
def price_as_of(spark, sf):
    """The last known price of every member on every day."""
    u = fixture.universe(spark, sf)
    asked = u.membership.on(u.trading_days())
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return asked.join(u._prices, ["date", "ticker"], "left").select("date", "ticker", F.round(F.last("px", ignorenulls=True).over(past), 8).alias("px"))


@query(f" SELECT ticker, ROUND(open * adj_close / close, 8) AS adj_open FROM bars WHERE date = TIMESTAMP '{DAY} 00:00:00'")
def open_price(spark, sf):
    """Adjusted opens of exactly one date."""
    u = fixture.universe(spark, sf)
    return u._opens.where(F.col("date") == F.lit(DAY).cast("timestamp_ntz")).select("ticker", r("adj_open"))


@query(f" SELECT ticker, ROUND(AVG(volume), 4) AS adv FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE date <= TIMESTAMP '{DAY} 00:00:00') x WHERE k <= 20 GROUP BY ticker")
def volume_as_of(spark, sf):
    rows = fixture.universe(spark, sf).volumes().where(F.col("date") <= F.lit(DAY).cast("timestamp_ntz"))
    return rows.groupBy("ticker").agg(F.round(F.max_by("adv", "date"), 4).alias("adv"))


@query(f""", x AS (SELECT ticker, date, LN(adj_close) - LAG(LN(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS rr FROM bars WHERE date <= TIMESTAMP '{DAY} 00:00:00')
  SELECT ticker, ROUND(CASE WHEN COUNT(rr) >= 2 THEN STDDEV_POP(rr) END, 8) AS vol FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM x) y WHERE k <= 20 GROUP BY ticker""")
def volatility_as_of(spark, sf):
    rows = fixture.universe(spark, sf).volatilities().where(F.col("date") <= F.lit(DAY).cast("timestamp_ntz"))
    return rows.groupBy("ticker").agg(F.round(F.max_by("vol", "date"), 8).alias("vol"))


# Signals.

_PAIRS = _RETURNS + """, j AS (SELECT a.ticker AS x, b.ticker AS y, a.lpx AS lx, b.lpx AS ly, CASE WHEN b.ret IS NOT NULL THEN a.ret END AS rx, CASE WHEN a.ret IS NOT NULL THEN b.ret END AS ry FROM ret a JOIN ret b ON a.date = b.date AND a.ticker < b.ticker)"""


@query(_PAIRS + " SELECT x, y, COUNT(*) AS overlap, ROUND(CORR(rx, ry), 7) AS correlation, ROUND(REGR_SLOPE(ly, lx), 7) AS beta, ROUND(REGR_INTERCEPT(ly, lx), 6) AS alpha FROM j GROUP BY x, y")
def pair_correlation(spark, sf):
    rows = panel.log_returns(panel.price_panel(fixture.derived_bars(spark, sf)))
    return discovery.pair_statistics(rows).select("x", "y", "overlap", r("correlation", 7), r("beta", 7), r("alpha", 6))


_SPREAD = f""", sp AS (SELECT a.date, LN(a.adj_close) AS ly, LN(b.adj_close) AS lx FROM bars a JOIN bars b ON a.date = b.date AND a.ticker = '{ANALYSED[0]}' AND b.ticker = '{ANALYSED[1]}'),
co AS (SELECT REGR_SLOPE(ly, lx) AS beta, REGR_INTERCEPT(ly, lx) AS alpha, COUNT(*) AS n FROM sp),
s AS (SELECT date, ly, lx, ly - alpha - beta * lx AS spread FROM sp, co)"""


def _legs(spark, sf) -> DataFrame:
    rows = panel.price_panel(fixture.derived_bars(spark, sf)).withColumn("l", F.ln("px"))
    y, x = (rows.where(F.col("ticker") == t).select("date", F.col("l").alias(c)) for t, c in zip(ANALYSED, "yx", strict=True))
    return y.join(x, "date").withColumn("pair", F.lit("~".join(ANALYSED)))


def _spread(spark, sf) -> DataFrame:
    legs = _legs(spark, sf)
    fit = signals.ols(legs, ["pair"])
    return legs.join(F.broadcast(fit), "pair").withColumn("spread", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))


@query(_SPREAD + " SELECT n, ROUND(beta, 7) AS beta, ROUND(alpha, 6) AS alpha FROM co")
def ols_hedge(spark, sf):
    return signals.ols(_legs(spark, sf), ["pair"]).select("n", r("beta", 7), r("alpha", 6))


@query(_SPREAD + ", l AS (SELECT spread - LAG(spread) OVER (ORDER BY date) AS d, LAG(spread) OVER (ORDER BY date) AS s FROM s), f AS (SELECT REGR_SLOPE(d, s) AS lam FROM l) SELECT ROUND(CASE WHEN lam >= 0 THEN 'inf'::DOUBLE ELSE -LN(2) / lam END, 5) AS half_life FROM f")
def half_life(spark, sf):
    return signals.half_lives(_spread(spark, sf), ["pair"], "date", "spread").select(r("half_life", 5))


@query(_PAIRS + """, c AS (SELECT x, y, COUNT(*) AS n, CORR(rx, ry) AS correlation, REGR_SLOPE(ly, lx) AS beta, REGR_INTERCEPT(ly, lx) AS alpha FROM j GROUP BY x, y),
  k AS (SELECT * FROM c WHERE n >= 60 AND ABS(correlation) >= 0.05),
  s AS (SELECT k.x, k.y, a.day_no, b.lpx - k.alpha - k.beta * a.lpx AS s FROM k JOIN ret a ON a.ticker = k.x JOIN ret b ON b.ticker = k.y AND b.date = a.date),
  l AS (SELECT x, y, s - LAG(s) OVER (PARTITION BY x, y ORDER BY day_no) AS d, LAG(s) OVER (PARTITION BY x, y ORDER BY day_no) AS s FROM s),
  f AS (SELECT x, y, REGR_SLOPE(d, s) AS lam FROM l GROUP BY x, y)
  SELECT k.x, k.y, k.n AS overlap, ROUND(k.correlation, 6) AS correlation, ROUND(k.beta, 6) AS beta, ROUND(-LN(2) / f.lam, 4) AS half_life FROM k JOIN f ON f.x = k.x AND f.y = k.y WHERE f.lam < 0""")
def pair_screen(spark, sf):
    """Correlation, hedge ratio and half-life of every pair of tickers: the relational part of discovery."""
    from barspan.tables import kept

    rows = kept(panel.log_returns(panel.price_panel(fixture.derived_bars(spark, sf))), "returns")
    stats = discovery.pair_statistics(rows).where((F.col("overlap") >= discovery.MIN_OVERLAP) & (F.abs("correlation") >= 0.05))
    x, y = (rows.select("date", F.col("ticker").alias(c), F.col("lpx").alias(f"l{c}")) for c in "xy")
    spread = stats.join(x, "x").join(y, ["y", "date"]).withColumn("spread", F.col("ly") - F.col("alpha") - F.col("beta") * F.col("lx"))
    speeds = signals.half_lives(spread, ["x", "y"], "date", "spread")
    return stats.join(speeds, ["x", "y"]).where(F.col("half_life") < float("inf")).select("x", "y", "overlap", r("correlation", 6), r("beta", 6), r("half_life", 4)).orderBy(F.desc(F.abs("correlation")), "x", "y")


_ROLLED = _SPREAD + """, z AS (SELECT date, CASE WHEN COUNT(spread) OVER v = 20 THEN (spread - AVG(spread) OVER v) / NULLIF(STDDEV_POP(spread) OVER v, 0) END AS z FROM s WINDOW v AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query(_ROLLED + " SELECT date, ROUND(z, 6) AS z FROM z")
def rolling_zscore(spark, sf):
    return signals.rolling_zscore(_spread(spark, sf), 20, ["pair"]).select("date", r("z", 6))


@query(_ROLLED + """, q AS (SELECT date, ROUND(z, 6) AS z, ROW_NUMBER() OVER (ORDER BY date) AS n FROM z),
  st(n, date, z, state) AS (SELECT n, date, z, CASE WHEN z <= -1 THEN 1 WHEN z >= 1 THEN -1 ELSE 0 END FROM q WHERE n = 1
   UNION ALL SELECT q.n, q.date, q.z, CASE WHEN q.z IS NULL THEN st.state WHEN st.state = 0 THEN CASE WHEN q.z <= -1 THEN 1 WHEN q.z >= 1 THEN -1 ELSE 0 END WHEN st.state * q.z >= -0.25 OR st.state * q.z <= -2 THEN 0 ELSE st.state END FROM st JOIN q ON q.n = st.n + 1)
  SELECT date, z, CAST(state AS BIGINT) AS state FROM st""")
def positions(spark, sf):
    rows = signals.rolling_zscore(_spread(spark, sf), 20, ["pair"]).select("pair", "date", r("z", 6))
    return signals.position_scan(rows, ["pair"], params=signals.SignalParams(**TRADE)).select("date", "z", "state")


_KALMAN = _SPREAD + """, q AS (SELECT date, ly AS y, lx AS x, ROW_NUMBER() OVER (ORDER BY date) AS n FROM s),
  kf(n, date, b, a, p00, p01, p10, p11, e, sd) AS (
    SELECT CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
    UNION ALL SELECT n, date, b + g0 * e, a + g1 * e, c00 - g0 * (x * c00 + p10), p01 - g0 * (x * p01 + c11), p10 - g1 * (x * c00 + p10), c11 - g1 * (x * p01 + c11), e, sd FROM (
      SELECT q.n, q.date, q.x, kf.b, kf.a, kf.p01, kf.p10, kf.p00 + 1e-4 / 0.9999 AS c00, kf.p11 + 1e-4 / 0.9999 AS c11, q.y - (q.x * kf.b + kf.a) AS e,
        (q.x * (kf.p00 + 1e-4 / 0.9999) + kf.p10) * q.x + (q.x * kf.p01 + kf.p11 + 1e-4 / 0.9999) + 1e-3 AS ss,
        SQRT((q.x * (kf.p00 + 1e-4 / 0.9999) + kf.p10) * q.x + (q.x * kf.p01 + kf.p11 + 1e-4 / 0.9999) + 1e-3) AS sd,
        ((kf.p00 + 1e-4 / 0.9999) * q.x + kf.p01) / ((q.x * (kf.p00 + 1e-4 / 0.9999) + kf.p10) * q.x + (q.x * kf.p01 + kf.p11 + 1e-4 / 0.9999) + 1e-3) AS g0,
        (kf.p10 * q.x + kf.p11 + 1e-4 / 0.9999) / ((q.x * (kf.p00 + 1e-4 / 0.9999) + kf.p10) * q.x + (q.x * kf.p01 + kf.p11 + 1e-4 / 0.9999) + 1e-3) AS g1
      FROM kf JOIN q ON q.n = kf.n + 1) step)
  SELECT date, ROUND(b, 6) AS beta, ROUND(a, 5) AS alpha, ROUND(e, 6) AS spread, ROUND(sd, 6) AS innovation_std FROM kf WHERE n > 0"""


@query(_KALMAN)
def kalman_hedge(spark, sf):
    rows = signals.kalman_scan(_legs(spark, sf), ["pair"])
    return rows.select("date", r("beta", 6), r("alpha", 5), r("spread", 6), r("innovation_std", 6))


@query(_KALMAN)
def kalman_hedge_native(spark, sf):
    """The same scan as one Catalyst fold."""
    rows = signals.kalman_native(_legs(spark, sf), ["pair"])
    return rows.select("date", r("beta", 6), r("alpha", 5), r("spread", 6), r("innovation_std", 6))


@query()
def engle_granger(spark, sf):
    """Statistic and p value of the pairs that correlate."""
    prices = panel.price_panel(fixture.derived_bars(spark, sf))
    return discovery.discover(prices, min_correlation=0.05, max_pvalue=1.0, min_half_life=0.0, max_half_life=1e9).select("y", "x", r("stat", 6), r("pvalue", 6))


def _johansen_sql() -> str:
    """Two series by determinants: the statistics are those of a 2 x 2 matrix, the product of two inverses and two covariances."""
    cols = ("d0", "d1", "p0", "p1", "k0", "k1")
    cov = {tuple(sorted((a, b))): f"COVAR_POP({a}, {b}) AS {''.join(sorted((a, b)))}" for a in cols for b in cols}
    c = lambda a, b: "".join(sorted((a, b)))
    det = f"({c('p0', 'p0')} * {c('p1', 'p1')} - {c('p0', 'p1')} ** 2)"
    # What the past move explains goes: S_ab - S_ap * inverse(S_pp) * S_pb.
    part = lambda a, b: f"{c(a, b)} - ({c(a, 'p0')} * ({c('p1', 'p1')} * {c('p0', b)} - {c('p0', 'p1')} * {c('p1', b)}) + {c(a, 'p1')} * ({c('p0', 'p0')} * {c('p1', b)} - {c('p0', 'p1')} * {c('p0', b)})) / {det}"
    names = (("d0", "d0"), ("d0", "d1"), ("d1", "d1"), ("k0", "k0"), ("k0", "k1"), ("k1", "k1"), ("d0", "k0"), ("d0", "k1"), ("d1", "k0"), ("d1", "k1"))
    left = ", ".join(f"{part(a, b)} AS r{a}{b}" for a, b in names)
    # Rows of inverse(S00) * S0k, then of inverse(Skk) * Sk0 * that.
    inner = ", ".join(f"(rd1d1 * rd0k{j} - rd0d1 * rd1k{j}) / d00 AS u0{j}, (rd0d0 * rd1k{j} - rd0d1 * rd0k{j}) / d00 AS u1{j}" for j in (0, 1))
    outer = ", ".join(f"rd0k{i} * u0{j} + rd1k{i} * u1{j} AS v{i}{j}" for i in (0, 1) for j in (0, 1))
    last = ", ".join(f"(rk1k1 * v0{j} - rk0k1 * v1{j}) / dkk AS m0{j}, (rk0k0 * v1{j} - rk0k1 * v0{j}) / dkk AS m1{j}" for j in (0, 1))
    return f""", a AS (SELECT x.date, LN(x.adj_close) AS l0, LN(y.adj_close) AS l1 FROM bars x JOIN bars y ON y.date = x.date AND y.ticker = 'AO' WHERE x.ticker = 'AF'),
b AS (SELECT date, l0 - LAG(l0) OVER w AS d0, l1 - LAG(l1) OVER w AS d1, LAG(l0) OVER w AS k0, LAG(l1) OVER w AS k1 FROM a WINDOW w AS (ORDER BY date)),
c AS (SELECT d0, d1, LAG(d0) OVER w AS p0, LAG(d1) OVER w AS p1, k0, k1 FROM b WINDOW w AS (ORDER BY date)),
s AS (SELECT COUNT(*) AS n, {', '.join(cov.values())} FROM c WHERE p0 IS NOT NULL),
r AS (SELECT n, {left} FROM s),
i AS (SELECT *, rd0d0 * rd1d1 - rd0d1 ** 2 AS d00, rk0k0 * rk1k1 - rk0k1 ** 2 AS dkk FROM r),
ju AS (SELECT *, {inner} FROM i), jv AS (SELECT *, {outer} FROM ju), m AS (SELECT n, {last} FROM jv),
e AS (SELECT *, (m00 + m11 + SQRT((m00 - m11) ** 2 + 4 * m01 * m10)) / 2 AS e0, (m00 + m11 - SQRT((m00 - m11) ** 2 + 4 * m01 * m10)) / 2 AS e1 FROM m),
t AS (SELECT *, -n * (LN(1 - e0) + LN(1 - e1)) AS t0, -n * LN(1 - e1) AS t1 FROM e)
SELECT CAST((CASE WHEN t0 > 15.4943 THEN 1 ELSE 0 END) + (CASE WHEN t1 > 3.8415 THEN 1 ELSE 0 END) AS INTEGER) AS rank, ROUND(t0, 4) AS trace_0, ROUND(t1, 4) AS trace_1, ROUND((e0 - m00) / m01, 5) AS hedge FROM t"""


@query(_johansen_sql())
def johansen(spark, sf):
    found = discovery.johansen_test(panel.price_panel(fixture.derived_bars(spark, sf)), ["AF", "AO"])
    return found.select("rank", r("trace_0", 4, F.col("trace")[0]), r("trace_1", 4, F.col("trace")[1]), r("hedge", 5, F.col("hedge")[1]))


@query()
def discover_pairs(spark, sf):
    found = discovery.discover(panel.price_panel(fixture.derived_bars(spark, sf)), min_correlation=0.3)
    return found.select("y", "x", r("beta", 6), r("correlation", 6), r("pvalue", 8), r("half_life", 5)).orderBy("pvalue", "x", "y")


# Backtests.

_COST = "GREATEST(1.0, 0.005 * ABS({q})) + 2e-4 * {p} * ABS({q}) + COALESCE(CASE WHEN {v} > 0 AND {a} > 0 THEN 0.1 * {v} * SQRT(ABS({q}) / {a}) * {p} * ABS({q}) END, 0)"
_FEATURES = """, x AS (SELECT date, ticker, adj_close, volume, open * adj_close / close AS adj_open, LN(adj_close) - LAG(LN(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS rr FROM bars),
ft AS (SELECT date, ticker, adj_close, adj_open, AVG(volume) OVER w20 AS adv, CASE WHEN COUNT(rr) OVER w20 >= 2 THEN STDDEV_POP(rr) OVER w20 END AS vol
  FROM x WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
clock AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS day_no FROM (SELECT DISTINCT date FROM bars) d)"""


@query(_FEATURES + f" SELECT date, ticker, ROUND({_COST.format(q='1000', p='adj_open', v='vol', a='adv')}, 6) AS cost FROM ft")
def transaction_cost(spark, sf):
    """What a thousand shares cost at each day's open."""
    cost = backtest.CostModel().column(F.lit(1000.0), F.col("adj_open"), F.col("vol"), F.col("adv"))
    return fixture.universe(spark, sf).features().select("date", "ticker", F.round(cost, 6).alias("cost"))


_HELD = ["AF", "NF", "RF"]
_BUY = _FEATURES + f""", o AS (SELECT date AS d0 FROM (SELECT date, COUNT(*) AS n FROM (SELECT c.date, t.ticker FROM clock c JOIN (SELECT ticker, MIN(date) AS a, MAX(date) AS b FROM bars WHERE ticker IN ('AF', 'NF', 'RF') GROUP BY ticker) t ON c.date BETWEEN t.a AND t.b) e GROUP BY date) g WHERE n = 3 ORDER BY date LIMIT 1),
pr AS (SELECT b.ticker, ARG_MAX(b.adj_close, b.date) AS p FROM bars b, o WHERE b.date <= o.d0 AND b.ticker IN ('AF', 'NF', 'RF') GROUP BY b.ticker),
fl AS (SELECT ft.date, c.day_no, ft.ticker, 100000.0 / pr.p AS quantity, ft.adj_open AS price, {_COST.format(q='(100000.0 / pr.p)', p='ft.adj_open', v='ft.vol', a='ft.adv')} AS cost
  FROM o JOIN clock c0 ON c0.date = o.d0 JOIN clock c ON c.day_no = c0.day_no + 1 JOIN ft ON ft.date = c.date JOIN pr ON pr.ticker = ft.ticker)"""
_BUY_EQUITY = _BUY + """, eq AS (SELECT c.date, 1000000.0 - COALESCE(SUM(f.quantity * f.price), 0) + COALESCE(SUM(f.quantity * b.adj_close), 0) - COALESCE(SUM(f.cost), 0) AS equity
  FROM clock c LEFT JOIN fl f ON f.day_no <= c.day_no LEFT JOIN bars b ON b.date = c.date AND b.ticker = f.ticker GROUP BY c.date)"""


def _held(spark, sf) -> backtest.BacktestResult:
    return backtest.run_buy_and_hold(fixture.universe(spark, sf), _HELD, 300_000.0)


@query(_BUY + " SELECT date, ticker, ROUND(quantity, 6) AS quantity, ROUND(price, 6) AS price, ROUND(cost, 6) AS cost FROM fl")
def buy_and_hold_fills(spark, sf):
    return _held(spark, sf).fills.select("date", "ticker", r("quantity", 6), r("price", 6), r("cost", 6))


@query(_BUY_EQUITY + " SELECT date, ROUND(equity, 4) AS equity FROM eq")
def buy_and_hold_equity(spark, sf):
    return _held(spark, sf).equity.select("date", r("equity", 4))


_RETS = _BUY_EQUITY + ", rt AS (SELECT date, equity, equity / LAG(equity) OVER (ORDER BY date) - 1 AS ret FROM eq)"


@query(_RETS + " SELECT date, ROUND(ret, 8) AS ret FROM rt WHERE ret IS NOT NULL")
def equity_returns(spark, sf):
    return _held(spark, sf).returns().select("date", r("ret"))


@query(_RETS + " SELECT ROUND(SQRT(252) * AVG(ret) / STDDEV_SAMP(ret), 6) AS sharpe FROM rt")
def sharpe(spark, sf):
    return backtest.sharpe(_held(spark, sf).returns()).select(r("sharpe", 6))


@query(_BUY_EQUITY + " SELECT date, ROUND(equity / MAX(equity) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 8) AS drawdown FROM eq")
def drawdown(spark, sf):
    return backtest.drawdowns(_held(spark, sf).equity).select("date", r("drawdown"))


@query(_RETS + """, dd AS (SELECT MIN(equity / m - 1) AS d FROM (SELECT equity, MAX(equity) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM eq) e)
  SELECT ROUND(ARG_MAX(equity, date) / ARG_MIN(equity, date) - 1, 8) AS total_return, ROUND(SQRT(252) * AVG(ret) / STDDEV_SAMP(ret), 6) AS sharpe, (SELECT ROUND(d, 8) FROM dd) AS max_drawdown, ROUND(STDDEV_SAMP(ret) * SQRT(252), 8) AS volatility,
    ROUND(AVG(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END), 8) AS win_rate, (SELECT ROUND(SUM(cost), 6) FROM fl) AS total_costs, (SELECT COUNT(*) FROM fl) AS n_fills, COUNT(*) AS n_days FROM rt""")
def tearsheet_stats(spark, sf):
    s = _held(spark, sf).stats()
    return s.select(r("total_return"), r("sharpe", 6), r("max_drawdown"), r("volatility"), r("win_rate"), r("total_costs", 6), "n_fills", "n_days")


@query(_RETS + ", m AS (SELECT COUNT(ret) AS n, AVG(ret) AS mu FROM rt), c AS (SELECT AVG((ret - mu) ** 2) AS m2, AVG((ret - mu) ** 3) AS m3, AVG((ret - mu) ** 4) AS m4 FROM rt, m WHERE ret IS NOT NULL) SELECT n, ROUND(m3 / m2 ** 1.5, 5) AS skew, ROUND(m4 / m2 ** 2, 4) AS kurtosis FROM m, c")
def moments(spark, sf):
    return _held(spark, sf).returns().agg(F.count("ret").alias("n"), F.round(F.skewness("ret"), 5).alias("skew"), F.round(F.kurtosis("ret") + 3, 4).alias("kurtosis"))


PAIRS = (("AO", "AF"), ("RO", "RF"))
GRID = {"entry": (0.75, 1.0, 1.5), "delta": (1e-6, 1e-5)}


def _pair_sql(runs: list[tuple]) -> str:
    """fl (fills) and eq (equity) of runs (run, y, x, entry, exit, stop, delta): the filter and the machine as one recursion."""
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in runs)
    # Prior covariances, the surprise and its variance: once each.
    prior = "kf.p00 + r.d AS c00, kf.p11 + r.d AS c11, q.ly - (q.lx * kf.b + kf.a) AS e"
    return _FEATURES + f""", r AS (SELECT *, dl / (1 - dl) AS d FROM (VALUES {values}) v(run, ty, tx, en, ex, sp, dl)),
q AS (SELECT r.run, a.date, LN(a.adj_close) AS ly, LN(b.adj_close) AS lx, ROW_NUMBER() OVER (PARTITION BY r.run ORDER BY a.date) AS n FROM r JOIN bars a ON a.ticker = r.ty JOIN bars b ON b.ticker = r.tx AND b.date = a.date),
kf(run, n, date, b, a, p00, p01, p10, p11, state) AS (
  SELECT run, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM r
  UNION ALL
  SELECT run, n, date, b + g0 * e, a + g1 * e, c00 - g0 * (lx * c00 + p10), p01 - g0 * (lx * p01 + c11), p10 - g1 * (lx * c00 + p10), c11 - g1 * (lx * p01 + c11),
    CASE WHEN state = 0 THEN CASE WHEN z <= -en THEN 1 WHEN z >= en THEN -1 ELSE 0 END WHEN state * z >= -ex OR state * z <= -sp THEN 0 ELSE state END
  FROM (SELECT *, (c00 * lx + p01) / s AS g0, (p10 * lx + c11) / s AS g1, e / SQRT(s) AS z
    FROM (SELECT *, (lx * c00 + p10) * lx + (lx * p01 + c11) + 1e-3 AS s
      FROM (SELECT q.run, q.n, q.date, q.lx, kf.b, kf.a, kf.p01, kf.p10, kf.state, r.en, r.ex, r.sp, {prior} FROM kf JOIN r ON r.run = kf.run JOIN q ON q.run = kf.run AND q.n = kf.n + 1) k0) k1) k2),
sp AS (SELECT ticker, MIN(date) AS first_date, MAX(date) AS last_date FROM bars GROUP BY ticker),
dy AS (SELECT r.run, r.ty, r.tx, c.date, c.day_no, LAST_VALUE(k.n IGNORE NULLS) OVER w AS n, LAST_VALUE(k.b IGNORE NULLS) OVER w AS beta, LAST_VALUE(k.state IGNORE NULLS) OVER w AS want,
    LAST_VALUE(y.adj_close IGNORE NULLS) OVER w AS py, LAST_VALUE(x.adj_close IGNORE NULLS) OVER w AS px
  FROM r CROSS JOIN clock c LEFT JOIN kf k ON k.run = r.run AND k.date = c.date LEFT JOIN bars y ON y.ticker = r.ty AND y.date = c.date LEFT JOIN bars x ON x.ticker = r.tx AND x.date = c.date
  WINDOW w AS (PARTITION BY r.run ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
el AS (SELECT dy.*, LAG(want, 1, 0) OVER (PARTITION BY run ORDER BY day_no) AS held FROM dy JOIN sp a ON a.ticker = ty AND date BETWEEN a.first_date AND a.last_date JOIN sp b ON b.ticker = tx AND date BETWEEN b.first_date AND b.last_date WHERE n >= 60),
tn AS (SELECT *, CASE WHEN want <> 0 THEN want * 100000.0 / py END AS qy, CASE WHEN want <> 0 THEN -want * beta * 100000.0 / px END AS qx FROM el WHERE want <> held),
tl AS (SELECT *, -LAG(qy) OVER (PARTITION BY run ORDER BY day_no) AS cy, -LAG(qx) OVER (PARTITION BY run ORDER BY day_no) AS cx FROM tn),
o AS (SELECT run, day_no, ty AS ticker, cy AS quantity, 0 AS seq FROM tl UNION ALL SELECT run, day_no, tx, cx, 1 FROM tl UNION ALL SELECT run, day_no, ty, qy, 2 FROM tl UNION ALL SELECT run, day_no, tx, qx, 3 FROM tl),
fl AS (SELECT o.run, c.date, c.day_no, o.ticker, o.quantity, ft.adj_open AS price, {_COST.format(q='o.quantity', p='ft.adj_open', v='ft.vol', a='ft.adv')} AS cost, o.seq
  FROM o JOIN clock c ON c.day_no = o.day_no + 1 JOIN ft ON ft.date = c.date AND ft.ticker = o.ticker WHERE o.quantity IS NOT NULL AND o.quantity <> 0),
ow AS (SELECT t.run, c.date, c.day_no, t.ticker, SUM(f.q) OVER (PARTITION BY t.run, t.ticker ORDER BY c.day_no) AS position
  FROM (SELECT DISTINCT run, ticker FROM fl) t CROSS JOIN clock c LEFT JOIN (SELECT run, ticker, day_no, SUM(quantity) AS q FROM fl GROUP BY run, ticker, day_no) f ON f.run = t.run AND f.ticker = t.ticker AND f.day_no = c.day_no),
va AS (SELECT ow.run, ow.day_no, SUM(ow.position * b.adj_close) AS value FROM ow JOIN bars b ON b.date = ow.date AND b.ticker = ow.ticker GROUP BY ow.run, ow.day_no),
pd AS (SELECT run, day_no, SUM(quantity * price + cost) AS paid FROM fl GROUP BY run, day_no),
eq AS (SELECT r.run, c.date, 1000000.0 - COALESCE(SUM(pd.paid) OVER (PARTITION BY r.run ORDER BY c.day_no), 0) + COALESCE(va.value, 0) AS equity
  FROM r CROSS JOIN clock c LEFT JOIN pd ON pd.run = r.run AND pd.day_no = c.day_no LEFT JOIN va ON va.run = r.run AND va.day_no = c.day_no)"""


_BOTH = _pair_sql([(n, *pair, *TRADE.values(), 1e-6) for n, pair in enumerate(PAIRS)])
_CELLS = _pair_sql([(n, "AO", "AF", e, e * 0.25, e * 2.0, d) for n, (e, d) in enumerate((e, d) for e in GRID["entry"] for d in GRID["delta"])])


def _pair_runs(spark):
    return spark.createDataFrame([(n, *pair, *TRADE.values()) for n, pair in enumerate(PAIRS)], "run int, y string, x string, entry double, exit double, stop double")


@query(_BOTH + " SELECT run, date, ticker, ROUND(quantity, 5) AS quantity, ROUND(price, 6) AS price, ROUND(cost, 5) AS cost, seq FROM fl")
def pairs_fills(spark, sf):
    found = backtest.run_pairs(fixture.universe(spark, sf), _pair_runs(spark)).fills
    return found.select("run", "date", "ticker", r("quantity", 5), r("price", 6), r("cost", 5), "seq")


@query(_BOTH + " SELECT run, date, ROUND(equity, 3) AS equity FROM eq")
def pairs_equity(spark, sf):
    return backtest.run_pairs(fixture.universe(spark, sf), _pair_runs(spark)).equity.select("run", "date", r("equity", 3))


_FIRST = _pair_sql([(0, *PAIRS[0], *TRADE.values(), 1e-6)])


def _loop(spark, sf):
    strategy = backtest.PairsStrategy(*PAIRS[0], 200_000.0, params=signals.SignalParams(**TRADE))
    return backtest.LoopEngine(fixture.universe(spark, sf), strategy, backtest.Portfolio(1_000_000.0), simulator=backtest.NextOpen()).run().frames(spark)


@query(_FIRST + " SELECT date, ticker, ROUND(quantity, 5) AS quantity, ROUND(price, 6) AS price, ROUND(cost, 5) AS cost FROM fl")
def pairs_loop(spark, sf):
    """The first pair day by day: the same fills as the plan's."""
    return _loop(spark, sf).fills.select("date", "ticker", r("quantity", 5), r("price", 6), r("cost", 5))


@query(_FIRST + " SELECT date, ROUND(equity, 3) AS equity FROM eq")
def pairs_loop_equity(spark, sf):
    """What the portfolio of the day-by-day engine is worth on each day."""
    return _loop(spark, sf).equity.select("date", r("equity", 3))


@query(""", n AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM bars) d), c AS (SELECT MAX(n) AS c FROM n)
  SELECT CAST(k AS INTEGER) AS "window", a.date AS train_start, b.date AS train_end, d.date AS test_start, e.date AS test_end FROM c, range(0, 1000) w(k)
    JOIN n a ON a.n = k * 125 + 1 JOIN n b ON b.n = k * 125 + 250 JOIN n d ON d.n = k * 125 + 251 JOIN n e ON e.n = k * 125 + 375""")
def walk_forward_windows(spark, sf):
    return walkforward.walk_forward_windows(fixture.universe(spark, sf).trading_days(), 250, 125)


@query()
def walk_forward(spark, sf):
    u = fixture.universe(spark, sf)
    done = walkforward.run_walk_forward(u, walkforward.walk_forward_windows(u.trading_days(), 500, 250), **TRADE)
    return done.table().select("window", "test_start", "y", "x", r("total_return"), r("sharpe", 6), "n_fills")


@query(_CELLS + ", rt AS (SELECT run, equity / LAG(equity) OVER (PARTITION BY run ORDER BY date) - 1 AS ret FROM eq) SELECT r.run, r.en AS entry, r.dl AS delta, ROUND(COALESCE(SQRT(252) * AVG(ret) / NULLIF(STDDEV_SAMP(ret), 0), 0), 5) AS metric FROM rt JOIN r ON r.run = rt.run GROUP BY r.run, r.en, r.dl")
def sensitivity_grid(spark, sf):
    cells, _ = walkforward.pair_grid(fixture.universe(spark, sf), "AO", "AF", GRID)
    return cells.select("run", "entry", "delta", r("metric", 5))


def _phi(x: str) -> str:
    """The normal distribution function by its series of odd powers over odd double factorials."""
    return f"CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE 0.5 + EXP(-(({x}) * ({x})) / 2) / SQRT(2 * PI()) * SIGN({x}) * list_sum(list_transform(range(0, 200), lambda k: EXP((2 * k + 1) * LN(GREATEST(ABS({x}), 1e-300)) + LN(PI()) / 2 - (k + 1) * LN(2) - LGAMMA(k + 1.5)))) END"


_MOMENTS = "COUNT(ret) AS n, AVG(ret) AS mu, STDDEV_SAMP(ret) AS sd"
#: Normal quantiles of 1 - 1/6 and 1 - 1/(6 e), for the six cells of the grid.
_QUANTILES = (0.9674215661017014, 1.543842550450144)


@query(_RETURNS + f""", m AS (SELECT ticker, {_MOMENTS} FROM ret WHERE ret IS NOT NULL GROUP BY ticker),
c AS (SELECT m.ticker, m.n, m.mu / m.sd AS sr, AVG((ret - mu) ** 3) / AVG((ret - mu) ** 2) ** 1.5 AS skew, AVG((ret - mu) ** 4) / AVG((ret - mu) ** 2) ** 2 AS kurt FROM ret JOIN m ON m.ticker = ret.ticker WHERE ret IS NOT NULL GROUP BY m.ticker, m.n, m.mu, m.sd),
z AS (SELECT ticker, sr * SQRT(n - 1) / SQRT(1 - skew * sr + (kurt - 1) / 4 * sr ** 2) AS z FROM c)
SELECT ticker, ROUND({_phi('z')}, 7) AS psr FROM z""")
def probabilistic_sharpe(spark, sf):
    """Chance that each ticker's true ratio of daily returns is above zero: one row of moments a ticker."""
    returns = panel.log_returns(panel.price_panel(fixture.derived_bars(spark, sf))).where("ret is not null")
    moments = returns.groupBy("ticker").agg(F.count("ret").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    found = [(m.ticker, round(distributions.probabilistic_sharpe_ratio(m.sr, 0.0, m.n, skew=m.skew, kurtosis=m.kurt), 7)) for m in moments.collect()]
    return spark.createDataFrame(found, "ticker string, psr double")


@query(_CELLS + f""", rt AS (SELECT run, date, equity / LAG(equity) OVER (PARTITION BY run ORDER BY date) - 1 AS ret FROM eq),
m AS (SELECT run, {_MOMENTS}, COALESCE(AVG(ret) / NULLIF(STDDEV_SAMP(ret), 0), 0) AS sr FROM rt WHERE ret IS NOT NULL GROUP BY run),
l AS (SELECT STDDEV_SAMP(sr) * ((1 - 0.5772156649015329) * {_QUANTILES[0]}::DOUBLE + 0.5772156649015329 * {_QUANTILES[1]}::DOUBLE) AS luck, MAX(sr) AS best, COUNT(*) AS trials FROM m),
c AS (SELECT m.n, AVG((ret - mu) ** 3) / AVG((ret - mu) ** 2) ** 1.5 AS skew, AVG((ret - mu) ** 4) / AVG((ret - mu) ** 2) ** 2 AS kurt FROM rt JOIN m ON m.run = rt.run JOIN l ON l.best = m.sr WHERE ret IS NOT NULL GROUP BY m.n),
z AS (SELECT *, (best - luck) * SQRT(n - 1) / SQRT(1 - skew * best + (kurt - 1) / 4 * best ** 2) AS z FROM c, l)
SELECT ROUND({_phi('z')}, 6) AS dsr, ROUND(luck, 8) AS sr_0, ROUND(best, 8) AS best_sharpe, CAST(trials AS INTEGER) AS n_trials FROM z""")
def deflated_sharpe(spark, sf):
    """The best cell of a grid of per-period ratios, held against luck."""
    cells, result = walkforward.pair_grid(fixture.universe(spark, sf), "AO", "AF", GRID)
    rows = cells.collect()
    best = max(rows, key=lambda c: c.metric)
    returns = [x.ret for x in result.returns().where(F.col("run") == best.run).orderBy("date").collect()]
    found = distributions.deflated_sharpe_ratio([c.metric / distributions.DAYS**0.5 for c in rows], returns)
    return spark.createDataFrame([(round(found.dsr, 6), round(found.sr_0, 8), round(found.best_sharpe, 8), found.n_trials)], "dsr double, sr_0 double, best_sharpe double, n_trials int")


@query()
def synthetic_bars(spark, sf):
    """Seeded bars through Spark's data source interface."""
    from barspan.sources.bar_sources import SyntheticBars

    spark.dataSource.register(SyntheticBars)
    return spark.read.format("synthetic_bars").option("n", 250).option("seed", 42).load()
