"""Daily bars of six tickers derived from ``lineitem``: two pairs are cointegrated, dates are missing, one ticker splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.operators.universe import PointInTimeUniverse

#: One text for Spark and for the comparison engine.
BARS_SQL = """
SELECT CAST(date AS TIMESTAMP) AS date, ticker, CAST(adj_open * k AS DOUBLE) AS open,
       CAST(GREATEST(adj_open, adj_close) * k * 1.001 AS DOUBLE) AS high,
       CAST(LEAST(adj_open, adj_close) * k * 0.999 AS DOUBLE) AS low,
       CAST(adj_close * k AS DOUBLE) AS close, adj_close, volume
FROM (
  SELECT *, COALESCE(LAG(adj_close) OVER (PARTITION BY ticker ORDER BY date), adj_close) AS adj_open
  FROM (
    SELECT date, ticker, CAST(volume AS DOUBLE) AS volume, ROUND(EXP(lpx), 8) AS adj_close,
           CASE WHEN ticker = 'NO' AND date < DATE '1998-01-01' THEN 2.0 ELSE 1.0 END AS k
    FROM (
      SELECT date, tk AS ticker, volume, lw AS lpx FROM w WHERE tk IN ('AF', 'NF', 'NO', 'RF')
      UNION ALL
      SELECT r.date, 'AO', r.volume, 0.2 + 1.3 * a.lw + 0.3 * r.m FROM w r JOIN w a ON a.date = r.date AND a.tk = 'AF' WHERE r.tk = 'AO'
      UNION ALL
      SELECT r.date, 'RO', r.volume, -0.1 + 0.8 * a.lw + 0.3 * r.m FROM w r JOIN w a ON a.date = r.date AND a.tk = 'RF' WHERE r.tk = 'RO') lp) f) g
"""
WALKS_SQL = """
u AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS tk,
         ROUND((AVG(l_discount) - 0.05) / 0.03 * SQRT(COUNT(*)) / 2, 9) AS u,
         SUM(l_quantity) * 1e4 AS volume
  FROM lineitem GROUP BY 1, 2),
w AS (
  SELECT date, tk, volume,
         LN(100) + 0.01 * SUM(u) OVER (PARTITION BY tk ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lw,
         AVG(u) OVER (PARTITION BY tk ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m
  FROM u)"""
#: The same bars with one fault for each rule.
DIRTY_SQL = """
SELECT date, ticker, open,
  CASE WHEN ticker = 'RF' AND n = 1 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN ticker = 'NF' AND n = 1 THEN -1 ELSE close END AS close,
  CASE WHEN ticker = 'NO' AND date >= TIMESTAMP '1998-01-01 00:00:00' THEN adj_close / 2 ELSE adj_close END AS adj_close,
  CASE WHEN ticker = 'NF' AND n = 2 THEN -5 ELSE volume END AS volume
FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars
  UNION ALL
  SELECT *, 99 AS n FROM bars WHERE ticker = 'AF' AND date >= TIMESTAMP '1996-03-01 00:00:00' AND date < TIMESTAMP '1996-04-01 00:00:00') x
WHERE NOT (ticker = 'AO' AND date >= TIMESTAMP '1997-02-01 00:00:00' AND date < TIMESTAMP '1997-03-01 00:00:00')
"""


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    rows = spark.sql(f"WITH {WALKS_SQL.replace('FROM lineitem', 'FROM {items}')} {BARS_SQL}", items=items)
    return rows.withColumn("date", F.col("date").cast("timestamp_ntz"))


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = DIRTY_SQL.replace("FROM bars", "FROM {bars}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    return spark.sql(text, bars=derived_bars(spark, sf_dir))


def universe(spark: SparkSession, sf_dir: str) -> PointInTimeUniverse:
    return PointInTimeUniverse.from_bars(derived_bars(spark, sf_dir)).keep()
