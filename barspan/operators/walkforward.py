"""Rolling out-of-sample tests and parameter grids: all windows, or all cells, in one job."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspan.operators import backtest
from barspan.operators.discovery import discover
from barspan.operators.universe import PointInTimeUniverse
from barspan.tables import kept


def walk_forward_windows(days: DataFrame, train_days: int, test_days: int, step_days: int | None = None) -> DataFrame:
    """window (from 0), train_start, train_end, test_start, test_end of the windows that fit whole into the days."""
    step = test_days if step_days is None else step_days
    if min(train_days, test_days, step) <= 0:
        raise ValueError("train, test and step must be positive")
    numbered = days.select("date", F.row_number().over(Window.orderBy("date")).alias("n"))
    last = numbered.agg(F.max("n").alias("last"))
    starts = last.where(F.col("last") >= train_days + test_days).select(F.explode(F.sequence(F.lit(0), F.col("last") - (train_days + test_days), F.lit(step))).alias("at"))
    edges = (("train_start", 1), ("train_end", train_days), ("test_start", train_days + 1), ("test_end", train_days + test_days))
    out = starts.withColumn("window", (F.col("at") / step).cast("int"))
    for name, shift in edges:
        out = out.join(numbered.select(F.col("n").alias("_n"), F.col("date").alias(name)), F.col("at") + shift == F.col("_n")).drop("_n")
    return out.select("window", *(n for n, _ in edges))


@dataclass
class WalkForward:
    """windows with their pair (null without one), and the backtests of those that have one; ``run`` is the window."""

    windows: DataFrame
    result: backtest.BacktestResult

    def table(self) -> DataFrame:
        s = self.result.stats().withColumnRenamed("run", "window")
        return self.windows.join(s, "window", "left").orderBy("window")

    def combined_sharpe(self) -> float:
        """Of the returns of all windows that traded a pair, one after the other; windows without a pair add nothing."""
        row = backtest.sharpe(self.result.returns().withColumn("all", F.lit(1)), ("all",)).first()
        return row.sharpe if row else 0.0


def train_slices(universe: PointInTimeUniverse, windows: DataFrame) -> DataFrame:
    """window, date, ticker, px: each window's training dates, of the members at its end."""
    prices = universe._prices.where("px is not null")
    m = universe.membership.intervals
    members = windows.join(m, F.col("train_end").between(m.first_date, m.last_date)).select("window", "ticker", "train_start", "train_end")
    return members.join(prices, "ticker").where(F.col("date").between(F.col("train_start"), F.col("train_end"))).select("window", "date", "ticker", "px")


def run_walk_forward(universe: PointInTimeUniverse, windows: DataFrame, *, cash: float = 1_000_000.0, notional: float = 200_000.0, min_correlation: float = 0.3, max_pvalue: float = 0.1, max_half_life: float = 252.0, **strategy) -> WalkForward:
    """Pick the best pair of each training slice and trade it over the test days with fresh cash."""
    windows = kept(windows, "windows")
    found = discover(kept(train_slices(universe, windows), "slices"), clock=universe.trading_days(), keys=("window",), min_correlation=min_correlation, max_pvalue=max_pvalue, max_half_life=max_half_life)
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("window").orderBy("pvalue", "x", "y"))).where("place = 1").drop("place")
    chosen = kept(windows.join(best, "window", "left"), "chosen")
    runs = chosen.where("y is not null").select(F.col("window").alias("run"), "y", "x", F.col("test_start").alias("start"), F.col("test_end").alias("end"), F.lit(float(notional)).alias("notional"), *(F.lit(v).alias(k) for k, v in strategy.items()))
    return WalkForward(chosen, backtest.run_pairs(universe, runs, cash=cash))


def sensitivity_grid(grid: dict[str, Sequence], run_fn: Callable[..., float], *, metric_name: str = "metric") -> pd.DataFrame:
    """The metric of each combination, the last key varying fastest; for metrics that are Python functions."""
    if not grid or any(not len(v) for v in grid.values()):
        raise ValueError("the grid is empty")
    rows = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return pd.DataFrame([row | {metric_name: run_fn(**row)} for row in rows])


def grid_frame(spark: SparkSession, grid: dict[str, Sequence]) -> DataFrame:
    """run (from 0) and a column per setting: every combination, the last key varying fastest."""
    if not grid or any(not len(v) for v in grid.values()):
        raise ValueError("the grid is empty")
    rows = [(n, *map(float, values)) for n, values in enumerate(itertools.product(*grid.values()))]
    return spark.createDataFrame(rows, "run int, " + ", ".join(f"`{k}` double" for k in grid))


def pair_grid(universe: PointInTimeUniverse, y: str, x: str, grid: dict[str, Sequence], *, cash: float = 1_000_000.0, notional: float = 200_000.0, exit_ratio: float = 0.25, stop_ratio: float = 2.0) -> tuple[DataFrame, backtest.BacktestResult]:
    """(cells with their Sharpe ratio, the backtests): exit and stop follow entry where the grid does not set them."""
    cells = grid_frame(universe._prices.sparkSession, grid)
    runs = cells.withColumn("y", F.lit(y)).withColumn("x", F.lit(x)).withColumn("notional", F.lit(float(notional)))
    if "entry" in grid:
        runs = runs.withColumns({k: F.col("entry") * r for k, r in (("exit", exit_ratio), ("stop", stop_ratio)) if k not in grid})
    result = backtest.run_pairs(universe, runs, cash=cash)
    return cells.join(backtest.sharpe(result.returns()).withColumnRenamed("sharpe", "metric"), "run", "left").na.fill(0.0, ["metric"]).orderBy("run"), result
