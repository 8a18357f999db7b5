"""Which pairs are worth trading: correlation, then cointegration, then speed of reversion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.functions import unit_root
from barspan.operators import panel as panels
from barspan.operators.signals import half_life
from barspan.tables import kept

#: Dates that both tickers of a pair must share.
MIN_OVERLAP = 60
#: Tickers of a block whose series meet those of another block in one task.
BLOCK = 64


@dataclass(frozen=True)
class PairCandidate:
    y: str
    x: str
    beta: float
    correlation: float
    pvalue: float
    half_life: float

    def __str__(self) -> str:
        return f"{self.y}~{self.x} beta={self.beta:.3f} corr={self.correlation:.2f} p={self.pvalue:.4f} hl={self.half_life:.1f}"


def pair_statistics(returns: DataFrame, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """keys, x, y (x before y), overlap, correlation of returns, and the regression of log prices.

    ``returns`` is the output of ``log_returns``. Up to ``block`` tickers, it is one aggregate over a join by date, dealt by date and
    pre-aggregated there: dates times pairs of rows. More tickers are dealt into blocks, and each pair of blocks is one product of
    matrices of dates by tickers, so that a bar goes once to each block, and what leaves are pairs.
    """
    tickers = returns.agg(F.count_distinct("ticker")).first()[0]
    if tickers > block:
        return _in_blocks(returns, keys, -(-tickers // block))
    fields = [*keys, "date", "ticker", "lpx", "ret"]
    a, b = returns.select(*fields).alias("a"), returns.select(*fields).alias("b")
    same = F.col("a.date") == F.col("b.date")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = a.join(b, same & (F.col("a.ticker") < F.col("b.ticker")))
    both = both.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.ticker").alias("x"), F.col("b.ticker").alias("y"), F.col("a.lpx").alias("lx"), F.col("b.lpx").alias("ly"), F.col("a.ret").alias("rx"), F.col("b.ret").alias("ry"))
    both = both.where("lx is not null and ly is not null")
    full = F.col("rx").isNotNull() & F.col("ry").isNotNull()
    rx, ry = F.when(full, F.col("rx")), F.when(full, F.col("ry"))
    corr = F.try_divide(F.covar_pop(rx, ry), F.stddev_pop(rx) * F.stddev_pop(ry))
    return both.groupBy(*keys, "x", "y").agg(F.count("*").alias("overlap"), corr.alias("correlation"), F.regr_slope("ly", "lx").alias("beta"), F.regr_intercept("ly", "lx").alias("alpha"))


def _moments(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over the dates that both have: count, means of either, their variances, and the covariance, for each column of ``a`` with each of ``b``."""
    has_a, has_b = ~np.isnan(a) * 1.0, ~np.isnan(b) * 1.0
    # Centred by each column's own mean first, so that little is lost in the sums of squares.
    centre_a, centre_b = (np.nan_to_num(m).sum(axis=0) / np.maximum(has.sum(axis=0), 1) for m, has in ((a, has_a), (b, has_b)))
    a0, b0 = np.nan_to_num(a - centre_a), np.nan_to_num(b - centre_b)
    n = has_a.T @ has_b
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_a, mean_b = a0.T @ has_b / n, has_a.T @ b0 / n
        var_a, var_b = (a0**2).T @ has_b / n - mean_a**2, has_a.T @ b0**2 / n - mean_b**2
        return n, mean_a + centre_a[:, None], mean_b + centre_b[None, :], var_a, var_b, a0.T @ b0 / n - mean_a * mean_b


def _in_blocks(returns: DataFrame, keys: tuple[str, ...], blocks: int) -> DataFrame:
    own = F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")
    rows = returns.where("lpx is not null").select(*keys, "date", "ticker", "lpx", "ret", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        _, day = np.unique(table["date"].cast(pa.timestamp("us")).to_numpy(), return_inverse=True)
        names, column = np.unique(table["ticker"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        price, ret = (np.full((day.max() + 1, len(names)), np.nan) for _ in range(2))
        price[day, column], ret[day, column] = (table[c].to_numpy().astype(float) for c in ("lpx", "ret"))
        side = np.zeros(len(names), np.int64)
        side[column] = table["own"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        n, mean_x, mean_y, var_l, var_r, cov = _moments(price[:, left], price[:, right])
        _, _, _, rvar_x, rvar_y, rcov = _moments(ret[:, left], ret[:, right])
        # Names are sorted, so a lesser place is a lesser name; of two blocks either ticker may be the lesser.
        a, b = np.nonzero((n > 0) & ((left[:, None] < right[None, :]) if i == j else True))
        x_first = left[a] < right[b]
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = rcov[a, b] / np.sqrt(rvar_x[a, b] * rvar_y[a, b])
            beta = cov[a, b] / np.where(x_first, var_l[a, b], var_r[a, b])
        mx, my = np.where(x_first, mean_x[a, b], mean_y[a, b]), np.where(x_first, mean_y[a, b], mean_x[a, b])
        x, y = np.where(x_first, names[left[a]], names[right[b]]), np.where(x_first, names[right[b]], names[left[a]])
        number = lambda v: pa.array(v, pa.float64(), mask=~np.isfinite(v))
        first = {k: pa.chunked_array([pa.repeat(table[k][0], len(a))]) for k in keys}
        return pa.table({**first, "x": pa.array(x.astype(object), pa.string()), "y": pa.array(y.astype(object), pa.string()), "overlap": pa.array(n[a, b].astype(np.int64)), "correlation": number(corr), "beta": number(beta), "alpha": number(my - beta * mx)})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "x string, y string, overlap long, correlation double, beta double, alpha double"])
    return rows.groupBy(*keys, "i", "j").applyInArrow(compare, schema)


def discover(prices: DataFrame, *, clock: DataFrame | None = None, keys: tuple[str, ...] = (), min_correlation: float = 0.7, max_pvalue: float = 0.05, min_half_life: float = 1.0, max_half_life: float = 252.0) -> DataFrame:
    """keys, y, x, beta, correlation, pvalue, half_life of the pairs that pass every stage, for each value of the keys.

    ``prices``: keys, date, ticker, px. The cheap stage is one aggregate; only pairs that pass it meet Python, one task for each.
    """
    returns = kept(panels.log_returns(prices, clock, keys), "returns")
    stats = pair_statistics(returns, keys).where((F.col("overlap") >= MIN_OVERLAP) & (F.abs("correlation") >= min_correlation) & ~F.isnan("correlation"))
    stats = stats.select(*keys, "x", "y", "correlation")
    logs = returns.where("lpx is not null").select(*keys, "date", "ticker", "lpx")
    rows = stats.join(logs.select(*keys, F.col("ticker").alias("x"), "date", F.col("lpx").alias("lx")), [*keys, "x"]).join(logs.select(*keys, F.col("ticker").alias("y"), "date", F.col("lpx").alias("ly")), [*keys, "y", "date"])
    group = [*keys, "x", "y"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def test(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        found = unit_root.engle_granger(table["ly"].to_numpy(), table["lx"].to_numpy())
        first = {c: table[c].slice(0, 1) for c in (*group, "correlation")}
        return pa.table({**first, "beta": [found.beta], "alpha": [found.alpha], "stat": [found.stat], "pvalue": [found.pvalue], "half_life": [half_life(found.resid)]})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*group, "correlation")) + ", beta double, alpha double, stat double, pvalue double, half_life double"
    tested = rows.groupBy(*group).applyInArrow(test, schema)
    fine = (F.isnan("pvalue") | (F.col("pvalue") <= max_pvalue)) & F.col("half_life").between(min_half_life, max_half_life) & ~F.isnan("half_life")
    return tested.where(fine).select(*keys, "y", "x", "beta", "alpha", "correlation", "stat", "pvalue", "half_life")


def discover_pairs(prices: DataFrame, **settings) -> list[PairCandidate]:
    """The candidates in order of p value; ties keep the order of the pairs."""
    rows = discover(prices, **settings).orderBy("pvalue", "x", "y").collect()
    return [PairCandidate(r.y, r.x, r.beta, r.correlation, r.pvalue, r.half_life) for r in rows]


def johansen_test(prices: DataFrame, tickers: list[str], *, level: float = 0.05, k_ar_diff: int = 1, det_order: int = 0) -> DataFrame:
    """rank, trace, critical and hedge of the tickers' log prices on their common dates: one row, made in one task."""
    rows = prices.where(F.col("ticker").isin(tickers)).groupBy("date").pivot("ticker", tickers).agg(F.first("px")).dropna()
    rows = rows.select("date", *(F.ln(f"`{t}`").alias(f"v{k}") for k, t in enumerate(tickers)), F.lit(1).alias("g"))

    def test(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        found = unit_root.johansen(np.stack([table[f"v{k}"].to_numpy() for k in range(len(tickers))], axis=1), level=level, k_ar_diff=k_ar_diff, det_order=det_order)
        return pa.table({"rank": pa.array([found.rank], pa.int32()), "trace": [found.trace_stats.tolist()], "critical": [found.crit_values.tolist()], "hedge": [found.hedge_ratios.tolist()]})

    return rows.groupBy("g").applyInArrow(test, "rank int, trace array<double>, critical array<double>, hedge array<double>")
