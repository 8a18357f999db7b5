"""Hedge ratios, half-lives, rolling scores, and the two scans: the Kalman filter and the position machine."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ols(pairs: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x") -> DataFrame:
    """Per key: n, beta, alpha of y on (1, x). With constant x the least-norm solution is taken, as a pseudo-inverse would."""
    has = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = pairs.where(has).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(y).alias("my"), F.avg(x).alias("mx"))
    flat = F.col("my") / (F.col("mx") * F.col("mx") + 1)
    return rows.select(*keys, "n", F.coalesce("b", F.col("mx") * flat).alias("beta"), F.coalesce("a", flat).alias("alpha"))


def half_lives(series: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Per key: half_life of shocks, from the slope of changes on levels; infinite without reversion, null under three points."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    moves = series.withColumn("_s", before).withColumn("_d", F.col(value) - before)
    found = moves.groupBy(*keys).agg(F.count("*").alias("_n"), F.regr_slope("_d", "_s").alias("_l"))
    slope = F.coalesce("_l", F.lit(0.0))
    return found.select(*keys, F.when(F.col("_n") >= 3, F.when(slope >= 0, F.lit(math.inf)).otherwise(-math.log(2) / slope)).alias("half_life"))


def half_life(spread: Sequence[float]) -> float:
    """The same of one series in memory."""
    s = np.asarray(spread, float)
    if s.ndim != 1 or len(s) < 3:
        raise ValueError("a series of at least three values is needed")
    before, move = s[:-1], np.diff(s)
    centred = before - before.mean()
    slope = float(centred @ (move - move.mean()) / (centred @ centred)) if (centred @ centred) > 0 else 0.0
    return math.inf if slope >= 0 else -math.log(2) / slope


def rolling_zscore(series: DataFrame, window: int, keys: Sequence[str] = (), order: str = "date", value: str = "spread", out: str = "z") -> DataFrame:
    """Distance from the trailing mean in population deviations; null until the window is full, or where nothing varies."""
    if window < 2:
        raise ValueError("window must be at least 2")
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, 0)
    full = F.count(value).over(frame) == window
    score = F.try_divide(F.col(value) - F.avg(value).over(frame), F.stddev_pop(value).over(frame))
    return series.withColumn(out, F.when(full, score))


@dataclass(frozen=True)
class SignalParams:
    entry: float = 2.0
    exit: float = 0.5
    stop: float = 4.0

    def __post_init__(self):
        if not 0 <= self.exit < self.entry < self.stop:
            raise ValueError("0 <= exit < entry < stop must hold")


def positions(z: Sequence[float | None], params: SignalParams | None = None) -> np.ndarray:
    """-1, 0 or +1 after each score: in at ``entry`` against the sign, out within ``exit`` or beyond ``stop``; nulls keep it."""
    p = params or SignalParams()
    state, out = 0, np.zeros(len(z), np.int64)
    for k, v in enumerate(z):
        if v is not None and v == v:
            if state == 0:
                state = (v <= -p.entry) - (v >= p.entry)
            elif state * v >= -p.exit or state * v <= -p.stop:
                state = 0
        out[k] = state
    return out


@dataclass
class KalmanResult:
    beta: np.ndarray
    alpha: np.ndarray
    spread: np.ndarray
    innovation_std: np.ndarray

    def zscore(self) -> np.ndarray:
        return self.spread / self.innovation_std


def _check_filter(delta: float, obs_var: float) -> None:
    if not 0 <= delta < 1:
        raise ValueError("delta must be in [0, 1)")
    if obs_var <= 0:
        raise ValueError("obs_var must be positive")


def kalman_hedge(y: Sequence[float], x: Sequence[float], *, delta: float = 1e-4, obs_var: float = 1e-3, beta0: float = 0.0, alpha0: float = 0.0, p0: float = 1.0) -> KalmanResult:
    """Random-walk regression of y on (x, 1), one pass: the spread is the surprise against the state before the point."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    if y.ndim != 1 or y.shape != x.shape:
        raise ValueError("y and x must be series of one length")
    _check_filter(delta, obs_var)
    q = delta / (1 - delta)
    b, a, bb, ba, ab, aa = beta0, alpha0, p0, 0.0, 0.0, p0
    out = np.empty((4, len(y)))
    for k, (yt, xt) in enumerate(zip(y.tolist(), x.tolist(), strict=True)):
        bb, aa = bb + q, aa + q
        e = yt - (xt * b + a)
        # Covariance times the design (x, 1), from the right and from the left.
        cb, ca, rb, ra = bb * xt + ba, ab * xt + aa, xt * bb + ab, xt * ba + aa
        s = xt * cb + ca + obs_var
        gb, ga = cb / s, ca / s
        b, a = b + gb * e, a + ga * e
        bb, ba, ab, aa = bb - gb * rb, ba - gb * ra, ab - ga * rb, aa - ga * ra
        out[:, k] = b, a, e, math.sqrt(s)
    return KalmanResult(*out)


def kalman_scan(series: DataFrame, keys: Sequence[str], order: str = "date", *, delta: float | str = 1e-4, obs_var: float | str = 1e-3, beta0: float | str = 0.0, alpha0: float | str = 0.0, p0: float | str = 1.0, params: SignalParams | Sequence[str] | None = None) -> DataFrame:
    """Filter and position machine over each key's rows (y, x) in order, in one pass per key.

    Settings are numbers or names of columns that are constant within a key. Columns added: beta, alpha, spread, innovation_std,
    z, state. A key is one series and one task; keys run in parallel.
    """
    names = list(keys)
    settings = {"delta": delta, "obs_var": obs_var, "beta0": beta0, "alpha0": alpha0, "p0": p0}
    p = params or SignalParams()
    settings |= dict(zip(("entry", "exit", "stop"), p if isinstance(p, (list, tuple)) else (p.entry, p.exit, p.stop), strict=True))
    rows = series.select(*names, order, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), *(F.col(v).alias(f"_{k}") if isinstance(v, str) else F.lit(float(v)).alias(f"_{k}") for k, v in settings.items()))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        own = {k: table[f"_{k}"][0].as_py() for k in settings}
        found = kalman_hedge(table["y"].to_numpy(), table["x"].to_numpy(), **{k: own[k] for k in ("delta", "obs_var", "beta0", "alpha0", "p0")})
        z = found.zscore()
        state = positions(z.tolist(), SignalParams(own["entry"], own["exit"], own["stop"]))
        made = {"beta": found.beta, "alpha": found.alpha, "spread": found.spread, "innovation_std": found.innovation_std, "z": z, "state": state}
        return pa.table({**{c: table[c] for c in (*names, order, "y", "x")}, **made})

    out = ", ".join(f"`{c}` {kinds[c]}" for c in (*names, order, "y", "x")) + ", beta double, alpha double, spread double, innovation_std double, z double, state long"
    return rows.groupBy(*names).applyInArrow(scan, out)


_KALMAN_STEP = """
  aggregate(_rows,
    named_struct('b', {beta0}, 'a', {alpha0}, 'bb', {p0}, 'ba', 0D, 'ab', 0D, 'aa', {p0}, 'state', 0L, 'out', cast(array() as array<struct<i:{kind},beta:double,alpha:double,spread:double,innovation_std:double,state:bigint>>)),
    (t, r) -> element_at(transform(array(named_struct('e', r.y - (r.x * t.b + t.a), 'cb', (t.bb + {q}) * r.x + t.ba, 'ca', t.ab * r.x + (t.aa + {q}), 'rb', r.x * (t.bb + {q}) + t.ab, 'ra', r.x * t.ba + (t.aa + {q}))),
      u -> element_at(transform(array(r.x * u.cb + u.ca + {obs_var}),
        s -> element_at(transform(array(case when u.e / sqrt(s) is null then t.state when t.state = 0 then (case when u.e / sqrt(s) <= -{entry} then 1L when u.e / sqrt(s) >= {entry} then -1L else 0L end) when t.state * (u.e / sqrt(s)) >= -{exit} or t.state * (u.e / sqrt(s)) <= -{stop} then 0L else t.state end),
          n -> named_struct('b', t.b + u.cb / s * u.e, 'a', t.a + u.ca / s * u.e, 'bb', t.bb + {q} - u.cb / s * u.rb, 'ba', t.ba - u.cb / s * u.ra, 'ab', t.ab - u.ca / s * u.rb, 'aa', t.aa + {q} - u.ca / s * u.ra, 'state', n,
            'out', array_append(t.out, named_struct('i', r.i, 'beta', t.b + u.cb / s * u.e, 'alpha', t.a + u.ca / s * u.e, 'spread', u.e, 'innovation_std', sqrt(s), 'state', n)))), 1)), 1)), 1),
    t -> t.out)
"""


def kalman_native(series: DataFrame, keys: Sequence[str], order: str = "date", *, delta: float = 1e-4, obs_var: float = 1e-3, beta0: float = 0.0, alpha0: float = 0.0, p0: float = 1.0, params: SignalParams | None = None) -> DataFrame:
    """The same scan as one Catalyst fold over each key's ordered array, without Python: for series of up to some thousand points."""
    _check_filter(delta, obs_var)
    p = params or SignalParams()
    kind = dict(series.dtypes)[order]
    text = _KALMAN_STEP.format(kind=kind, q=f"{delta / (1 - delta)!r}D", **{k: f"{float(v)!r}D" for k, v in (("obs_var", obs_var), ("beta0", beta0), ("alpha0", alpha0), ("p0", p0), ("entry", p.entry), ("exit", p.exit), ("stop", p.stop))})
    rows = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")))).alias("_rows"))
    out = rows.select(*keys, F.explode(F.expr(text)).alias("o"))
    return out.select(*keys, F.col("o.i").alias(order), *(F.col(f"o.{c}").alias(c) for c in ("beta", "alpha", "spread", "innovation_std")), (F.col("o.spread") / F.col("o.innovation_std")).alias("z"), F.col("o.state").alias("state"))


def position_scan(scores: DataFrame, keys: Sequence[str], order: str = "date", value: str = "z", params: SignalParams | None = None) -> DataFrame:
    """The position machine alone, as a Catalyst fold: keys, order, z, state."""
    p = params or SignalParams()
    kind = dict(scores.dtypes)[order]
    step = f"case when r.z is null or isnan(r.z) then t.state when t.state = 0 then (case when r.z <= -{p.entry!r}D then 1L when r.z >= {p.entry!r}D then -1L else 0L end) when t.state * r.z >= -{p.exit!r}D or t.state * r.z <= -{p.stop!r}D then 0L else t.state end"
    fold = f"aggregate(_rows, named_struct('state', 0L, 'out', cast(array() as array<struct<i:{kind},z:double,state:bigint>>)), (t, r) -> element_at(transform(array({step}), n -> named_struct('state', n, 'out', array_append(t.out, named_struct('i', r.i, 'z', r.z, 'state', n)))), 1), t -> t.out)"
    rows = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(value).cast("double").alias("z")))).alias("_rows"))
    return rows.select(*keys, F.explode(F.expr(fold)).alias("o")).select(*keys, F.col("o.i").alias(order), F.col("o.z").alias("z"), F.col("o.state").alias("state"))
