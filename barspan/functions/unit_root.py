"""Unit-root and cointegration tests in numpy, run inside grouped maps.

After MacKinnon (1994, 2010), Engle and Granger (1987) and Johansen (1991).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from barspan.functions.distributions import normal_cdf

#: Response surfaces for a test with constant, by number of variables: (largest tau, smallest tau, where the branches
#: meet, polynomial below, polynomial above), coefficients from the constant up.
MACKINNON = {
    1: (2.74, -18.83, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (0.92, -18.86, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
#: Critical values of the trace test with constant at 90, 95 and 99 percent, by number of common trends left.
#: Critical trace statistics (10 %, 5 %, 1 %) by deterministic order (-1 none, 0 constant, 1 trend), for 1, 2, ... 12 series.
TRACE_CRITICAL = {
    -1: (
        (2.9762, 4.1296, 6.9406),
        (10.4741, 12.3212, 16.3640),
        (21.7781, 24.2761, 29.5147),
        (37.0339, 40.1749, 46.5716),
        (56.2839, 60.0627, 67.6367),
        (79.5329, 83.9383, 92.7136),
        (106.7351, 111.7797, 121.7375),
        (137.9954, 143.6691, 154.7977),
        (173.2292, 179.5199, 191.8122),
        (212.4721, 219.4051, 232.8291),
        (255.6732, 263.2603, 277.9962),
        (302.9054, 311.1288, 326.9716),
    ),
    0: (
        (2.7055, 3.8415, 6.6349),
        (13.4294, 15.4943, 19.9349),
        (27.0669, 29.7961, 35.4628),
        (44.4929, 47.8545, 54.6815),
        (65.8202, 69.8189, 77.8202),
        (91.1090, 95.7542, 104.9637),
        (120.3673, 125.6185, 135.9825),
        (153.6341, 159.5290, 171.0905),
        (190.8714, 197.3772, 210.0366),
        (232.1030, 239.2468, 253.2526),
        (277.3740, 285.1402, 300.2821),
        (326.5354, 334.9795, 351.2150),
    ),
    1: (
        (2.7055, 3.8415, 6.6349),
        (16.1619, 18.3985, 23.1485),
        (32.0645, 35.0116, 41.0815),
        (51.6492, 55.2459, 62.5202),
        (75.1027, 79.3422, 87.7748),
        (102.4674, 107.3429, 116.9829),
        (133.7852, 139.2780, 150.0778),
        (169.0618, 175.1584, 187.1891),
        (208.3582, 215.1268, 228.2226),
        (251.6293, 259.0267, 273.3838),
        (298.8836, 306.8988, 322.4264),
        (350.1125, 358.7190, 375.3203),
    ),
}
LEVELS = (0.10, 0.05, 0.01)


def mackinnon_p(tau: float, variables: int = 1) -> float:
    top, bottom, meet, below, above = MACKINNON[variables]
    if tau > top:
        return 1.0
    if tau < bottom:
        return 0.0
    return normal_cdf(sum(c * tau**k for k, c in enumerate(below if tau <= meet else above)))


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, sum of squared residuals, pseudo-inverse of x'x)."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x @ beta
    return beta, float(rest @ rest), inverse


def adf_statistic(series: np.ndarray, constant: bool = True) -> tuple[float, int]:
    """(t value of the level, lags): lags up to Schwert's rule by least AIC on one common sample, ties to fewer."""
    s = np.asarray(series, float)
    n, d = len(s), np.diff(s)
    most = min(n // 2 - 1 - constant, math.ceil(12 * (n / 100) ** 0.25))
    if most < 0:
        raise ValueError("the series is too short")

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        columns = [s[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)]
        if constant:
            columns.append(np.ones(len(s) - 1 - skip))
        return d[skip:], np.stack(columns, axis=1)

    best, chosen = math.inf, 0
    y, widest = design(most, most)
    for lags in range(most + 1):
        columns = [*range(lags + 1), *([widest.shape[1] - 1] if constant else [])]
        x = widest[:, columns]
        _, ssr, _ = _regress(y, x)
        m = len(y)
        aic = m * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / m) + 1) + 2 * x.shape[1]
        if aic < best - 1e-12 * abs(aic):
            best, chosen = aic, lags
    y, x = design(chosen, chosen)
    beta, ssr, inverse = _regress(y, x)
    free = len(y) - x.shape[1]
    error = math.sqrt(ssr / free * inverse[0, 0]) if free > 0 else 0.0
    return (float(beta[0] / error) if error > 0 else -math.inf), chosen


def adf(series: np.ndarray) -> tuple[float, float]:
    """(statistic, p value) of a unit root, with constant."""
    stat, _ = adf_statistic(series)
    return stat, mackinnon_p(stat, 1)


@dataclass(frozen=True)
class EngleGranger:
    beta: float
    alpha: float
    stat: float
    pvalue: float
    resid: np.ndarray

    def is_cointegrated(self, level: float = 0.05) -> bool:
        return self.pvalue < level


def engle_granger(y, x) -> EngleGranger:
    """Regress y on (x, 1), then look for a unit root in what is left."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    if y.ndim != 1 or x.ndim != 1 or len(y) != len(x):
        raise ValueError("y and x must be series of one length")
    if len(y) < 20:
        raise ValueError("at least 20 observations are needed")
    design = np.stack([x, np.ones_like(x)], axis=1)
    (beta, alpha), *_ = np.linalg.lstsq(design, y, rcond=None)
    rest = y - design @ (beta, alpha)
    total = float(((y - y.mean()) ** 2).sum())
    if total <= 0 or 1 - float(rest @ rest) / total >= 1 - 100 * math.sqrt(np.finfo(float).eps):
        return EngleGranger(float(beta), float(alpha), -math.inf, 0.0, rest)
    stat, _ = adf_statistic(rest, constant=False)
    return EngleGranger(float(beta), float(alpha), stat, mackinnon_p(stat, 2), rest)


@dataclass(frozen=True)
class Johansen:
    rank: int
    trace_stats: np.ndarray
    crit_values: np.ndarray
    eigenvectors: np.ndarray

    @property
    def hedge_ratios(self) -> np.ndarray:
        return self.eigenvectors[:, 0] / self.eigenvectors[0, 0]


def _without_trend(data: np.ndarray, order: int) -> np.ndarray:
    """What a polynomial of this order in time leaves; the data themselves for an order of -1."""
    if order < 0:
        return data
    powers = np.vander(np.arange(len(data)) / max(1, len(data) - 1), order + 1)
    return data - powers @ np.linalg.lstsq(powers, data, rcond=None)[0]


def johansen(prices, *, level: float = 0.05, k_ar_diff: int = 1, det_order: int = 0) -> Johansen:
    """Trace test without (-1), with a constant (0) or with a trend (1). All statistics above their critical value count, wherever they stand."""
    data = np.asarray(prices, float)
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if data.ndim != 2 or data.shape[1] < 2:
        raise ValueError("at least two series are needed")
    if det_order not in TRACE_CRITICAL:
        raise ValueError(f"det_order must be one of {tuple(TRACE_CRITICAL)}")
    if data.shape[1] > len(TRACE_CRITICAL[det_order]):
        raise ValueError(f"critical values are known for up to {len(TRACE_CRITICAL[det_order])} series")
    if np.isnan(data).any():
        raise ValueError("missing values")
    k, lags = data.shape[1], k_ar_diff
    data = _without_trend(data, det_order)
    moves = np.diff(data, axis=0)
    now = moves[lags:]
    past = np.concatenate([moves[lags - j : len(moves) - j] for j in range(1, lags + 1)], axis=1) if lags else np.zeros((len(now), 0))
    # With differences on the right, the levels stand as far back as the first of them.
    levels = data[1 : len(data) - lags]
    now, past, levels = (_without_trend(m, min(det_order, 0)) for m in (now, past, levels[: len(now)]))

    def partial(m: np.ndarray) -> np.ndarray:
        return m - past @ np.linalg.lstsq(past, m, rcond=None)[0] if past.shape[1] else m

    r0, rk = partial(now), partial(levels)
    n = len(r0)
    s00, s0k, skk = r0.T @ r0 / n, r0.T @ rk / n, rk.T @ rk / n
    values, vectors = np.linalg.eig(np.linalg.solve(skk, s0k.T @ np.linalg.solve(s00, s0k)))
    order = np.argsort(values.real)[::-1]
    values, vectors = values.real[order], vectors.real[:, order]
    vectors = vectors / np.sqrt(np.einsum("ij,ik,kj->j", vectors, skk, vectors))
    trace = np.array([-n * np.log(1 - values[i:]).sum() for i in range(k)])
    critical = np.array([TRACE_CRITICAL[det_order][k - i - 1][LEVELS.index(level)] for i in range(k)])
    return Johansen(int((trace > critical).sum()), trace, critical, vectors)
