"""Normal distribution, and the Sharpe ratio's: what SQL has no function for, on single numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist, fmean, variance

_NORMAL = NormalDist()
EULER_GAMMA = 0.5772156649015329
DAYS = 252


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def sharpe_ratio(returns: Sequence[float], periods_per_year: int = DAYS) -> float:
    """Annualised mean over sample deviation; 0 if there are under two returns, or nothing varies."""
    if len(returns) < 2:
        return 0.0
    mean = fmean(returns)
    std = math.sqrt(sum((r - mean) ** 2 for r in returns) / (len(returns) - 1))
    return math.sqrt(periods_per_year) * mean / std if std and math.isfinite(std) else 0.0


def probabilistic_sharpe_ratio(sr_hat: float, sr_benchmark: float, n: int, *, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    """Chance that the true per-period ratio exceeds the benchmark, given n returns and their moments."""
    if n < 2:
        raise ValueError("at least two observations are needed")
    spread = 1 - skew * sr_hat + (kurtosis - 1) / 4 * sr_hat**2
    return normal_cdf((sr_hat - sr_benchmark) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else 0.5


def expected_max_sharpe(trials: Sequence[float]) -> float:
    """What the best of so many trials without skill would show."""
    n = len(trials)
    if not n:
        raise ValueError("no trials")
    spread = variance(trials) if n > 1 else 0.0
    if spread <= 0:
        return 0.0
    return math.sqrt(spread) * ((1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * math.e)))


@dataclass(frozen=True)
class DeflatedSharpe:
    dsr: float
    sr_0: float
    best_sharpe: float
    n_trials: int


def deflated_sharpe_ratio(trials: Sequence[float], best_returns: Sequence[float] | None = None, *, skew: float = 0.0, kurtosis: float = 3.0, n_default: int = DAYS) -> DeflatedSharpe:
    """The best trial held against the best that luck would give. All ratios are per period, as the returns are."""
    best, luck, n = max(trials), expected_max_sharpe(trials), n_default
    if best_returns is not None and len(best_returns) >= 2:
        n, mean = len(best_returns), fmean(best_returns)
        m2, m3, m4 = (fmean((r - mean) ** k for r in best_returns) for k in (2, 3, 4))
        skew, kurtosis = (m3 / m2**1.5, m4 / m2**2) if m2 > 0 else (0.0, 3.0)
    return DeflatedSharpe(probabilistic_sharpe_ratio(best, luck, n, skew=skew, kurtosis=kurtosis), luck, best, len(trials))
