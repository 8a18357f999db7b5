"""The Kalman scan and the position machine over a stream of paired prices: state per pair, one row out for each row in."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barspan.operators.signals import SignalParams, _check_filter

_STATE = "b double, a double, bb double, ba double, ab double, aa double, state long"
_OUT = "pair string, date timestamp, beta double, alpha double, spread double, innovation_std double, z double, state long"


def stream_signals(prices: DataFrame, *, delta: float = 1e-4, obs_var: float = 1e-3, beta0: float = 0.0, alpha0: float = 0.0, p0: float = 1.0, params: SignalParams | None = None) -> DataFrame:
    """``prices``: a stream of pair, date, y, x. Rows of one batch are taken by date; a row older than the last batch's is taken when it comes.

    State is a few numbers per pair, so it does not grow with the stream; Spark checkpoints it.
    """
    _check_filter(delta, obs_var)
    p, q = params or SignalParams(), delta / (1 - delta)

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        b, a, bb, ba, ab, aa, state = held.get if held.exists else (beta0, alpha0, p0, 0.0, 0.0, p0, 0)
        rows = pd.concat(list(frames)).sort_values("date")
        out = []
        for date, y, x in zip(rows["date"], rows["y"], rows["x"], strict=True):
            bb, aa = bb + q, aa + q
            e = y - (x * b + a)
            cb, ca, rb, ra = bb * x + ba, ab * x + aa, x * bb + ab, x * ba + aa
            s = x * cb + ca + obs_var
            gb, ga = cb / s, ca / s
            b, a = b + gb * e, a + ga * e
            bb, ba, ab, aa = bb - gb * rb, ba - gb * ra, ab - ga * rb, aa - ga * ra
            z = e / math.sqrt(s)
            if state == 0:
                state = int(z <= -p.entry) - int(z >= p.entry)
            elif state * z >= -p.exit or state * z <= -p.stop:
                state = 0
            out.append((key[0], date, b, a, e, math.sqrt(s), z, state))
        held.update((float(b), float(a), float(bb), float(ba), float(ab), float(aa), int(state)))
        yield pd.DataFrame(out, columns=["pair", "date", "beta", "alpha", "spread", "innovation_std", "z", "state"])

    rows = prices.selectExpr("pair", "cast(date as timestamp) as date", "cast(y as double) as y", "cast(x as double) as x")
    return rows.groupBy("pair").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
