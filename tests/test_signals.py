import datetime as dt
import math

import numpy as np
import pytest
from barspan.functions import distributions, unit_root
from barspan.operators import discovery, signals
from barspan.sources import synthetic
from hypothesis import given, settings
from hypothesis import strategies as st


def test_position_machine():
    def run(*z, **p):
        return signals.positions(list(z), signals.SignalParams(**p)).tolist()

    assert run(0.0, -2.0, -1.0, -0.5, 0.0) == [0, 1, 1, 0, 0]
    assert run(2.5, None, 1.0, float("nan"), 0.4) == [-1, -1, -1, -1, 0]
    assert run(-2.0, -4.0, -4.0, -4.0) == [1, 0, 1, 0]
    assert run(-3.0, 3.0, 3.0) == [1, 0, -1]
    for bad in ({"exit": -0.1}, {"entry": 0.5}, {"stop": 2.0}):
        with pytest.raises(ValueError):
            signals.SignalParams(**bad)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-6, 6)), max_size=40), st.integers(0, 40))
def test_positions_only_look_back(z, cut):
    assert signals.positions(z).tolist()[:cut] == signals.positions(z[:cut]).tolist()


def series(seed=1, n=300, beta=1.4):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.standard_normal(n)) + 20
    return 0.5 + beta * x + rng.standard_normal(n) * 0.1, x


def test_filter_without_drift_is_least_squares():
    y, x = series(n=4000)
    found = signals.kalman_hedge(y, x, delta=0.0, obs_var=0.01, p0=1e6)
    beta, alpha = np.polyfit(x, y, 1)
    assert found.beta[-1] == pytest.approx(beta, abs=1e-3) and found.alpha[-1] == pytest.approx(alpha, abs=1e-2)
    assert found.zscore() == pytest.approx(found.spread / found.innovation_std)


def test_filter_follows_a_drift_and_only_looks_back():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.standard_normal(2000)) + 50
    y = np.linspace(1, 2, 2000) * x + rng.standard_normal(2000) * 0.1
    found = signals.kalman_hedge(y, x, delta=1e-4)
    assert abs(found.beta[-1] - 2) < 0.1
    part = signals.kalman_hedge(y[:700], x[:700], delta=1e-4)
    assert (part.beta == found.beta[:700]).all() and (part.spread == found.spread[:700]).all()


def test_filter_checks():
    for bad in ({"delta": 1.0}, {"delta": -0.1}, {"obs_var": 0.0}):
        with pytest.raises(ValueError):
            signals.kalman_hedge([1.0], [1.0], **bad)
    with pytest.raises(ValueError):
        signals.kalman_hedge([1.0], [1.0, 2.0])


def test_scans_agree(spark):
    rows = []
    for key, seed in (("a", 1), ("b", 2)):
        y, x = series(seed)
        rows += [(key, k, float(v), float(w)) for k, (v, w) in enumerate(zip(y, x, strict=True))]
    frame = spark.createDataFrame(rows, "pair string, i int, y double, x double").repartition(5)
    p = signals.SignalParams(1.0, 0.25, 2.0)
    one = {(r.pair, r.i): r for r in signals.kalman_scan(frame, ["pair"], "i", params=p).collect()}
    two = {(r.pair, r.i): r for r in signals.kalman_native(frame, ["pair"], "i", params=p).collect()}
    y, x = series(1)
    plain = signals.kalman_hedge(y, x)
    state = signals.positions(plain.zscore().tolist(), p)
    for k, r in one.items():
        assert two[k].state == r.state and two[k].beta == pytest.approx(r.beta, rel=1e-9) and two[k].z == pytest.approx(r.z, rel=1e-9)
        if k[0] == "a":
            assert r.beta == plain.beta[k[1]] and r.state == state[k[1]]
    z = signals.kalman_scan(frame, ["pair"], "i", params=p)
    three = {(r.pair, r.i): r.state for r in signals.position_scan(z, ["pair"], "i", params=p).collect()}
    assert three == {k: r.state for k, r in one.items()}


def test_stream_equals_batch(spark, tmp_path):
    from barspan.streaming.kalman import stream_signals

    y, x = series(3, 90)
    frame = spark.createDataFrame([("p", k, float(a), float(b)) for k, (a, b) in enumerate(zip(y, x, strict=True))], "pair string, k int, y double, x double").selectExpr("pair", "timestamp_seconds(k * 86400) as date", "y", "x", "k")
    for part in range(3):
        frame.where(f"k div 30 = {part}").drop("k").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("pair string, date timestamp, y double, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = stream_signals(stream).writeStream.format("memory").queryName("signals_out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = [(r.beta, r.state) for r in spark.table("signals_out").orderBy("date").collect()]
    plain = signals.kalman_hedge(y, x)
    assert [b for b, _ in found] == pytest.approx(plain.beta.tolist()) and [s for _, s in found] == signals.positions(plain.zscore().tolist()).tolist()


def test_rolling_and_half_life(spark):
    rng = np.random.default_rng(5)
    s = synthetic.simulate_ou(3000, synthetic.OUParams(0.1, 0, 1), rng)
    assert signals.half_life(s) == pytest.approx(math.log(2) / 0.1, rel=0.35)
    assert signals.half_life(np.arange(10.0)) == math.inf
    with pytest.raises(ValueError):
        signals.half_life([1.0, 2.0])
    rows = [("a", k, float(v)) for k, v in enumerate(s[:200])] + [("flat", k, 1.0) for k in range(5)] + [("short", 0, 1.0)]
    frame = spark.createDataFrame(rows, "k string, date int, spread double")
    found = {r.k: r.half_life for r in signals.half_lives(frame, ["k"], "date", "spread").collect()}
    assert found["a"] == pytest.approx(signals.half_life(s[:200])) and found["flat"] == math.inf and found["short"] is None
    z = {(r.k, r.date): r.z for r in signals.rolling_zscore(frame, 5, ["k"]).collect()}
    window = s[10:15]
    assert z["a", 14] == pytest.approx((window[-1] - window.mean()) / window.std()) and z["a", 3] is None and z["flat", 4] is None
    with pytest.raises(ValueError):
        signals.rolling_zscore(frame, 1)


def test_least_squares_with_constant_x(spark):
    rows = [("a", float(k), 2.0 * k + 1) for k in range(9)] + [("c", 3.0, float(k)) for k in range(5)]
    found = {r.k: (r.beta, r.alpha) for r in signals.ols(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).collect()}
    assert found["a"] == pytest.approx((2.0, 1.0))
    flat = np.linalg.lstsq(np.array([[3.0, 1.0]] * 5), np.arange(5.0), rcond=None)[0]
    assert found["c"] == pytest.approx(tuple(flat))


def test_unit_root_surfaces():
    assert unit_root.mackinnon_p(-3.34, 2) == pytest.approx(0.05, abs=2e-3)
    assert unit_root.mackinnon_p(-2.86, 1) == pytest.approx(0.05, abs=2e-3)
    assert unit_root.mackinnon_p(1.0, 2) == 1.0 and unit_root.mackinnon_p(-20.0, 2) == 0.0
    rng = np.random.default_rng(20240101)
    assert unit_root.adf(synthetic.simulate_ou(1000, synthetic.OUParams(0.1, 0, 1), rng))[1] < 0.01
    assert unit_root.adf(synthetic.simulate_random_walk(1000, rng))[1] > 0.05


def test_engle_granger():
    rng = np.random.default_rng(20240101)
    x, y = synthetic.cointegrated_log_prices(1500, rng, beta=1.2)
    found = unit_root.engle_granger(y, x)
    assert found.is_cointegrated(0.01) and found.beta == pytest.approx(1.2, abs=0.05)
    a, b = synthetic.simulate_random_walk(800, rng), synthetic.simulate_random_walk(800, rng)
    assert not unit_root.engle_granger(a, b).is_cointegrated(0.01)
    assert unit_root.engle_granger(2 * x + 1, x).pvalue == 0.0
    for bad in ((y[:10], x[:10]), (y, x[:-1]), (np.ones((3, 3)), x)):
        with pytest.raises(ValueError):
            unit_root.engle_granger(*bad)


def test_johansen():
    rng = np.random.default_rng(20240101)
    x, y = synthetic.cointegrated_log_prices(1500, rng, beta=1.2)
    found = unit_root.johansen(np.stack([x, y], axis=1))
    assert found.rank == 1 and found.hedge_ratios[0] == 1.0 and -1 / found.hedge_ratios[1] == pytest.approx(1.2, abs=0.1)
    for bad, level in ((np.ones((30, 1)), 0.05), (np.full((30, 2), np.nan), 0.05), (np.ones((30, 2)), 0.2), (np.ones((30, 6)), 0.05)):
        with pytest.raises(ValueError):
            unit_root.johansen(bad, level=level)


def test_discovery_finds_the_true_pairs(spark):
    made = synthetic.simulate_panel(1200, np.random.default_rng(11), n_pairs=3, n_noise=3)
    found = discovery.discover_pairs(made.dataframe(spark), min_correlation=0.3)
    names = {frozenset((c.y, c.x)) for c in found}
    assert {frozenset(t) for t in made.truth} <= names and not any("N" in "".join(n) for n in names)
    assert [c.pvalue for c in found] == sorted(c.pvalue for c in found)
    assert discovery.discover_pairs(made.dataframe(spark), min_correlation=0.999) == []


def test_returns_beside_a_gap_do_not_count(spark):
    import datetime as dt

    from barspan.operators import panel

    d = [dt.datetime(2020, 1, k + 1) for k in range(4)]
    rows = [(d[0], "A", 1.0), (d[1], "A", 2.0), (d[3], "A", 4.0), *((x, "B", 1.0) for x in d)]
    found = {(r.ticker, r.day_no): r.ret for r in panel.log_returns(spark.createDataFrame(rows, "date timestamp_ntz, ticker string, px double")).collect()}
    assert found["A", 2] == pytest.approx(math.log(2)) and found["A", 4] is None and found["A", 1] is None


def test_sharpe_distributions():
    r = [0.01, -0.02, 0.03, 0.0]
    assert distributions.sharpe_ratio(r) == pytest.approx(math.sqrt(252) * np.mean(r) / np.std(r, ddof=1))
    assert distributions.sharpe_ratio([0.1]) == 0.0 and distributions.sharpe_ratio([0.1, 0.1]) == 0.0
    psr = distributions.probabilistic_sharpe_ratio
    assert psr(0.1, 0.1, 50) == 0.5 and psr(0.1, 0.0, 101) == pytest.approx(distributions.normal_cdf(0.1 * 10 / math.sqrt(1 + 0.5 * 0.01)))
    assert psr(1.0, 0.0, 50, skew=5.0) == 0.5
    with pytest.raises(ValueError):
        psr(0.1, 0.0, 1)
    luck = distributions.expected_max_sharpe
    assert luck([3.0]) == 0.0 and luck([0.01] * 9) == 0.0
    with pytest.raises(ValueError):
        luck([])
    rng = np.random.default_rng(1)
    draws = rng.standard_normal((4000, 50))
    assert luck(draws[0].tolist()) / draws[0].std(ddof=1) == pytest.approx(draws.max(axis=1).mean(), rel=0.05)
    found = distributions.deflated_sharpe_ratio([0.05, 0.01, -0.02], rng.normal(0.001, 0.02, 500).tolist())
    assert 0 <= found.dsr <= 1 and found.best_sharpe == 0.05 and found.n_trials == 3 and found.sr_0 > 0


def test_pairs_in_blocks(spark):
    """Products of blocks give what the join by date gives, with gaps, tickers that never meet, and a constant series."""
    from barspan.operators import panel

    rng = np.random.default_rng(4)
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=k) for k in range(80)]
    rows = [(w, d, f"T{t:02d}", float(np.exp(4 + 0.1 * t + 0.02 * rng.standard_normal()))) for w in (0, 1) for t in range(9) for d in days if rng.random() > 0.2]
    rows += [(0, d, "U0", 5.0) for d in days[:30]] + [(0, d, "U1", float(np.exp(rng.standard_normal()))) for d in days[40:]]
    prices = spark.createDataFrame(rows, "w int, date timestamp_ntz, ticker string, px double")
    returns = panel.log_returns(prices, None, ("w",))
    want = {(r.w, r.x, r.y): r for r in discovery.pair_statistics(returns, ("w",)).collect()}
    for block in (2, 5):
        found = {(r.w, r.x, r.y): r for r in discovery.pair_statistics(returns, ("w",), block).collect()}
        assert set(found) == set(want) and len(found) == 54 + 36
        for k, r in found.items():
            assert r.overlap == want[k].overlap
            for c in ("correlation", "beta", "alpha"):
                a, b = r[c], want[k][c]
                assert (a is None or abs(a) > 1e6) if b is None or b != b else a == pytest.approx(b, rel=1e-8, abs=1e-9), (k, c, a, b)


def test_johansen_orders():
    """With a trend in the data, taking it out first leaves the statistics of the data without it."""
    rng = np.random.default_rng(6)
    walk = np.cumsum(rng.standard_normal((400, 1)), axis=0)
    data = np.concatenate([walk + rng.standard_normal((400, 1)), walk + rng.standard_normal((400, 1)), np.cumsum(rng.standard_normal((400, 5)), axis=0)], axis=1)
    plain = unit_root.johansen(data)
    assert plain.rank >= 1 and len(plain.trace_stats) == 7
    tilted = unit_root.johansen(data + 0.5 * np.arange(400)[:, None], det_order=1)
    assert tilted.trace_stats == pytest.approx(unit_root.johansen(data, det_order=1).trace_stats)
    assert unit_root.johansen(data, det_order=-1).trace_stats[0] != pytest.approx(plain.trace_stats[0])
    for bad in ({"det_order": 2}, {"level": 0.2}):
        with pytest.raises(ValueError):
            unit_root.johansen(data, **bad)
    with pytest.raises(ValueError):
        unit_root.johansen(rng.standard_normal((400, 13)))
