"""Command line: generate, ingest, research, backtest, validate."""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.sql import functions as F

from barspan import __version__
from barspan.functions.distributions import deflated_sharpe_ratio
from barspan.operators import backtest, discovery, panel, quality_rules, walkforward
from barspan.operators.universe import PointInTimeUniverse
from barspan.sources import bar_sources, storage, synthetic


#: What --master and --checkpoint say, if they were given.
_CLUSTER: dict[str, str | None] = {"master": None, "checkpoint": None}


def _spark():
    """On this machine, unless --master or the submitting tool's own settings name a cluster."""
    import os

    from barspan.session import spark_session

    master = _CLUSTER["master"] or (None if "PYSPARK_SUBMIT_ARGS" in os.environ or "SPARK_ENV_LOADED" in os.environ else "local[*]")
    conf = {"spark.sql.shuffle.partitions": "8"} if master and master.startswith("local") else {}
    if _CLUSTER["checkpoint"]:
        conf["spark.checkpoint.dir"] = _CLUSTER["checkpoint"]
    return spark_session(master=master, **conf)


def _download(name: str):
    """The function that ``module:function`` names: (ticker, start, end) to a DataFrame in vendor columns, or None."""
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _version(_) -> int:
    print(f"barspan {__version__}")
    return 0


def _gen_synth(ns) -> int:
    made = synthetic.simulate_panel(ns.n, np.random.default_rng(ns.seed), n_pairs=ns.pairs, n_noise=ns.noise)
    storage.write_panel(panel.wide(made.dataframe(_spark()), tickers=list(made.prices)), ns.out)
    print(f"wrote {len(made.dates)} rows x {len(made.prices)} cols to {ns.out}")
    print(f"ground-truth cointegrated pairs: {made.truth}")
    return 0


def _ingest(ns) -> int:
    if ns.source == "yfinance":
        if not ns.tickers:
            print("error: --tickers is required for a vendor source")
            return 2
        if not ns.download:
            print("error: --download module:function must say how bars are fetched; nothing is built in")
            return 2
        source = bar_sources.VendorSource(ns.tickers.split(","), ns.start, ns.end, download=_download(ns.download))
    elif ns.source == "synthetic":
        source = bar_sources.SyntheticSource(_spark(), ns.n, n_pairs=ns.pairs, n_noise=ns.noise, seed=ns.seed)
    else:
        source = bar_sources.FileSource(_spark(), ns.path, ns.source)
    bars = source.fetch().persist()
    report = quality_rules.validate_bars(bars)
    for i in report.issues:
        print(f"  [{i.severity}] {i.code} {i.ticker or ''}: {i.message}")
    if not report.ok:
        print(f"validation failed with {len(report.errors)} error(s); not writing")
        return 1
    storage.write_bars(bars, ns.out)
    n, tickers = bars.agg(F.count("*"), F.count_distinct("ticker")).first()
    print(f"wrote {n} bars across {tickers} tickers to {ns.out}")
    return 0


def _research(ns) -> int:
    prices = panel.price_panel(storage.read_bars(_spark(), ns.dataset))
    found = discovery.discover_pairs(prices, min_correlation=ns.min_corr, max_pvalue=ns.max_pvalue, max_half_life=ns.max_half_life)
    if not found:
        print("no cointegrated pairs found under the given thresholds")
        return 0
    print(f"discovered {len(found)} pair(s), ranked by cointegration p-value:")
    for c in found[: ns.top]:
        print(f"  {c}")
    return 0


def _told(result: backtest.BacktestResult) -> None:
    s = result.stats().first()
    final = result.equity.agg(F.max_by("equity", "date")).first()[0]
    print(f"  initial equity : {result.initial_cash:,.0f}")
    print(f"  final equity   : {final:,.0f}")
    print(f"  total return   : {s.total_return:+.2%}")
    print(f"  ann. Sharpe    : {s.sharpe:.2f}")
    print(f"  transaction cost: {s.total_costs:,.0f}")
    print(f"  fills          : {s.n_fills}")


def _loaded(ns):
    """(universe, first day, last day, number of days)."""
    universe = PointInTimeUniverse.from_bars(storage.read_bars(_spark(), ns.dataset)).keep()
    return universe, *universe.trading_days().agg(F.min("date"), F.max("date"), F.count("*")).first()


def _backtest(ns) -> int:
    universe, start, end, n = _loaded(ns)
    if n < 2:
        print("not enough history to backtest")
        return 1
    tickers = universe.members_as_of(start)[: ns.max_names]
    print(f"backtest {start.date()} -> {end.date()}  ({n} days, {len(tickers)} names)")
    _told(backtest.run_buy_and_hold(universe, tickers, ns.notional, cash=ns.cash))
    return 0


def _pair(ns, universe: PointInTimeUniverse) -> tuple[str, str] | None:
    if ns.y and ns.x:
        return ns.y, ns.x
    found = discovery.discover_pairs(universe._prices, min_correlation=ns.min_corr, max_pvalue=ns.max_pvalue)
    if not found:
        print("no cointegrated pairs found to auto-select; pass --y/--x explicitly")
        return None
    print(f"auto-selected pair: {found[0]}")
    return found[0].y, found[0].x


def _backtest_pair(ns) -> int:
    universe, start, end, n = _loaded(ns)
    if (pair := _pair(ns, universe)) is None:
        return 1
    if n < 2:
        print("not enough history to backtest")
        return 1
    settings = {k: float(getattr(ns, k)) for k in ("entry", "exit", "stop", "delta", "notional")}
    backtest.SignalParams(settings["entry"], settings["exit"], settings["stop"])
    runs = _spark().createDataFrame([(0, *pair, *settings.values())], "run int, y string, x string, " + ", ".join(f"{k} double" for k in settings))
    result = backtest.run_pairs(universe, runs, cash=ns.cash)
    print(f"backtest-pair {pair[0]}~{pair[1]}  {start.date()} -> {end.date()}  ({n} days)")
    _told(result)
    if ns.report:
        from barspan.report import tearsheet

        print(f"  tear sheet written to {tearsheet.render(result, title=f'{pair[0]}~{pair[1]} Pairs Backtest', out_path=ns.report)}")
    return 0


def _validate(ns) -> int:
    universe, *_ = _loaded(ns)
    windows = walkforward.walk_forward_windows(universe.trading_days(), ns.train_days, ns.test_days, ns.step_days)
    if windows.isEmpty():
        print("not enough history for even one walk-forward window")
        return 1
    done = walkforward.run_walk_forward(universe, windows, cash=ns.cash, notional=ns.notional, min_correlation=ns.min_corr, max_pvalue=ns.max_pvalue, max_half_life=ns.max_half_life)
    rows = done.table().collect()
    print(f"walk-forward: {len(rows)} windows, train={ns.train_days}d test={ns.test_days}d")
    for r in rows:
        label = f"{r.test_start.date()} -> {r.test_end.date()}"
        print(f"  {label}  " + ("no pair discovered" if r.y is None else f"{r.y}~{r.x}  return={r.total_return:+.2%}  sharpe={r.sharpe:.2f}  fills={r.n_fills}"))
    print(f"combined out-of-sample Sharpe: {done.combined_sharpe():.2f}")
    return 0


def _sensitivity(ns) -> int:
    universe, _, _, n = _loaded(ns)
    if (pair := _pair(ns, universe)) is None:
        return 1
    if n < 2:
        print("not enough history to backtest")
        return 1
    grid = {"entry": [float(v) for v in ns.entries.split(",")], "delta": [float(v) for v in ns.deltas.split(",")]}
    cells, result = walkforward.pair_grid(universe, *pair, grid, cash=ns.cash, notional=ns.notional)
    table = cells.toPandas()
    print(f"sensitivity grid: {pair[0]}~{pair[1]}  {len(table)} combinations")
    print(table.drop(columns="run").to_string(index=False))
    best = table.loc[table["metric"].idxmax()]
    returns = [r.ret for r in result.returns().where(F.col("run") == int(best["run"])).orderBy("date").collect()]
    print(f"\nbest cell: entry={best['entry']} delta={best['delta']}")
    print(f"  naive Sharpe   : {best['metric']:.2f}")
    yearly = deflated_sharpe_ratio(table["metric"].tolist(), returns)
    daily = deflated_sharpe_ratio((table["metric"] / np.sqrt(backtest.DAYS)).tolist(), returns)
    print(f"  deflated Sharpe: {yearly.dsr:.4f}  (SR_0={yearly.sr_0:.2f}, N={yearly.n_trials}; annualised ratios taken for per-period ones)")
    print(f"  deflated Sharpe: {daily.dsr:.4f}  (SR_0={daily.sr_0:.4f}, N={daily.n_trials}; per-period ratios)")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barspan")
    top.add_argument("--master", default=None)
    top.add_argument("--checkpoint", default=None, help="a folder that driver and executors share")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *options):
        sub = commands.add_parser(name)
        sub.set_defaults(func=run)
        for option in options:
            flag, default = option[:2]
            kind = {} if len(option) < 3 else option[2]
            sub.add_argument(flag, default=default, **({"type": type(default)} if default is not None and "type" not in kind else {}), **kind)

    made = (("--n", 1000), ("--pairs", 3), ("--noise", 4), ("--seed", 7))
    data = ("--dataset", "data/bars")
    pair = (("--y", None), ("--x", None))

    def limits(corr: float, p: float):
        return ("--min-corr", corr), ("--max-pvalue", p)

    command("version", _version)
    command("gen-synth", _gen_synth, ("--out", "data/synthetic/panel.parquet"), *made)
    command("ingest", _ingest, ("--source", "synthetic", {"choices": ["synthetic", "yfinance", "parquet", "csv", "json", "orc"]}), ("--out", "data/bars"), ("--path", None), ("--tickers", None), ("--download", None), ("--start", "2015-01-01"), ("--end", None), *made)
    command("research", _research, data, *limits(0.7, 0.05), ("--max-half-life", 252.0), ("--top", 20))
    command("backtest", _backtest, data, ("--cash", 1_000_000.0), ("--notional", 500_000.0), ("--max-names", 5))
    command("backtest-pair", _backtest_pair, data, *pair, *limits(0.7, 0.05), ("--cash", 1_000_000.0), ("--notional", 200_000.0), ("--entry", 2.0), ("--exit", 0.5), ("--stop", 4.0), ("--delta", 1e-6), ("--report", None))
    command("validate", _validate, data, ("--train-days", 200), ("--test-days", 100), ("--step-days", None, {"type": int}), *limits(0.3, 0.1), ("--max-half-life", 252.0), ("--cash", 1_000_000.0), ("--notional", 200_000.0))
    command("sensitivity", _sensitivity, data, *pair, *limits(0.3, 0.1), ("--entries", "1.0,1.5,2.0"), ("--deltas", "1e-6,1e-5"), ("--cash", 1_000_000.0), ("--notional", 200_000.0))
    return top


def main(argv: list[str] | None = None) -> int:
    ns = parser().parse_args(argv)
    _CLUSTER.update(master=ns.master, checkpoint=ns.checkpoint)
    return ns.func(ns)


if __name__ == "__main__":
    sys.exit(main())
