import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from barspan import cli
from barspan.operators import backtest
from barspan.report import tearsheet


def test_png_is_well_formed():
    pixels = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    raw = tearsheet.png(pixels)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (5, 4)
    at, body = 8, b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + data)
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    rows = zlib.decompress(body)
    assert rows == b"".join(b"\0" + r.tobytes() for r in pixels)


@pytest.mark.parametrize("values", [[], [100.0], [100.0, 101.0, 103.0, 108.0]])
def test_page(spark, tmp_path, values):
    rows = [(0, dt.datetime(2020, 1, 1) + dt.timedelta(days=k), k + 1, v) for k, v in enumerate(values)]
    equity = spark.createDataFrame(rows, "run int, date timestamp_ntz, day_no int, equity double")
    fills = spark.createDataFrame([], "run int, date timestamp_ntz, ticker string, quantity double, price double, cost double")
    out = tearsheet.render(backtest.BacktestResult(equity, fills, 100.0), title="A <b> & C", out_path=f"{tmp_path}/a/b.html")
    page = open(out, encoding="utf-8").read()
    assert page.count("data:image/png;base64,") == 3 and page.count("class=tile>") == 8 and "A &lt;b&gt; &amp; C" in page


def two_bars(ticker, start, end):
    """A vendor that knows one ticker."""
    from pyspark.sql import SparkSession

    rows = [(dt.datetime(2020, 1, k), 1.0, 2.0, 0.5, 1.5, 1.5, 10.0) for k in (2, 3)]
    return SparkSession.getActiveSession().createDataFrame(rows, "Date timestamp, Open double, High double, Low double, Close double, `Adj Close` double, Volume double") if ticker == "A" else None


def test_commands(spark, tmp_path, capsys):
    data, out = f"{tmp_path}/bars", lambda: capsys.readouterr().out
    assert cli.main(["version"]) == 0 and out().startswith("barspan ")
    assert cli.main(["gen-synth", "--out", f"{tmp_path}/panel.parquet", "--n", "30", "--pairs", "1", "--noise", "1"]) == 0
    assert "30 rows x 3 cols" in out() and spark.read.parquet(f"{tmp_path}/panel.parquet").columns == ["date", "P0a", "P0b", "N0"]
    assert cli.main(["ingest", "--out", data, "--n", "400", "--pairs", "2", "--noise", "2", "--seed", "42"]) == 0
    assert "wrote 2400 bars across 6 tickers" in out()
    assert cli.main(["ingest", "--source", "yfinance"]) == 2
    assert cli.main(["ingest", "--source", "yfinance", "--tickers", "A"]) == 2 and "--download" in out()
    assert cli.main(["--checkpoint", f"{tmp_path}/shared", "ingest", "--source", "yfinance", "--tickers", "A,B", "--download", "tests.test_report_cli:two_bars", "--out", f"{tmp_path}/vendor"]) == 0
    assert "wrote 2 bars across 1 tickers" in out()
    assert cli.main(["research", "--dataset", data, "--min-corr", "0.3", "--max-pvalue", "0.1"]) == 0
    assert "P0b~P0a beta=1.810 corr=0.58 p=0.0004 hl=7.6" in out()
    assert cli.main(["research", "--dataset", data, "--min-corr", "0.99"]) == 0 and "no cointegrated pairs" in out()
    assert cli.main(["backtest", "--dataset", data]) == 0 and "5 names" in out()
    assert cli.main(["backtest-pair", "--dataset", data, "--min-corr", "0.3", "--max-pvalue", "0.1", "--report", f"{tmp_path}/r.html"]) == 0
    told = out()
    assert "final equity   : 1,015,561" in told and "ann. Sharpe    : 0.94" in told and "fills          : 32" in told and "total return   : +1.56%" in told
    assert cli.main(["backtest-pair", "--dataset", data, "--min-corr", "0.99"]) == 1
    assert cli.main(["validate", "--dataset", data, "--train-days", "500"]) == 1
    assert cli.main(["validate", "--dataset", data, "--train-days", "250", "--test-days", "150"]) == 0 and "combined out-of-sample Sharpe" in out()
    assert cli.main(["sensitivity", "--dataset", data, "--entries", "1.0,2.0", "--deltas", "1e-6"]) == 0 and "deflated Sharpe" in out()


def test_bad_bars_are_not_written(spark, tmp_path, capsys):
    from barspan.sources.bar_sources import SyntheticSource
    from pyspark.sql import functions as F

    SyntheticSource(spark, 20, n_pairs=1, n_noise=0).fetch().withColumn("volume", F.lit(-1.0)).write.parquet(f"{tmp_path}/in")
    assert cli.main(["ingest", "--source", "parquet", "--path", f"{tmp_path}/in", "--out", f"{tmp_path}/out"]) == 1
    assert "not writing" in capsys.readouterr().out and not (tmp_path / "out").exists()
