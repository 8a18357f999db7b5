"""Price panels in long form, returns, and the trading clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.sources import schema

#: Input order of rows; attached where a table has none.
ROW = "_row_ord"


def with_row_order(bars: DataFrame) -> DataFrame:
    return bars if ROW in bars.columns else bars.withColumn(ROW, F.monotonically_increasing_id())


def price_panel(bars: DataFrame, field: str = "adj_close") -> DataFrame:
    """date, ticker, px: of repeated rows the last non-null value in input order."""
    if field not in schema.VALUE_COLUMNS:
        raise schema.SchemaError(f"unknown field: {field}")
    rows = with_row_order(bars).select("date", "ticker", schema.number(field).alias("px"), ROW).where("px is not null and ticker is not null and date is not null")
    return rows.groupBy("date", "ticker").agg(F.max_by("px", ROW).alias("px"))


def adjusted_open(bars: DataFrame) -> DataFrame:
    """date, ticker, adj_open: the open on the adjusted scale."""
    fields = with_row_order(bars).select("date", "ticker", *map(schema.number, ("open", "adj_close", "close")), ROW)
    rows = fields.withColumn("v", F.col("open") * F.try_divide("adj_close", "close")).where("v is not null and ticker is not null and date is not null")
    return rows.groupBy("date", "ticker").agg(F.max_by("v", ROW).alias("adj_open"))


def bar_panel(bars: DataFrame, price_field: str = "adj_close") -> DataFrame:
    """date, ticker, px, volume, adj_open in one aggregate: the three panels side by side, null where one has no value."""
    if price_field not in schema.VALUE_COLUMNS:
        raise schema.SchemaError(f"unknown field: {price_field}")
    fields = {"px": F.col(price_field), "volume": F.col("volume"), "adj_open": F.col("open") * F.try_divide("adj_close", "close")}
    rows = with_row_order(bars).where("ticker is not null and date is not null").select("date", "ticker", ROW, *map(schema.number, schema.VALUE_COLUMNS))
    rows = rows.select("date", "ticker", ROW, *(c.alias(n) for n, c in fields.items()))
    return rows.groupBy("date", "ticker").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col(ROW))).alias(n) for n in fields))


def wide(panel: DataFrame, value: str = "px", tickers: list[str] | None = None) -> DataFrame:
    """A column per ticker: for hand-over only. Without a list the tickers are looked up first."""
    tickers = tickers or [r[0] for r in panel.select("ticker").distinct().orderBy("ticker").collect()]
    return panel.groupBy("date").pivot("ticker", tickers).agg(F.first(value)).orderBy("date")


def trading_days(panel: DataFrame, start=None, end=None) -> DataFrame:
    """date, day_no (from 1): the dates between both ends, inclusive. One row a day, so one task may number them."""
    days = panel.select("date").distinct()
    if start is not None:
        days = days.where(F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        days = days.where(F.col("date") <= F.lit(end).cast("timestamp_ntz"))
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("date")))


def log_returns(panel: DataFrame, clock: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The panel with lpx and ret: the log return since the clock's previous day, null if the ticker has no price then."""
    clock = trading_days(panel) if clock is None else clock
    dated = panel.join(F.broadcast(clock.select("date", "day_no")), "date")
    order = Window.partitionBy(*keys, "ticker").orderBy("day_no")
    dated = dated.withColumn("lpx", F.ln("px"))
    back = F.when(F.lag("day_no").over(order) == F.col("day_no") - 1, F.col("lpx") - F.lag("lpx").over(order))
    return dated.withColumn("ret", back)
