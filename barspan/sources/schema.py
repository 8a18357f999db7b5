"""The canonical bar table: one row per date and ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")
PRICE_COLUMNS = VALUE_COLUMNS[:5]
BAR_COLUMNS = ("date", "ticker", *VALUE_COLUMNS)

BAR_SCHEMA = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType(), False),
        T.StructField("ticker", T.StringType(), False),
        *(T.StructField(c, T.DoubleType()) for c in VALUE_COLUMNS),
    ]
)

#: Column names that data vendors use.
VENDOR_NAMES = {"Date": "date", "Datetime": "date", "Symbol": "ticker", "Ticker": "ticker", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}


class SchemaError(ValueError):
    """A table is not a bar table."""


def validate_schema(bars: DataFrame) -> None:
    """Column presence and types, from the schema alone: no job runs."""
    kinds = {f.name: f.dataType for f in bars.schema.fields}
    if missing := [c for c in BAR_COLUMNS if c not in kinds]:
        raise SchemaError(f"missing columns: {missing}")
    if not isinstance(kinds["date"], (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise SchemaError(f"date must be a date or timestamp, not {kinds['date'].simpleString()}")
    if wrong := [c for c in VALUE_COLUMNS if not isinstance(kinds[c], T.NumericType)]:
        raise SchemaError(f"columns must be numeric: {wrong}")


def number(name: str) -> Column:
    """As a double; NaN, which Spark would order above all numbers, becomes null."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value).alias(name)


def normalise(bars: DataFrame) -> DataFrame:
    """Canonical columns, order and types; extra columns go."""
    validate_schema(bars)
    return bars.select(F.col("date").cast("timestamp_ntz").alias("date"), F.col("ticker").cast("string").alias("ticker"), *map(number, VALUE_COLUMNS))


def rename_vendor(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Vendor column names to ours; rows without a close go. A missing adjusted close is the close."""
    named = raw.select(*(F.col(f"`{c}`").alias(VENDOR_NAMES.get(c, c)) for c in raw.columns))
    if ticker is not None:
        named = named.withColumn("ticker", F.lit(ticker))
    if "adj_close" not in named.columns and "close" in named.columns:
        named = named.withColumn("adj_close", F.col("close"))
    return normalise(named).dropna(subset=["close"])
