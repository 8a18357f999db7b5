"""Rules that bars must keep: each broken rule is a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.sources import schema

ERROR, WARNING = "error", "warning"
_RULES = ("duplicate_rows", "unsorted_dates", "nonpositive_price", "negative_volume", "ohlc_inconsistent", "calendar_gap", "possible_corporate_action")


@dataclass(frozen=True)
class Issue:
    severity: str
    code: str
    ticker: str | None
    message: str


class Report:
    """The issues as a DataFrame, in order, and the usual questions about them."""

    def __init__(self, table: DataFrame):
        self.table = table

    @cached_property
    def issues(self) -> list[Issue]:
        rows = self.table.orderBy(F.col("ticker").asc_nulls_first(), "rule_no", "part").collect()
        return [Issue(r.severity, r.code, r.ticker, r.message) for r in rows]

    @property
    def errors(self) -> list[Issue]:
        return [i for i in self.issues if i.severity == ERROR]

    @property
    def warnings(self) -> list[Issue]:
        return [i for i in self.issues if i.severity == WARNING]

    @property
    def ok(self) -> bool:
        return not self.errors

    def __len__(self) -> int:
        return len(self.issues)


def measures(bars: DataFrame, *, max_gap_days: int = 5, split_ratio_threshold: float = 0.4) -> DataFrame:
    """One row per ticker with what each rule counts, in one pass over the bars ordered by ticker and date."""
    order = Window.partitionBy("ticker").orderBy("date")
    prior, px = F.lag("adj_close").over(order), F.col("adj_close")
    jump = F.when((prior == 0) & (px != 0), True).otherwise(F.abs(F.try_divide(px - prior, prior)) > split_ratio_threshold)
    gap = F.floor((F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.lag("date").over(order).cast("timestamp"))) / 86_400_000_000)
    rows = schema.normalise(bars).where("ticker is not null").withColumn("gap", gap).withColumn("jump", jump)
    inside = (F.col("low") <= F.least("open", "close") + 1e-9) & (F.col("high") >= F.greatest("open", "close") - 1e-9)
    return rows.groupBy("ticker").agg(
        (F.count("date") - F.count_distinct("date")).alias("repeated_dates"),
        *(F.coalesce(F.bool_or(F.col(c) <= 0), F.lit(False)).alias(f"bad_{c}") for c in schema.PRICE_COLUMNS),
        F.coalesce(F.bool_or(F.col("volume") < 0), F.lit(False)).alias("bad_volume"),
        F.bool_and(F.coalesce(inside, F.lit(False))).alias("consistent"),
        F.count_if(F.col("gap") > max_gap_days).alias("gaps"),
        F.count_if("jump").alias("jumps"),
    )


def issues(bars: DataFrame, *, max_gap_days: int = 5, split_ratio_threshold: float = 0.4) -> DataFrame:
    """severity, code, ticker, message; and rule_no and part, their order within a ticker."""
    m = measures(bars, max_gap_days=max_gap_days, split_ratio_threshold=split_ratio_threshold)

    def issue(when, code: str, severity: str, message, part: int = 0):
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("ticker"), message.alias("message"), F.lit(_RULES.index(code)).alias("rule_no"), F.lit(part).alias("part")))

    found = [
        issue(F.col("repeated_dates") > 0, "unsorted_dates", ERROR, F.lit("dates do not increase strictly")),
        *(issue(F.col(f"bad_{c}"), "nonpositive_price", ERROR, F.lit(f"{c} has values at or below zero"), k) for k, c in enumerate(schema.PRICE_COLUMNS)),
        issue(F.col("bad_volume"), "negative_volume", ERROR, F.lit("volume has negative values")),
        issue(~F.col("consistent"), "ohlc_inconsistent", ERROR, F.lit("low or high does not bracket open and close")),
        issue(F.col("gaps") > 0, "calendar_gap", WARNING, F.format_string(f"%d gaps of more than {max_gap_days} calendar days", "gaps")),
        issue(F.col("jumps") > 0, "possible_corporate_action", WARNING, F.concat(F.col("jumps").cast("string"), F.lit(f" moves of more than {split_ratio_threshold:.0%}"))),
    ]
    by_ticker = m.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("x.*")
    keys = bars.select(F.struct("date", "ticker").alias("k")).agg((F.count("*") - F.count_distinct("k")).alias("n"))
    whole = keys.where("n > 0").select(F.lit(ERROR).alias("severity"), F.lit("duplicate_rows").alias("code"), F.lit(None).cast("string").alias("ticker"), F.format_string("%d repeated rows of a date and ticker", "n").alias("message"), F.lit(0).alias("rule_no"), F.lit(0).alias("part"))
    return whole.unionByName(by_ticker)


def validate_bars(bars: DataFrame, *, max_gap_days: int = 5, split_ratio_threshold: float = 0.4) -> Report:
    return Report(issues(bars, max_gap_days=max_gap_days, split_ratio_threshold=split_ratio_threshold))
