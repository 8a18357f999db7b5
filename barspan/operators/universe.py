"""What was known when: reads that cannot see past their date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.operators import panel
from barspan.tables import kept


def _at(t) -> Column:
    return F.lit(t).cast("timestamp_ntz")


class Membership:
    """When each ticker is in the universe: first and last date, both inclusive."""

    def __init__(self, intervals: DataFrame):
        self.intervals = intervals.select("ticker", F.col("first_date").cast("timestamp_ntz").alias("first_date"), F.col("last_date").cast("timestamp_ntz").alias("last_date"))

    @classmethod
    def from_panel(cls, prices: DataFrame) -> Membership:
        """From the first to the last price of each ticker, over all the data: a ticker inside a gap still counts."""
        return cls(prices.where("px is not null").groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")))

    def on(self, days: DataFrame) -> DataFrame:
        """(date, ticker) for each of the days and its members."""
        m = self.intervals
        return days.select("date").join(m, F.col("date").between(m.first_date, m.last_date)).select("date", "ticker")

    def at(self, t) -> DataFrame:
        return self.intervals.where(_at(t).between(F.col("first_date"), F.col("last_date"))).select("ticker")

    def members_as_of(self, t) -> list[str]:
        return [r.ticker for r in self.at(t).orderBy("ticker").collect()]

    def is_member(self, ticker: str, t) -> bool:
        return not self.at(t).where(F.col("ticker") == ticker).isEmpty()

    def keep(self, rows: DataFrame, at: str = "date") -> DataFrame:
        """Rows whose ticker is a member on their own date. One row per ticker on the other side, joined by key."""
        held = rows.join(self.intervals, "ticker").where(F.col(at).between(F.col("first_date"), F.col("last_date")))
        return held.drop("first_date", "last_date")


class PointInTimeUniverse:
    """Prices, volumes and adjusted opens in long form behind as-of reads; the tables themselves are private."""

    def __init__(self, prices: DataFrame, *, volume: DataFrame | None = None, opens: DataFrame | None = None, membership: Membership | None = None, check: bool = True):
        kind = dict(prices.dtypes).get("date", "")
        if not kind.startswith(("timestamp", "date")):
            raise TypeError("dates must be dates or timestamps")
        plain = prices.select(F.col("date").cast("timestamp_ntz").alias("date"), "ticker", F.col("px").cast("double").alias("px"))
        if check and not plain.groupBy("date", "ticker").count().where("count > 1").isEmpty():
            raise ValueError("repeated dates")
        self._prices = plain
        self._volume = volume
        self._opens = opens
        self.membership = membership or Membership.from_panel(plain)
        self._own = membership is None
        self._rows: DataFrame | None = None
        self._features: dict[int, DataFrame] = {}
        self._kept = False

    @classmethod
    def from_bars(cls, bars: DataFrame, *, price_field: str = "adj_close", membership: Membership | None = None) -> PointInTimeUniverse:
        return cls._of(panel.bar_panel(bars, price_field), membership)

    @classmethod
    def _of(cls, rows: DataFrame, membership: Membership | None) -> PointInTimeUniverse:
        """From the panels side by side."""

        def one(name: str) -> DataFrame:
            return rows.where(F.col(name).isNotNull()).select("date", "ticker", name)

        out = cls(one("px"), volume=one("volume"), opens=one("adj_open"), membership=membership, check=False)
        out._rows = rows
        return out

    def keep(self) -> PointInTimeUniverse:
        """Write the tables down, for several reads."""
        if self._rows is not None:
            out = self._of(kept(self._rows, "panels"), self.membership)
        else:
            tables = [None if t is None else kept(t, "panel") for t in (self._prices, self._volume, self._opens)]
            out = PointInTimeUniverse(tables[0], volume=tables[1], opens=tables[2], membership=self.membership, check=False)
        if self._own:
            out.membership = Membership.from_panel(out._prices)
        out.membership = Membership(kept(out.membership.intervals, "membership"))
        out._kept = True
        return out

    def tickers(self) -> list[str]:
        """All tickers ever: for reports, not for decisions."""
        return [r.ticker for r in self._prices.select("ticker").distinct().orderBy("ticker").collect()]

    def trading_days(self, start=None, end=None) -> DataFrame:
        return panel.trading_days(self._prices, start, end)

    def members_as_of(self, t) -> list[str]:
        return self.membership.members_as_of(t)

    def as_of(self, t, *, members_only: bool = True) -> DataFrame:
        """date, ticker, px up to and including t, of the members at t."""
        rows = self._prices.where(F.col("date") <= _at(t))
        return rows.join(self.membership.at(t), "ticker", "left_semi").select("date", "ticker", "px") if members_only else rows

    def window(self, t, size: int, *, members_only: bool = True) -> DataFrame:
        """The same over the last ``size`` dates of the panel."""
        if size <= 0:
            raise ValueError("size must be positive")
        days = self._prices.select("date").where(F.col("date") <= _at(t)).distinct().orderBy(F.desc("date")).limit(size)
        return self.as_of(t, members_only=members_only).join(days, "date", "left_semi")

    def asof_date(self, t):
        return self._prices.where(F.col("date") <= _at(t)).agg(F.max("date")).first()[0]

    def close_row(self, t) -> DataFrame:
        """ticker, px on the last date up to t, of its members at t; prices are not carried forward."""
        last = self._prices.where(F.col("date") <= _at(t)).agg(F.max("date").alias("date"))
        return self._prices.join(F.broadcast(last), "date").join(self.membership.at(t), "ticker", "left_semi").select("ticker", "px")

    # Reads of one value; the tables below have them for all dates at once.

    def price_as_of(self, t, ticker: str) -> float | None:
        """Last price up to t of a member at t."""
        rows = self.as_of(t).where(F.col("ticker") == ticker).agg(F.max_by("px", "date"))
        return rows.first()[0]

    def open_price(self, date, ticker: str) -> float | None:
        found = self._opens.where((F.col("ticker") == ticker) & (F.col("date") == _at(date))).select("adj_open").first() if self._opens is not None else None
        return found[0] if found else None

    def volume_as_of(self, t, ticker: str, window: int = 20) -> float | None:
        """Mean of the last volumes up to t."""
        found = self.volumes(window).where((F.col("ticker") == ticker) & (F.col("date") <= _at(t)))
        return found.agg(F.max_by("adv", "date")).first()[0]

    def volatility_as_of(self, t, ticker: str, window: int = 20) -> float | None:
        """Population deviation of the last log returns between observations up to t."""
        found = self.volatilities(window).where((F.col("ticker") == ticker) & (F.col("date") <= _at(t)))
        return found.agg(F.max_by("vol", "date")).first()[0] if not found.isEmpty() else None

    # Features by date and ticker.

    def volumes(self, window: int = 20) -> DataFrame:
        """date, ticker, adv: on dates with a volume, the mean of the last ``window`` of them."""
        order = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - window, 0)
        return self._volume.select("date", "ticker", F.avg("volume").over(order).alias("adv"))

    def volatilities(self, window: int = 20) -> DataFrame:
        """date, ticker, vol: on dates with a price, from the last ``window`` returns; null with fewer than two."""
        each = Window.partitionBy("ticker").orderBy("date")
        moves = self._prices.withColumn("r", F.ln("px") - F.lag(F.ln("px")).over(each))
        last = each.rowsBetween(1 - window, 0)
        return moves.select("date", "ticker", F.when(F.count("r").over(last) >= 2, F.stddev_pop("r").over(last)).alias("vol"))

    def features(self, window: int = 20) -> DataFrame:
        """date, ticker, px, adj_open, and px_asof, vol, adv carried forward: what an order filled that day meets."""
        if window in self._features:
            return self._features[window]
        keys = ["date", "ticker"]
        if self._rows is not None:
            rows = self._rows.drop("volume")
        elif self._opens is not None:
            rows = self._prices.join(self._opens, keys, "full")
        else:
            rows = self._prices.withColumn("adj_open", F.lit(None).cast("double"))
        rows = rows.join(self.volatilities(window), keys, "left")
        rows = rows.join(self.volumes(window), keys, "full") if self._volume is not None else rows.withColumn("adv", F.lit(None).cast("double"))
        past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        carried = [F.last(c, ignorenulls=True).over(past).alias(a) for c, a in (("px", "px_asof"), ("adv", "adv"))]
        # A price without two returns has no volatility, and hides none of before: only priced dates carry it.
        vol = F.last(F.when(F.col("px").isNotNull(), F.struct("vol")), ignorenulls=True).over(past)["vol"].alias("vol")
        out = rows.select("date", "ticker", "px", "adj_open", *carried, vol)
        self._features[window] = kept(out, "features") if self._kept else out
        return self._features[window]
