"""What the library registers for SQL: pricing functions as SQL expressions, and a table function for the windows of a sweep."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions.options import norm_cdf_sql

#: Bars of the windows of a sweep, and bars from one window's start to the next.
LENGTHS, STEP = (126, 252, 504, 1260, 2520), 126


@udtf(returnType="symbol string, window_len int, start int, from_date date, to_date date")
class SweepWindows:
    """sweep_windows(TABLE(bars) PARTITION BY symbol ORDER BY bar_date): the windows of every symbol's bars (symbol, bar_date, ...).

    Each length at every step and at the end; lengths that are not shorter than the series are the whole series, once. Windows go out
    as soon as their last bar has come, so that of a series only the dates of the longest length are held.
    """

    def __init__(self):
        self.symbol, self.n = None, 0
        self.dates: list = []  # of the last bars, as many as the longest window has

    def _date(self, number: int):
        return self.dates[number - (self.n - len(self.dates))]

    def eval(self, row: Row) -> Iterator[tuple]:
        self.symbol = row["symbol"]
        self.n += 1
        self.dates.append(row["bar_date"])
        if len(self.dates) > LENGTHS[-1]:
            del self.dates[0]
        for length in LENGTHS:
            start = self.n - length
            if start >= 0 and start % STEP == 0:
                yield self.symbol, length, start, self._date(start), self._date(self.n - 1)

    def terminate(self) -> Iterator[tuple]:
        if not self.n:
            return
        for length in LENGTHS:
            start = self.n - length
            if start > 0 and start % STEP:
                yield self.symbol, length, start, self._date(start), self._date(self.n - 1)
        if self.n not in LENGTHS and self.n < LENGTHS[-1]:
            yield self.symbol, self.n, 0, self._date(0), self._date(self.n - 1)


def register(spark: SparkSession) -> None:
    """Registers norm_cdf, bs_price and sweep_windows in a session. The first two are SQL expressions, which Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_cdf(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x IS NOT NULL THEN {norm_cdf_sql('x')} END")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION bs_price(kind STRING, spot DOUBLE, strike DOUBLE, years DOUBLE, sigma DOUBLE, rate DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN spot <= 0 OR strike <= 0 THEN 0.0D
        WHEN years <= 0 OR sigma <= 0 THEN greatest(CASE WHEN kind = 'c' THEN spot - strike ELSE strike - spot END, 0.0D)
        WHEN kind = 'c' THEN spot * norm_cdf((ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * sqrt(years))) - strike * exp(-rate * years) * norm_cdf((ln(spot / strike) + (rate - sigma * sigma / 2) * years) / (sigma * sqrt(years)))
        ELSE strike * exp(-rate * years) * norm_cdf(-(ln(spot / strike) + (rate - sigma * sigma / 2) * years) / (sigma * sqrt(years))) - spot * norm_cdf(-(ln(spot / strike) + (rate + sigma * sigma / 2) * years) / (sigma * sqrt(years))) END"""
    )
    spark.udtf.register("sweep_windows", SweepWindows)
