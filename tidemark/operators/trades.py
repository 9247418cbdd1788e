"""Trades: entries and exits from signals, chosen greedily in time, runs of held bars, and equity that accrues from them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, running


def greedy(candidates: DataFrame, gap: int) -> DataFrame:
    """Of candidate trades (symbol, rn, exit_rn, ...) those taken by going forward in time: the first, then always the
    first that starts `gap` bars after the last exit or later.

    The choice feeds back on itself, so each symbol is one grouped map over its candidates only, not over its bars.
    """
    def chosen(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn")
        free, take = -1, []
        for rn, end in zip(g["rn"], g["exit_rn"], strict=True):
            take.append(rn >= free)
            if rn >= free:
                free = end + gap
        return g[take]

    return candidates.groupBy("symbol").applyInPandas(chosen, candidates.schema)


def numbered(bars: DataFrame) -> DataFrame:
    """Adds rn, the 0-based bar number, and n, the number of bars of the symbol."""
    return bars.withColumn("rn", F.row_number().over(by_symbol()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))


def with_exits(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds exit_date, exit_price and ret to trades by the bar number of their exit."""
    at = bars.select("symbol", F.col("rn").alias("exit_rn"), F.col("bar_date").alias("exit_date"), F.col("close").alias("exit_price"))
    return candidates.join(at, ["symbol", "exit_rn"]).withColumn("ret", F.try_divide(F.col("exit_price"), F.col("entry_price")) - 1)


def _trades(bars: DataFrame, entries: DataFrame, gap: int) -> DataFrame:
    kept = greedy(entries.select("symbol", "rn", "exit_rn", F.col("bar_date").alias("entry_date"), F.col("close").alias("entry_price")), gap)
    return with_exits(kept, bars).select("symbol", "entry_date", "exit_date", "entry_price", "exit_price", (F.col("exit_rn") - F.col("rn")).alias("days_held"), "ret", "rn", "exit_rn")


def after_falls(bars: DataFrame, lookback: int = 20, threshold: float = 5.0, hold: int = 10) -> DataFrame:
    """Buys after a fall of `threshold` percent over `lookback` bars and holds; the next entry may be the exit's bar."""
    bars = numbered(bars)
    fall = (F.col("close") / F.lag("close", lookback).over(by_symbol()) - 1) * 100
    entries = bars.withColumn("fall", fall).where((F.col("fall") <= -threshold) & (F.col("rn") >= lookback) & (F.col("rn") < F.col("n") - hold - 1))
    return _trades(bars, entries.withColumn("exit_rn", F.col("rn") + hold), 0)


def _first_ahead(col: str, within: int, hit: Callable[[Column], Column]) -> Column:
    """Bars until `hit` of a value ahead is first true, `within` if it is not; one bounded array per row."""
    ahead = F.collect_list(F.struct(F.col(col))).over(by_symbol().rowsBetween(1, within))
    k = F.array_position(F.transform(ahead, lambda x: F.coalesce(hit(x[col]), F.lit(False))), True)
    return F.when(k > 0, k).otherwise(within)


def on_dislocation(z: DataFrame, entry: float = 1.5, out: float = 0.5, max_days: int = 20, warm_up: int = 252) -> DataFrame:
    """Buys when z (column z of bars) is below -entry; sells when |z| first is below `out`, or after `max_days`."""
    bars = numbered(z).withColumn("k", _first_ahead("z", max_days, lambda x: F.abs(x) < out))
    entries = bars.where((F.col("z") < -entry) & (F.col("rn") >= warm_up) & (F.col("rn") < F.col("n") - max_days - 1))
    return _trades(bars, entries.withColumn("exit_rn", (F.col("rn") + F.col("k")).cast("int")), 1)


def on_levels(bars: DataFrame, high_window: int = 20, entry: float = 10.0, target: float = 10.0, stop: float = 8.0, max_hold: int = 20, test_share: float | None = 0.3) -> DataFrame:
    """Buys `entry` percent below the high of the bars before; sells at the target, the stop or after `max_hold` bars.
    With `test_share` only the last part of each series is traded, as if it began there."""
    if test_share is not None:
        bars = numbered(bars).where(F.col("rn") >= F.floor(F.col("n") * (1 - test_share) + 1e-9)).drop("rn", "n")
    bars = numbered(bars).withColumn("high_before", F.max("close").over(by_symbol().rowsBetween(-high_window, -1)))
    ahead = F.collect_list("close").over(by_symbol().rowsBetween(1, max_hold))
    k = F.array_position(F.transform(ahead, lambda p: (p >= F.col("close") * (1 + target / 100)) | (p <= F.col("close") * (1 - stop / 100))), True)
    bars = bars.withColumn("k", F.when(k > 0, k).otherwise(max_hold))
    entries = bars.where((F.col("close") <= F.col("high_before") * (1 - entry / 100)) & (F.col("rn") >= high_window) & (F.col("rn") < F.col("n") - max_hold - 1))
    return _trades(bars, entries.withColumn("exit_rn", (F.col("rn") + F.col("k")).cast("int")), 1)


def accrued(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """(symbol, bar_date, log_equity): each trade's return spread evenly over its bars; trades that overlap add up.

    A short trade that loses more than all counts as a loss of all.
    """
    held = F.explode(F.sequence(F.col("rn") + 1, F.col("exit_rn")))
    rate = F.pow(F.greatest(1 + F.col("ret"), F.lit(0.0)), 1.0 / (F.col("exit_rn") - F.col("rn"))) - 1
    daily = trades.select("symbol", rate.alias("d"), held.alias("rn")).groupBy("symbol", "rn").agg(F.sum("d").alias("d"))
    step = F.log1p(F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(-0.999999999)))
    return numbered(bars).join(daily, ["symbol", "rn"], "left").withColumn("step", step).select("symbol", "bar_date", running(F.sum, "step").alias("log_equity"))


def runs(df: DataFrame, held: str = "held") -> DataFrame:
    """Runs of bars with `held` true, as trades (symbol, entry_date, exit_date, days_held, ret) from daily returns `ret`."""
    w = by_symbol()
    change = F.when(F.col(held) != F.coalesce(F.lag(held).over(w), F.lit(False)), 1).otherwise(0)
    df = df.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(held)
    return df.groupBy("symbol", "run").agg(F.min("bar_date").alias("entry_date"), F.max("bar_date").alias("exit_date"), F.count("*").alias("days_held"), (F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0))))) - 1).alias("ret")).drop("run")


def random_entries(bars: DataFrame, n_trades: int, hold: int, seed: int = 42) -> DataFrame:
    """`n_trades` entries drawn without replacement by hash of (seed, symbol, bar), so the draw repeats anywhere."""
    bars = numbered(bars)
    mix = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "symbol", "rn")), 1, 8), 16, 10).cast("long")
    drawn = bars.where(F.col("rn") < F.col("n") - hold - 1).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(mix, "rn"))).where(F.col("place") <= n_trades)
    entries = drawn.select("symbol", "rn", (F.col("rn") + hold).alias("exit_rn"), F.col("bar_date").alias("entry_date"), F.col("close").alias("entry_price"))
    return with_exits(entries, bars)
