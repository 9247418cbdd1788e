"""Allocation between asset and cash from their deviation, and the curves and statistics that follow from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, first_value, running

YEAR = 252


def panel(pair: DataFrame, floor: float = 0.10, ceiling: float = 0.90, sensitivity: float = 2.0, bear_multiplier: float = 0.4, bear_drawdown: float = 0.10, lookback_share: float = 0.25, lookback: int | None = None) -> DataFrame:
    """Adds asset_norm, bench_norm, deviation, dev_scale, raw_allocation, regime_mult and allocation to (symbol, bar_date, close, bench).

    The bear market test looks back a share of the whole series, so a symbol's length sets its frame: that maximum is
    taken in one grouped map per symbol. With `lookback` bars given it is a window, and no later bar can change an
    earlier allocation.
    """
    floor, ceiling = max(floor, 0.02), min(ceiling, 0.98)
    if floor >= ceiling:
        floor, ceiling = 0.02, 0.98
    mid, amplitude = (floor + ceiling) / 2, (ceiling - floor) / 2
    if lookback is None:
        kinds = dict(pair.dtypes)

        def peaks(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("bar_date")
            return g.assign(peak=g["bench"].rolling(max(2, round(len(g) * lookback_share)), min_periods=1).max())

        df = pair.groupBy("symbol").applyInPandas(peaks, ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "peak double"]))
    else:
        df = pair.withColumn("peak", F.max("bench").over(by_symbol().rowsBetween(1 - lookback, 0)))
    df = df.withColumn("asset_norm", F.col("close") / first_value("close")).withColumn("bench_norm", F.col("bench") / first_value("bench"))
    df = df.withColumn("deviation", F.col("asset_norm") - F.col("bench_norm")).withColumn("abs_dev", F.abs("deviation"))
    df = df.withColumn("dev_scale", F.greatest(running(F.avg, "abs_dev"), F.lit(0.01)))
    df = df.withColumn("raw_allocation", mid + amplitude * F.tanh(-sensitivity * F.col("deviation") / F.col("dev_scale")))
    df = df.withColumn("regime_mult", F.when(F.col("bench") / F.col("peak") - 1 <= -bear_drawdown, bear_multiplier).otherwise(1.0))
    allocation = F.greatest(F.least(F.col("raw_allocation") * F.col("regime_mult"), F.lit(ceiling)), F.lit(floor))
    return df.withColumn("allocation", allocation).drop("abs_dev", "peak")


def spot_curve(panel: DataFrame) -> DataFrame:
    """Adds log_equity of holding yesterday's allocation in the asset; the first bar uses its own and has no return."""
    w = by_symbol()
    held = F.coalesce(F.lag("allocation").over(w), F.col("allocation"))
    r = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    return panel.withColumn("step", F.log1p(held * r)).withColumn("log_equity", running(F.sum, "step")).drop("step")


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.withColumn("equity", F.col("close") / first_value("close"))


def risk_metrics(curves: DataFrame, keys: tuple[str, ...] = ("symbol", "series"), capital_at_risk: float = 1.0) -> DataFrame:
    """Return, CAGR, volatility, worst drawdown, Sharpe, Sortino, Calmar and return on capital at risk of each curve.

    `curves` has the keys, bar_date and equity. Years are points / 252. A curve of fewer than two points, or one that
    does not start above 0, has zeros. Ratios without spread or loss are 0.
    """
    w = Window.partitionBy(*keys).orderBy("bar_date")
    df = curves.where(F.col("equity").isNotNull()).withColumn("r", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1)
    df = df.withColumn("dd", F.try_divide(F.col("equity"), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    df = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("equity", "bar_date").alias("e0"), F.max_by("equity", "bar_date").alias("e1"), F.avg("r").alias("m"),
        F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"), F.coalesce(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)).alias("down"), F.min("dd").alias("mdd"),
    )
    ok = (F.col("n") >= 2) & (F.col("e0") > 0)
    zero = lambda c: F.when(ok, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    total = F.try_divide(F.col("e1"), F.col("e0")) - 1
    cagr = F.pow(F.try_divide(F.col("e1"), F.col("e0")), F.lit(float(YEAR)) / F.col("n")) - 1
    root = F.sqrt(F.lit(float(YEAR)))
    car = capital_at_risk if capital_at_risk > 0 else 1.0
    return df.select(
        *keys, zero(total * 100).alias("total_return"), zero(cagr * 100).alias("cagr"), zero(F.col("sd") * root * 100).alias("vol"), zero(F.col("mdd") * 100).alias("max_drawdown"),
        zero(F.when(F.col("sd") > 0, F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)) * root)).alias("sharpe"), zero(F.when(F.col("down") > 0, F.col("m") / F.nullif(F.col("down"), F.lit(0.0)) * root)).alias("sortino"),
        zero(F.when(F.col("mdd") < 0, cagr / F.abs(F.nullif(F.col("mdd"), F.lit(0.0))))).alias("calmar"), F.lit(car * 100).alias("capital_at_risk"), zero(total / car * 100).alias("return_at_risk"),
    )


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Number, hit rate, mean win and loss and Sharpe (by trades, times the root of 252) of trade returns `ret`."""
    r = F.col("ret")
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), (100 * F.avg(F.when(r > 0, 1.0).otherwise(0.0))).alias("hit_rate"), F.coalesce(100 * F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(100 * F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.try_divide(F.avg(r), F.nullif(F.stddev_samp(r), F.lit(0.0))) * F.sqrt(F.lit(float(YEAR))), F.lit(0.0)).alias("sharpe"),
    )


def calibration(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Mean forecast, mean outcome and number by equal bins of the forecast; bins without forecasts have nulls and 0.
    The last bin is closed."""
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull() & ~F.isnan(p) & ~F.isnan(y))
    found = known.groupBy(*keys, F.least(F.floor(F.col(p) * bins + 1e-9), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"), F.count("*").alias("n"))
    every = known.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def brier(df: DataFrame, p: str = "p", y: str = "y", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Brier score of the forecasts and of always forecasting the base rate."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), F.var_pop(y).alias("climatology"), F.avg(p).alias("mean_p"), F.avg(y).alias("base_rate"))


def quality_verdict(sound: Column, ai_prob: Column) -> Column:
    """Sound, and not known to be machine-written with a probability of 0.85 or more."""
    return sound & (ai_prob.isNull() | (ai_prob < 0.85))
