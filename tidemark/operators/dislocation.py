"""Dislocation of an asset from its benchmark: rolling beta, residuals, z-scores, mean-reversion events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, rolling, rolling_z

BETAS = (5, 10, 20, 60, 120)
SUMS = (1, 5, 10, 20)
STRONG, WEAK = 1.5, 0.75


def beta(n: int, ra: str = "ra", rb: str = "rb") -> Column:
    """Rolling covariance over variance of log returns; null without `n` returns or without variance."""
    both = F.col(ra).isNotNull() & F.col(rb).isNotNull()
    cov = rolling(F.covar_samp, n, F.when(both, F.col(ra)), F.when(both, F.col(rb)))
    return F.try_divide(cov, F.nullif(rolling(F.var_samp, n, rb), F.lit(0.0)))


def log_returns(pair: DataFrame) -> DataFrame:
    """Aligned log returns ra and rb of close and bench; a symbol's first bar is left out."""
    w = by_symbol()
    out = pair.withColumn("ra", F.ln(F.col("close") / F.lag("close").over(w))).withColumn("rb", F.ln(F.col("bench") / F.lag("bench").over(w)))
    return out.where("ra is not null and rb is not null")


def with_betas(df: DataFrame, windows: tuple[int, ...] = BETAS) -> DataFrame:
    return df.withColumns({f"beta_{n}": beta(n) for n in windows})


def zcube(df: DataFrame, lookback: int = 252, betas: tuple[int, ...] = BETAS, sums: tuple[int, ...] = SUMS) -> DataFrame:
    """Adds resid_b{w}, cum_b{w}_n{n} and z_b{w}_n{n}. All windows share one partitioning and order: one sort."""
    df = with_betas(df, betas)
    df = df.withColumns({f"resid_b{w}": F.col("ra") - F.col(f"beta_{w}") * F.col("rb") for w in betas})
    df = df.withColumns({f"cum_b{w}_n{n}": rolling(F.sum, n, f"resid_b{w}") for w in betas for n in sums})
    return rolling_z(df, {f"z_b{w}_n{n}": f"cum_b{w}_n{n}" for w in betas for n in sums}, lookback)


def verdict(z: Column) -> Column:
    return (
        F.when(z.isNull(), "N/A").when(z >= STRONG, "SELL").when(z >= WEAK, "WEAK SELL").when(z <= -STRONG, "BUY").when(z <= -WEAK, "WEAK BUY").otherwise("NEUTRAL")
    )


def reversion_events(df: DataFrame, z: str = "z", trigger: float = 1.5, neutral: float = 0.5, within: int = 60) -> DataFrame:
    """One row per bar with |z| > trigger that has `within` bars after it: when z first comes back to neutral or changes
    sign, and how far it moved. The bars ahead are one array of bounded length per row, so the search is one window."""
    w = by_symbol()
    df = df.where(F.col(z).isNotNull())
    ahead = F.collect_list(z).over(w.rowsBetween(1, within))
    df = df.select("symbol", "bar_date", F.col(z).alias("start_z"), F.when(F.abs(z) > trigger, ahead).alias("ahead")).where(F.size("ahead") == within)
    back = F.transform("ahead", lambda x: (F.abs(x) <= neutral) | (F.signum("start_z") * x < 0))
    df = df.withColumn("k", F.array_position(back, True))
    days = F.when(F.col("k") > 0, F.col("k"))
    end = F.element_at("ahead", F.coalesce(days, F.lit(within)).cast("int"))
    return df.select("symbol", "bar_date", "start_z", F.abs("start_z").alias("abs_start_z"), days.cast("int").alias("days_to_revert"), (F.col("k") > 0).alias("reverted"), (end - F.col("start_z")).alias("z_move"))


def reversion_lookup(events: DataFrame) -> DataFrame:
    """Events by band of |z|: number, share reverted, median days and median move; bands without events are left out."""
    a = F.col("abs_start_z")
    lo = F.when(a < 2.0, 1.5).when(a < 2.5, 2.0).when(a < 3.0, 2.5).when(a < 99.0, 3.0)
    return events.withColumn("band_lo", lo).where("band_lo is not null").groupBy("symbol", "band_lo").agg(
        F.count("*").alias("n_events"), (100 * F.avg(F.col("reverted").cast("int"))).alias("reversion_rate"),
        F.percentile("days_to_revert", F.lit(0.5)).alias("median_days"), F.percentile("z_move", F.lit(0.5)).alias("median_z_move"),
    )


def present_band(last: DataFrame, lookup: DataFrame, z: str = "composite_z") -> DataFrame:
    """`last` (symbol, z) with the row of the reversion lookup whose band holds |z|; null where |z| is below WEAK or the band
    has had no events. Bands are [1.5, 2), [2, 2.5), [2.5, 3) and [3, 99)."""
    a = F.abs(z)
    band = F.when((a >= WEAK) & (a >= 1.5), F.when(a < 2.0, 1.5).when(a < 2.5, 2.0).when(a < 3.0, 2.5).when(a < 99.0, 3.0))
    return last.withColumn("band_lo", band).join(lookup, ["symbol", "band_lo"], "left")
