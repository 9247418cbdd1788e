"""Technical and point-in-time indicators, one row per bar: window expressions where possible, one grouped map for EWM.

Each takes bars (symbol, bar_date, close, ...) and adds columns; windows are partitioned by symbol.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import bar_number, by_symbol, rolling, running, trailing_percentile

YEAR = 252
#: Slack of comparisons with an interpolated percentile, so that equal values count as equal.
TIE = 1e-9


def prev(col: str = "close", n: int = 1) -> Column:
    return F.lag(col, n).over(by_symbol())


def with_returns(df: DataFrame) -> DataFrame:
    """Adds ret and log_ret; null on a symbol's first bar."""
    return df.withColumn("ret", F.try_divide(F.col("close"), prev()) - 1).withColumn("log_ret", F.ln(F.try_divide(F.col("close"), prev())))


def sma(n: int, col: str = "close") -> Column:
    return rolling(F.avg, n, col)


def bollinger_b(n: int, col: str = "close") -> Column:
    sd = rolling(F.stddev_samp, n, col)
    lower = sma(n, col) - 2 * sd
    return F.try_divide(F.col(col) - lower, 4 * sd)


def change(n: int, col: str = "close") -> Column:
    """Percent change over `n` bars."""
    return (F.try_divide(F.col(col), prev(col, n)) - 1) * 100


def realized_vol(n: int, log_ret: str = "log_ret") -> Column:
    return rolling(F.stddev_samp, n, log_ret) * F.sqrt(F.lit(YEAR)) * 100


def drawdown(col: str = "close") -> Column:
    return (F.col(col) / running(F.max, col) - 1) * 100


#: Days of a chunk of a series; a chunk is one group, however long the series is.
CHUNK_DAYS = 1024
#: Unknown values in a row after which the old mean has no weight left in doubles.
FADED = 20_000


def _carried(x: np.ndarray, alpha: float) -> dict[str, float | int | None]:
    """What a chunk does to the mean that comes in: unknown values before its first known one, that value, then the line
    slope * mean + shift, and the unknown values at its end."""
    known = np.nonzero(~np.isnan(x))[0]
    if not len(known):
        return {"lead": len(x), "first": None, "slope": None, "shift": None, "trail": 0}
    w = (1 - alpha) ** np.diff(known)
    slope = float(np.prod(w / (w + alpha)))
    last = float(pd.Series(x[known[0] :]).ewm(alpha=alpha, adjust=False).mean().iloc[-1])
    return {"lead": int(known[0]), "first": float(x[known[0]]), "slope": slope, "shift": last - slope * float(x[known[0]]), "trail": int(len(x) - 1 - known[-1])}


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], keep: str = "symbol, bar_date", chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Exponentially weighted means, not adjusted, seeded with the first known value; an unknown one keeps the mean and lets it fade.

    `specs` maps an output column to (input column, alpha). A mean is an affine map of the one before, and so is a
    chunk of `chunk_days` days: chunks say what they do to the mean that comes in, one task a symbol composes these few
    rows, and each chunk is smoothed from its own seed. A symbol's bars are thus split over tasks.
    """
    inputs = sorted({c for c, _ in specs.values()})
    names = [c.strip() for c in keep.split(",")]
    kinds = dict(df.dtypes)
    rows = df.select(*names, *[c for c in inputs if c not in names]).withColumn("chunk", F.floor(F.datediff("bar_date", F.lit("1970-01-01").cast("date")) / chunk_days))

    def effects(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bar_date")
        return pd.DataFrame([{"symbol": g["symbol"].iloc[0], "chunk": g["chunk"].iloc[0], "spec": k, **_carried(g[c].to_numpy(dtype="float64", na_value=np.nan), a)} for k, (c, a) in enumerate(specs.values())])

    alphas = [a for _, a in specs.values()]

    def composed(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for spec, one in g.sort_values(["spec", "chunk"]).groupby("spec"):
            mean, gap, a = np.nan, 0, alphas[spec]
            for r in one.itertuples():
                out.append((r.symbol, r.chunk, int(spec), mean, gap))
                if pd.isna(r.first):
                    gap += int(r.lead)
                    continue
                w = (1 - a) ** (gap + int(r.lead) + 1)
                start = r.first if np.isnan(mean) else (w * mean + a * r.first) / (w + a)
                mean, gap = r.slope * start + r.shift, int(r.trail)
        return pd.DataFrame(out, columns=["symbol", "chunk", "spec", "mean", "gap"])

    symbol = kinds["symbol"]
    made = rows.groupBy("symbol", "chunk").applyInPandas(effects, f"symbol {symbol}, chunk bigint, spec int, lead bigint, first double, slope double, shift double, trail bigint")
    seeds = made.groupBy("symbol").applyInPandas(composed, f"symbol {symbol}, chunk bigint, spec int, mean double, gap bigint")
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), *(f"{c} double" for c in specs)])

    def smoothed(g: pd.DataFrame, seed: pd.DataFrame) -> pd.DataFrame:
        g, seed = g.sort_values("bar_date"), seed.set_index("spec")
        out = g[names].copy()
        for k, (name, (c, a)) in enumerate(specs.items()):
            mean, gap = seed.loc[k, "mean"], int(seed.loc[k, "gap"])
            before = [] if pd.isna(mean) else [mean] + [np.nan] * min(gap, FADED)
            x = pd.Series(np.concatenate([before, g[c].to_numpy(dtype="float64", na_value=np.nan)]))
            out[name] = x.ewm(alpha=a, adjust=False).mean().to_numpy()[len(before) :]
        return out

    return rows.groupBy("symbol", "chunk").cogroup(seeds.groupBy("symbol", "chunk")).applyInPandas(smoothed, schema)


def ema(df: DataFrame, spans: list[int]) -> DataFrame:
    return ewm(df, {f"ema_{n}": ("close", 2 / (n + 1)) for n in spans})


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI; null where there was no fall."""
    d = F.col("close") - prev()
    moves = df.withColumn("up", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).withColumn("down", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))))
    out = ewm(moves, {"up_avg": ("up", 1 / n), "down_avg": ("down", 1 / n)})
    return out.select("symbol", "bar_date", (100 - 100 / (1 + F.try_divide(F.col("up_avg"), F.nullif(F.col("down_avg"), F.lit(0.0))))).alias("rsi"))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's average true range on raw high, low and close."""
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev()), F.abs(F.col("low") - prev()))
    return ewm(df.withColumn("tr", tr), {"atr": ("tr", 1 / n)})


def vol_regime(df: DataFrame, lookback: int = YEAR, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """CHEAP, MID-RANGE or EXPENSIVE: 30-bar realised volatility against its own last `lookback` values before today."""
    df = with_returns(df).withColumn("rv", rolling(F.stddev_samp, 30, "log_ret") * F.sqrt(F.lit(YEAR)))
    df = df.withColumn("rn", bar_number()).withColumn("lo", trailing_percentile("rv", low, lookback, 60)).withColumn("hi", trailing_percentile("rv", high, lookback, 60))
    label = F.when((F.col("rn") >= lookback + 30) & (F.col("rv") <= F.col("lo") + TIE), "CHEAP").when((F.col("rn") >= lookback + 30) & (F.col("rv") >= F.col("hi") - TIE), "EXPENSIVE").otherwise("MID-RANGE")
    return df.withColumn("regime", label)


def index_signal(df: DataFrame, lookback: int = YEAR, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """BUY, SELL or NEUTRAL: the volatility index (column volidx, filled forward) against its last `lookback` values."""
    df = df.withColumn("v", F.last("volidx", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", bar_number())
    lo, hi = trailing_percentile("v", low, lookback, 60), trailing_percentile("v", high, lookback, 60)
    df = df.withColumn("lo", lo).withColumn("hi", hi)
    return df.withColumn("signal", F.when((F.col("rn") >= lookback) & (F.col("v") <= F.col("lo") + TIE), "BUY").when((F.col("rn") >= lookback) & (F.col("v") >= F.col("hi") - TIE), "SELL").otherwise("NEUTRAL"))


def exceedance_prob(magnitude: float, horizon: int, train: int = 504) -> Column:
    """Share of |horizon-bar returns| >= magnitude (percent) that ended within the last `train` - horizon bars before
    today; known from bar train + horizon on, and not for the last horizon + 1 bars. Needs columns rh, rn and n."""
    w = by_symbol().rowsBetween(-(train - horizon), -1)
    share = F.avg(F.when(F.abs("rh") >= magnitude, 1.0).when(F.col("rh").isNotNull(), 0.0)).over(w)
    return F.when((F.col("rn") >= train + horizon) & (F.col("rn") < F.col("n") - horizon - 1), share)


def with_prob_pit(df: DataFrame, magnitude: float, horizon: int, train: int = 504) -> DataFrame:
    n = F.count("*").over(by_symbol().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumn("rh", change(horizon)).withColumn("rn", bar_number()).withColumn("n", n)
    return df.withColumn("prob", exceedance_prob(magnitude, horizon, train))


def earlier_no_greater(x: np.ndarray) -> np.ndarray:
    """For each value the number of earlier ones that are no greater, by merging sorted halves: n log^2 n comparisons at most."""
    n, narrow = len(x), 64
    out = np.zeros(n, dtype=np.int64)
    for a in range(0, n, narrow):
        part = x[a : a + narrow]
        out[a : a + narrow] = np.tril(part[None, :] <= part[:, None], -1).sum(axis=1)
    while narrow < n:
        for a in range(narrow, n, 2 * narrow):
            out[a : a + narrow] += np.searchsorted(np.sort(x[a - narrow : a]), x[a : a + narrow], side="right")
        narrow *= 2
    return out


def period_percentile(df: DataFrame, n: int) -> DataFrame:
    """Percent of earlier n-bar returns that are no greater than today's; from bar 4n on, with 30 earlier ones.

    A symbol's returns are one grouped map, which counts by merging; a window over all earlier bars would compare every pair.
    """
    kinds = dict(df.dtypes)

    def ranked(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bar_date")
        r = g["r"].to_numpy(dtype="float64", na_value=np.nan)
        known = np.nonzero(~np.isnan(r))[0]
        out = np.full(len(r), np.nan)
        before = np.arange(len(known))
        told = (known >= 4 * n) & (before >= 30)
        out[known[told]] = 100.0 * earlier_no_greater(r[known])[told] / before[told]
        return g[["symbol", "bar_date"]].assign(pctile=out)

    found = df.select("symbol", "bar_date", change(n).alias("r")).groupBy("symbol").applyInPandas(ranked, f"symbol {kinds['symbol']}, bar_date date, pctile double")
    return found.withColumn("pctile", F.nanvl("pctile", F.lit(None).cast("double")))
