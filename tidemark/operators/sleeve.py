"""Call-option sleeve: a path-dependent simulation beside cash, and exhaustive sweeps over windows and parameters.

The simulation feeds back on its own state, so a run is a grouped map; the runs of one window share its bars and go
forward together, as lanes of one array. Parallelism comes from symbols x windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.options import bs_price
from tidemark.functions.sql import LENGTHS, STEP
from tidemark.operators.align import interval_join
from tidemark.operators.allocation import YEAR, panel

#: Windows of one length that are simulated together.
LANES = 32
PARAMS = {"10% sleeve": 0.10, "20% sleeve": 0.20, "30% sleeve": 0.30}


def volatility(close: np.ndarray, window: int, low: float, high: float) -> np.ndarray:
    """Annual rolling volatility of log returns of each lane (the first return counts as 0), over at most half the
    series, filled back and forward, within bounds."""
    r = pd.DataFrame(np.vstack([np.zeros((1, close.shape[1])), np.diff(np.log(close), axis=0)]))
    n = max(2, min(window, max(2, len(close) // 2)))
    return (r.rolling(n, min_periods=2).std() * np.sqrt(YEAR)).bfill().ffill().fillna(0.5).clip(low, high).to_numpy()


def simulate(close: np.ndarray, allocation: np.ndarray, shares: np.ndarray, expiry: int = 45, roll_at: int = 10, moneyness: float = 1.0, vol_window: int = 30, low: float = 0.2, high: float = 2.0) -> dict[str, np.ndarray]:
    """Bars x lanes arrays of equity, sleeve, cash, actual, contracts, rolled, target and sigma, from bars x lanes of
    close and allocation and each lane's share.

    A lane puts its share of equity, times yesterday's allocation, into calls of `expiry` bars, sells them when
    `roll_at` bars are left or they are worthless, and sells down when the sleeve is above its target.
    """
    n, lanes = close.shape
    sigma, expiry, roll_at = volatility(close, vol_window, low, high), max(int(expiry), 5), max(int(roll_at), 1)
    target = allocation[np.maximum(np.arange(n) - 1, 0)]
    strike_new = close * moneyness
    premium = bs_price(close, strike_new, expiry / 365, sigma, True)
    cash, held, strike, end = np.ones(lanes), np.zeros(lanes), np.ones(lanes), np.full(lanes, -1)
    out = {k: np.zeros((n, lanes)) for k in ("equity", "sleeve", "cash", "actual", "contracts", "rolled")}
    for i in range(n):
        left = end - i
        price = np.where(held > 0, bs_price(close[i], strike, np.where(left > 0, np.maximum(left / 365, 1e-6), 0.0), sigma[i], True), 0.0)
        sleeve = held * price
        roll = (held > 0) & ((left <= roll_at) | (price <= 1e-6))
        cash = np.where(roll, cash + sleeve, cash)
        held, sleeve = np.where(roll, 0.0, held), np.where(roll, 0.0, sleeve)
        wanted = (cash + sleeve) * shares * target[i]
        opens = (held == 0) & (premium[i] > 1e-6) & (wanted > 1e-9)
        trims = (held > 0) & (price > 1e-6) & (wanted < sleeve)
        strike, end = np.where(opens, strike_new[i], strike), np.where(opens, i + expiry, end)
        cash = np.where(opens, cash - wanted, np.where(trims, cash + sleeve - wanted, cash))
        held = np.where(opens, wanted / np.maximum(premium[i], 1e-300), np.where(trims, wanted / np.maximum(price, 1e-300), held))
        sleeve = np.where(opens | trims, wanted, sleeve)
        equity = cash + sleeve
        for k, v in (("equity", equity), ("sleeve", sleeve), ("cash", cash), ("actual", np.divide(sleeve, equity, out=np.zeros_like(sleeve), where=equity > 0)), ("contracts", held / 100), ("rolled", roll)):
            out[k][i] = v
    return out | {"target": target, "sigma": sigma}


def call_sleeve(pair: DataFrame, share: float = 0.2, **params) -> DataFrame:
    """One row per bar: (symbol, bar_date, close, bench, allocation, equity, sleeve_value, cash_value, target, actual, sigma, contracts, rolled)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bar_date")
        s = {k: v[:, 0] for k, v in simulate(g[["close"]].to_numpy(), g[["allocation"]].to_numpy(), np.array([share]), **params).items()}
        return g.assign(equity=s["equity"], sleeve_value=s["sleeve"], cash_value=s["cash"], target=s["target"], actual=s["actual"], sigma=s["sigma"], contracts=s["contracts"], rolled=s["rolled"] > 0)

    rows = panel(pair).select("symbol", "bar_date", "close", "bench", "allocation")
    schema = f"symbol {dict(rows.dtypes)['symbol']}, bar_date date, close double, bench double, allocation double, equity double, sleeve_value double, cash_value double, target double, actual double, sigma double, contracts double, rolled boolean"
    return rows.groupBy("symbol").applyInPandas(run, schema)


def plan(sizes: DataFrame, lengths: tuple[int, ...] = LENGTHS, step: int = STEP) -> DataFrame:
    """(symbol, window_len, start) of every window over series of `n` bars: each length at every step, and at the end;
    lengths that are not shorter than the series are the whole series, once."""
    each = sizes.select("symbol", "n", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("len")).withColumn("window_len", F.least(F.col("len"), F.col("n")).cast("int"))
    last = (F.col("n") - F.col("window_len")).cast("int")
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))
    return each.select("symbol", "window_len", F.explode(starts).alias("start")).distinct()


def _metrics(equity: np.ndarray, at_risk: float) -> dict[str, float]:
    r, n = equity[1:] / equity[:-1] - 1, len(equity)
    sd = r.std(ddof=1) if n > 2 else 0.0
    total, dd = equity[-1] / equity[0] - 1, (equity / np.maximum.accumulate(equity) - 1).min()
    cagr = (equity[-1] / equity[0]) ** (YEAR / n) - 1
    return {"tr": total * 100, "cagr": cagr * 100, "sharpe": r.mean() / sd * np.sqrt(YEAR) if sd > 0 else 0.0, "calmar": cagr / abs(dd) if dd < 0 else 0.0, "maxdd": dd * 100, "rar": total / at_risk * 100}


def regime(total_return: Column) -> Column:
    return F.when(total_return > 20, "bull").when(total_return < -20, "bear").otherwise("sideways")


FIELDS = ("tr", "cagr", "sharpe", "calmar", "maxdd", "rar")


def sweep(pair: DataFrame, params: dict[str, float] = PARAMS, lengths: tuple[int, ...] = LENGTHS, step: int = STEP) -> DataFrame:
    """One row per window and parameter: metrics of the sleeve, of holding the asset and of the benchmark, and which won.

    Windows meet their bars by symbol and buckets of the bar number. Windows of one length go
    through the simulation together, LANES at most in a group, so groups stay bounded however long a series is. A
    window of under two bars has no row. A run with a metric that is not finite has one with `error` and without metrics;
    `rollup` counts the others.
    """
    from tidemark.operators.trades import numbered

    bars = numbered(pair).select("symbol", "rn", "n", "bar_date", "close", "bench")
    windows = plan(bars.groupBy("symbol").agg(F.count("*").alias("n")), lengths, step)
    cut = interval_join(bars.drop("n"), windows, ["symbol"], "rn", "start", "window_len", step)
    cut = cut.select("symbol", "window_len", "start", F.floor(F.col("start") / (LANES * step)).alias("block"), "bar_date", "close", "bench")
    share, labels = np.array(list(params.values())), list(params)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["start", "bar_date"])
        length, starts = int(g["window_len"].iloc[0]), g["start"].unique()
        if length < 2:
            return pd.DataFrame([], columns=names)
        close, bench = (g[c].to_numpy().reshape(len(starts), length).T for c in ("close", "bench"))
        dates = g["bar_date"].to_numpy().reshape(len(starts), length)
        allocation = np.column_stack([window_allocation(close[:, j], bench[:, j]) for j in range(len(starts))])
        lanes = np.repeat(np.arange(len(starts)), len(share))
        s = simulate(close[:, lanes], allocation[:, lanes], np.tile(share, len(starts)))
        rows = []
        for j, start in enumerate(starts):
            hold, base = _metrics(close[:, j], 1.0), _metrics(bench[:, j], 1.0)
            for p, label in enumerate(labels):
                lane = j * len(share) + p
                m = _metrics(s["equity"][:, lane], share[p])
                wrong = [f"{k}_{of}" for of, x in (("strat", m), ("asset", hold)) for k in FIELDS if not np.isfinite(x[k])]
                values = [None] * (2 * len(FIELDS) + 1) if wrong else [*(m[k] for k in FIELDS), *(hold[k] for k in FIELDS), base["tr"]]
                rows.append([g["symbol"].iloc[0], length, int(start), dates[j, 0], dates[j, -1], length, label, share[p], *values, int(s["rolled"][:, lane].sum()), f"not finite: {', '.join(wrong)}" if wrong else None])
        return pd.DataFrame(rows, columns=names)

    names = ["symbol", "window_len", "start", "from_date", "to_date", "n_days", "param", "share", *(f"{k}_strat" for k in FIELDS), *(f"{k}_asset" for k in FIELDS), "tr_bench", "rolls", "error"]
    kinds = ["string", "int", "int", "date", "date", "int", "string", *["double"] * (2 * len(FIELDS) + 2), "int", "string"]
    out = cut.groupBy("symbol", "window_len", "block").applyInPandas(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    beats = {f"beat_{k}": F.col(f"{k}_strat") > F.col(f"{k}_asset") for k in ("tr", "sharpe", "calmar", "maxdd")}
    return out.withColumns(beats | {"beat_bench": F.col("tr_strat") > F.col("tr_bench"), "positive": F.col("tr_strat") > 0, "regime": regime(F.col("tr_asset"))})


def window_allocation(close: np.ndarray, bench: np.ndarray, floor: float = 0.1, ceiling: float = 0.9, sensitivity: float = 2.0, bear: float = 0.4, fall: float = 0.1, share: float = 0.25) -> np.ndarray:
    """allocation.panel of one window, over arrays."""
    dev = close / close[0] - bench / bench[0]
    scale = np.maximum(np.cumsum(np.abs(dev)) / np.arange(1, len(dev) + 1), 0.01)
    raw = (floor + ceiling) / 2 + (ceiling - floor) / 2 * np.tanh(-sensitivity * dev / scale)
    peak = pd.Series(bench).rolling(max(2, round(len(bench) * share)), min_periods=1).max().to_numpy()
    return np.clip(raw * np.where(bench / peak - 1 <= -fall, bear, 1.0), floor, ceiling)


def rollup(runs: DataFrame) -> DataFrame:
    """Hit rates and means overall and by regime, parameter and window length: one pass of grouping sets. A regime that
    does not occur has a row of zeros."""
    rate = lambda c: 100 * F.avg(F.col(c).cast("int"))
    runs = runs.where("error is null").withColumn("excess", F.col("tr_strat") - F.col("tr_asset"))
    dims = ["regime", "param", "window_len"]
    out = runs.groupingSets([[], *([d] for d in dims)], *dims).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), *[rate(c).alias(f"{c}_rate") for c in ("beat_tr", "beat_bench", "beat_sharpe", "beat_calmar", "beat_maxdd", "positive")],
        *[F.avg(c).alias(f"avg_{c}") for c in ("tr_strat", "tr_asset", "rar_strat", "rar_asset")], F.percentile("excess", F.lit(0.5)).alias("median_excess"),
    )
    dim = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "regime").when(F.col("g") == 5, "param").otherwise("window_len")
    value = F.coalesce(F.col("regime"), F.col("param"), F.col("window_len").cast("string"), F.lit("all"))
    out = out.select(dim.alias("dimension"), value.alias("value"), *[c for c in out.columns if c not in (*dims, "g")])
    every = runs.sparkSession.createDataFrame([("overall", "all"), *(("regime", r) for r in ("bull", "bear", "sideways"))], "dimension string, value string")
    missing = every.join(out, ["dimension", "value"], "left_anti").select("*", *[F.lit(0).cast(out.schema[c].dataType).alias(c) for c in out.columns[2:]])
    return out.unionByName(missing)


def sweep_verdict(overall: DataFrame) -> DataFrame:
    edge = F.col("avg_rar_strat") - F.col("avg_rar_asset")
    beat = F.col("beat_tr_rate")
    text = F.when(F.col("n") == 0, "inconclusive").when((beat >= 50) | (edge > 5), "meaningful edge").when((beat >= 35) & (edge > 0), "competitive on capital efficiency").when((beat < 25) & (edge <= 0), "underperforms holding").otherwise("mixed")
    return overall.where("dimension = 'overall'").withColumn("verdict", text)


def history(runs: DataFrame, share: float = 0.2, last: int = 500) -> DataFrame:
    """The last bars of each symbol's sleeve for a report: values in units of the start, shares and volatility in percent."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("bar_date").desc()))
    percent = lambda c, digits=2: F.round(100 * F.col(c), digits)
    out = runs.withColumn("newest", newest).where(F.col("newest") <= last)
    return out.select(
        "symbol", "bar_date", F.round("cash_value", 4).alias("cash"), F.round("sleeve_value", 4).alias("sleeve"), F.round("equity", 4).alias("total"), percent("target").alias("target_fill"),
        F.round(100 * F.col("actual") / max(share, 1e-9), 2).alias("actual_fill"), percent("actual").alias("calls_of_notional"), percent("sigma", 1).alias("sigma"), F.round("contracts", 2).alias("contracts"),
    )


def diagnostics(runs: DataFrame) -> DataFrame:
    """One row a symbol: mean share of the sleeve where there is equity, roll events and mean volatility used, in percent."""
    held = F.try_divide(F.col("sleeve_value"), F.nullif(F.col("equity"), F.lit(0.0)))
    return runs.groupBy("symbol").agg((100 * F.avg(held)).alias("mean_sleeve"), F.count_if(F.col("rolled")).alias("rolls"), (100 * F.avg("sigma")).alias("mean_sigma"))


def efficiency(metrics: DataFrame, of: str = "sleeve", against: str = "asset", ratio: str = "return_at_risk") -> DataFrame:
    """(symbol, efficiency): return for the capital at risk of one series over that of another; null where the other's is zero."""
    side = lambda name: F.max(F.when(F.col("series") == name, F.col(ratio)))
    return metrics.groupBy("symbol").agg(F.try_divide(side(of), F.nullif(side(against), F.lit(0.0))).alias("efficiency"))

