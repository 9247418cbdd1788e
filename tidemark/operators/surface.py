"""Volatility surface: rejection cascade, no-arbitrage and outlier filters, per-expiry splines, grids, anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.functions.options import with_bs_price
from tidemark.operators.scattered import interpolated, nearest

RATE, LEAST_IV, CAP, LEAST_MID = 0.045, 0.05, 1.0, 1.0


def with_reason(chain: DataFrame, spot: float = 100.0, spread_cap: float = 0.25, least_oi: int = 50, least_volume: int = 1) -> DataFrame:
    """Adds mid, spread and reason: the first test that a contract fails, null if it is kept."""
    mid = (F.col("bid") + F.col("ask")) / 2
    df = chain.withColumn("mid", mid).withColumn("spread", F.try_divide(F.col("ask") - F.col("bid"), F.nullif(mid, F.lit(0.0))))
    reason = (
        F.when(F.col("dte") < 7, "short_dte").when((F.col("bid") <= 0) | (F.col("ask") <= 0) | (F.col("strike") <= 0) | (F.col("mid") <= 0), "no_quote").when(F.col("mid") < LEAST_MID, "thin_price")
        .when((F.col("kind") == "p") & (F.col("strike") < 0.5 * spot), "deep_otm_put").when(F.col("spread") > spread_cap, "spread").when((F.col("open_interest") < least_oi) | (F.col("volume") < least_volume), "liquidity")
        .when(F.col("iv").isNull() | ~F.col("iv").between(LEAST_IV, 5.0), "iv_fail")
    )
    return df.withColumn("reason", reason)


def kept(chain: DataFrame, **limits) -> DataFrame:
    return with_reason(chain, **limits).where("reason is null").drop("reason")


def _keep_in_order(df: DataFrame, keys: list[str], order: str, drops) -> DataFrame:
    """Goes through each group in order and keeps a row unless `drops`(its mid, the last kept mid). A group is one
    expiry's strikes or one strike's expiries, so it is folded as an array, without Python."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(order, *[c for c in rest if c != order])
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("xs"))
    kind = rows.schema["xs"].dataType.simpleString()

    def step(a: Column, x: Column) -> Column:
        out = a["prev"].isNotNull() & drops(x["mid"], a["prev"])
        return F.struct(F.when(out, a["prev"]).otherwise(x["mid"]).alias("prev"), F.when(out, a["rows"]).otherwise(F.array_append(a["rows"], x)).alias("rows"))

    start = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast(kind).alias("rows"))
    return rows.select(*keys, F.explode(F.aggregate("xs", start, step, lambda a: a["rows"])).alias("x")).select(*keys, "x.*")


def keep_calls_and_puts(df: DataFrame) -> DataFrame:
    """Call mids must not rise with strike nor put mids fall, against the last one kept."""
    call = F.col("kind") == "c"
    return _keep_in_order(df, ["kind", "dte"], "strike", lambda m, p: (call & (m > p + 1e-6)) | (~call & (m < p - 1e-6)))


def keep_calendar(df: DataFrame) -> DataFrame:
    """Mids must not fall by more than 0.05 with time to expiry, against the last one kept."""
    return _keep_in_order(df, ["kind", "strike"], "dte", lambda m, p: m < p - 0.05)


def no_arbitrage(df: DataFrame) -> DataFrame:
    """Contracts that keep the order by strike, then the order by time to expiry."""
    return keep_calendar(keep_calls_and_puts(df))


def local_outliers(df: DataFrame, k: int = 5, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Adds near_iv, the median iv of the `k` nearest contracts of the same kind by (moneyness / 0.05, dte / 30), and
    outlier. Kinds of up to `k` contracts have no outliers. Neighbours come from cells of a size that holds a few contracts,
    so pairs grow with contracts times `k`; they are kept as a bounded array per contract."""
    df = cut(df)  # it is read for the index, the search and the result
    key = F.struct("dte", "strike")
    points = df.select(F.col("kind").alias("g"), key.alias("p"), (F.col("mny") / 0.05).alias("x"), (F.col("dte") / 30.0).alias("y"), F.col("iv").alias("v"))
    found = nearest(points, points.withColumnRenamed("p", "q"), k, other=True, digits=9)
    near = found.select(F.col("g").alias("kind"), "q.dte", "q.strike", F.size("near").alias("near"), F.explode("near").alias("n"))
    near = near.groupBy("kind", "dte", "strike").agg(F.percentile("n.v", F.lit(0.5)).alias("near_iv"), F.first("near").alias("near"))
    ratio = F.try_divide(F.col("iv"), F.col("near_iv"))
    out = df.join(near, ["kind", "dte", "strike"], "left")
    return out.withColumn("outlier", F.coalesce((F.col("near") >= k) & (F.col("near_iv") > 0) & ~ratio.between(low, high), F.lit(False))).drop("near")


def otm_blend(df: DataFrame) -> DataFrame:
    return df.where("(kind = 'c' and mny >= 1) or (kind = 'p' and mny < 1)")


def atm_iv(df: DataFrame, targets: list[int], money: float = 0.05, days: int = 15) -> DataFrame:
    """Median iv near the money and a number of days; with nothing there, in a box twice as wide. One pass."""
    t = F.explode(F.array(*[F.lit(x) for x in targets])).alias("target")
    box = lambda f: (F.abs(F.col("mny") - 1) <= money * f) & (F.abs(F.col("dte") - F.col("target")) <= days * f)
    median = lambda f: F.percentile(F.when(box(f), F.col("iv")), F.lit(0.5))
    return df.select("mny", "dte", "iv", t).groupBy("target").agg(F.coalesce(median(1), median(2)).alias("iv"))


def skew(df: DataFrame, target: int = 30, days: int = 15) -> DataFrame:
    """Median iv of puts around 0.9 less that of calls around 1.1; null with under four contracts or one side empty."""
    near = df.where(F.abs(F.col("dte") - target) <= days)
    put = F.when((F.col("kind") == "p") & F.col("mny").between(0.85, 0.95), F.col("iv"))
    call = F.when((F.col("kind") == "c") & F.col("mny").between(1.05, 1.15), F.col("iv"))
    return near.agg(F.when(F.count("*") >= 4, F.percentile(put, F.lit(0.5)) - F.percentile(call, F.lit(0.5))).alias("skew"))


def second_derivatives(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the natural cubic spline through (x, y), x ascending: its second derivatives, and the factors (d, l) of the
    tridiagonal system R = L D L' that gives them. One sweep forward, one back."""
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    diagonal, off, right = (h[:-1] + h[1:]) / 3, h[1:-1] / 6, np.diff(slope)
    d, low, z = np.empty(n - 2), np.zeros(n - 2), np.empty(n - 2)
    for i in range(n - 2):
        low[i] = off[i - 1] / d[i - 1] if i else 0.0
        d[i] = diagonal[i] - (low[i] * off[i - 1] if i else 0.0)
        z[i] = right[i] - (low[i] * z[i - 1] if i else 0.0)
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = z[i] / d[i] - (low[i + 1] * m[i + 2] if i < n - 3 else 0.0)
    return m, d, low


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y), x ascending, at other places; not a number outside."""
    h, m = np.diff(x), second_derivatives(x, y)[0]
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    a, b = x[i + 1] - at, at - x[i]
    out = (m[i] * a**3 + m[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * a + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b
    return np.where((at < x[0] - 1e-12) | (at > x[-1] + 1e-12), np.nan, out)


def without_each(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the natural spline through all other points has at each inner point, from one factorisation.

    The spline's energy is y' Q R^-1 Q' y, Q the second differences. With y_i free its least lies (Q m)_i / (Q R^-1 Q')_ii below
    y_i. Row i of Q has three entries, so only the inverse's diagonal and the two beside it count; they follow
    from the factors backwards.
    """
    n, h = len(x), np.diff(x)
    m, d, low = second_derivatives(x, y)
    k = n - 2
    v0, v1, v2 = np.zeros(k + 2), np.zeros(k + 2), np.zeros(k + 2)  # entries (i, i), (i, i + 1), (i, i + 2) of the inverse
    up = np.append(low[1:], [0.0, 0.0, 0.0])
    for i in range(k - 1, -1, -1):
        v2[i] = -up[i] * v1[i + 1]
        v1[i] = -up[i] * v0[i + 1]
        v0[i] = 1 / d[i] - up[i] * v1[i]
    out = np.full(n, np.nan)
    for i in range(1, n - 1):
        entries = [(i - 2, 1 / h[i - 1]), (i - 1, -1 / h[i - 1] - 1 / h[i]), (i, 1 / h[i])]
        entries = [(j, q) for j, q in entries if 0 <= j < k]
        own = sum(q * m[j + 1] for j, q in entries)
        weight = sum(q * r * (v0, v1, v2)[abs(j - g)][min(j, g)] for j, q in entries for g, r in entries)
        out[i] = y[i] - own / weight
    return out


def spline_fit(df: DataFrame, mode: str = "interpolate", spot: float = 100.0) -> DataFrame:
    """Adds fitted_iv and residual (relative, capped at 1) from a spline of iv over log-moneyness per (kind, dte).

    'interpolate' runs the spline through the points that it scores, so residuals are about 0; 'loo' leaves each inner
    point out of its own fit, which takes five distinct strikes. Expiries of under four distinct strikes, and fits below
    0.05, have null. The work grows with the strikes of an expiry, which are one group.
    """
    x = F.ln(F.col("strike") / (spot * F.exp(RATE * F.greatest(F.col("dte"), F.lit(1)) / 365.0)))
    df = df.withColumn("log_money", x)
    schema = ", ".join([*(f"{c} {k}" for c, k in df.dtypes), "fitted_iv double"])

    def fitted(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("log_money")
        one = g.drop_duplicates("log_money")
        x, y, at = one["log_money"].to_numpy(), one["iv"].to_numpy(), g["log_money"].to_numpy()
        fit = np.full(len(g), np.nan)
        if len(x) >= (4 if mode == "interpolate" else 5):
            fit = natural_spline(x, y, at) if mode == "interpolate" else without_each(x, y)[np.searchsorted(x, at)]
        with np.errstate(invalid="ignore"):
            return g.assign(fitted_iv=pd.Series(np.where(fit >= LEAST_IV, fit, np.nan), index=g.index))

    out = df.groupBy("kind", "dte").applyInPandas(fitted, schema).withColumn("fitted_iv", F.nanvl("fitted_iv", F.lit(None).cast("double")))
    residual = F.greatest(F.least(F.try_divide(F.col("iv") - F.col("fitted_iv"), F.col("fitted_iv")), F.lit(CAP)), F.lit(-CAP))
    return out.withColumn("residual", F.when(F.col("fitted_iv").isNotNull(), residual))


def cleaned(df: DataFrame, mode: str = "interpolate", **bounds: float) -> tuple[DataFrame, DataFrame]:
    """(fit, counts): contracts without outliers and arbitrage and their spline, and what each stage has left of each kind.

    Counts are observed on the one run that makes the fit, which is checkpointed: no stage is run again for them. counts has kind, pre,
    outliers, no_arb (call_mono or put_mono, and calendar, by rule) and final.
    """
    seen = [Observation() for _ in range(4)]

    def watched(stage: DataFrame, o: Observation) -> DataFrame:
        return stage.observe(o, *[F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0)).alias(k) for k in ("c", "p")])

    judged = cut(local_outliers(df, **bounds))
    stage = watched(watched(judged, seen[0]).where("not outlier").drop("outlier", "near_iv"), seen[1])
    stage = watched(keep_calls_and_puts(stage), seen[2])
    fit = cut(spline_fit(watched(keep_calendar(stage), seen[3]), mode))
    rows = []
    for kind, rule in (("c", "call_mono"), ("p", "put_mono")):
        pre, inliers, monotone, final = (o.get[kind] for o in seen)
        rows.append((kind, pre, pre - inliers, inliers - final, inliers - monotone if rule == "call_mono" else 0, inliers - monotone if rule == "put_mono" else 0, monotone - final, final))
    return fit, df.sparkSession.createDataFrame(rows, "kind string, pre long, outliers long, no_arb long, call_mono long, put_mono long, calendar long, final long")


def anomalies(fit: DataFrame, threshold: float = 0.05, spot: float = 100.0) -> DataFrame:
    """Contracts whose residual is past the threshold, with z by the spread of residuals, side (BUY below, SELL above) and
    place in the report: buys by z ascending, sells by z descending. Fits whose model price is far from the mid are passed over."""
    df = fit.where("fitted_iv is not null").withColumn("spot", F.lit(spot)).withColumn("years", F.greatest(F.col("dte"), F.lit(1)) / 365.0)
    df = with_bs_price(df, "spot", "strike", "years", "fitted_iv", rate=RATE, out="model").where((F.col("model") > 0) & (F.abs(F.col("model") - F.col("mid")) / F.greatest(F.col("mid"), F.lit(1.0)) <= 0.5))
    spread = df.groupBy("kind").agg(F.stddev_samp("residual").alias("sd"))
    z = F.when(F.coalesce("sd", F.lit(0.0)) > 0, F.col("residual") / F.nullif(F.col("sd"), F.lit(0.0))).otherwise(0.0)
    out = df.join(spread, "kind").withColumn("z", z).where(F.abs("residual") > threshold)
    out = out.withColumn("side", F.when(F.col("residual") < 0, "BUY").otherwise("SELL")).drop("sd", "spot", "years")
    # a report's rows: contracts past the threshold, of which a chain has few
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "BUY", F.col("z")).otherwise(-F.col("z")), "kind", "dte", "strike")
    return out.withColumn("place", F.row_number().over(order))


def axes(df: DataFrame, step: float = 0.02, days: int = 30, least: int = 10) -> DataFrame:
    """(kind, dte, mny): the places of the regular grid over what each kind covers; kinds of under `least` contracts have none."""
    ends = df.groupBy("kind").agg(F.count("*").alias("n"), F.min("mny").alias("m0"), F.max("mny").alias("m1"), F.min("dte").alias("d0"), F.max("dte").alias("d1")).where(F.col("n") >= least)
    ends = ends.select("kind", F.greatest("m0", F.lit(0.5)).alias("m0"), F.least("m1", F.lit(1.5)).alias("m1"), F.greatest("d0", F.lit(7)).alias("d0"), F.least("d1", F.lit(730)).alias("d1"))
    steps = lambda low, high, by: F.sequence(F.lit(0), (F.ceil((F.col(high) + by - F.col(low)) / by - 1e-9) - 1).cast("int"))
    out = ends.select("*", F.explode(steps("m0", "m1", step)).alias("i")).select("*", F.explode(steps("d0", "d1", float(days))).alias("j"))
    return out.select("kind", (F.col("d0") + days * F.col("j")).cast("int").alias("dte"), F.round(F.col("m0") + step * F.col("i"), 9).alias("mny"))


def grid(df: DataFrame, step: float = 0.02, days: int = 30) -> DataFrame:
    """(kind, dte, mny, iv): a regular surface over (moneyness, days), linear over the triangulation of the contracts, the nearest
    contract's outside their hull, within [0.1, 3].

    A kind needs ten contracts with moneyness in [0.4, 1.6]. Contracts of one strike and expiry count as their mean.
    """
    df = cut(df.where(F.col("mny").between(0.4, 1.6)).select("kind", "dte", "mny", "iv"))
    points = df.select(F.col("kind").alias("g"), F.round("mny", 9).alias("x"), F.col("dte").cast("double").alias("y"), F.col("iv").alias("v"))
    places = axes(df, step, days).select(F.col("kind").alias("g"), F.struct("dte", "mny").alias("q"), F.col("mny").alias("x"), F.col("dte").cast("double").alias("y"))
    found = interpolated(points, places)
    return found.select(F.col("g").alias("kind"), "q.dte", F.round("q.mny", 6).alias("mny"), F.greatest(F.least("v", F.lit(3.0)), F.lit(0.1)).alias("iv"))


def window_pnl(contracts: DataFrame, bars: DataFrame, cutoff: Column, hold: int, margin: int = 30) -> DataFrame:
    """`contracts` (kind, dte, strike, ...) with entry_close, exit_close, days_observed and pnl in percent: first and last close of their
    bars (kind, dte, strike, bar_date, close) in the `hold` + `margin` days up to `cutoff`, a column of the bars.

    A contract with under two bars there keeps its row without a result; an entry that is not positive has no pnl.
    """
    seen = bars.where((F.col("bar_date") <= cutoff) & (F.col("bar_date") >= F.date_sub(cutoff, hold + margin)))
    ends = seen.groupBy("kind", "dte", "strike").agg(F.min_by("close", "bar_date").alias("entry_close"), F.max_by("close", "bar_date").alias("exit_close"), F.count("*").alias("days_observed")).where("days_observed >= 2")
    pnl = F.when(F.col("entry_close") > 0, (F.col("exit_close") / F.nullif(F.col("entry_close"), F.lit(0.0)) - 1) * 100)
    return contracts.join(ends, ["kind", "dte", "strike"], "left").withColumn("pnl", pnl)
