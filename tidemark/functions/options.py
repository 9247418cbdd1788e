"""Option pricing as column expressions: normal distribution, Black-Scholes prices, implied volatility, expiry dates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Double-precision rational approximation of the cumulative normal distribution (Hart 1968, West 2005)
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT, ROOT_TWO_PI = 7.07106781186547, 2.506628274631


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def norm_cdf_sql(x: str) -> str:
    """SQL of N(x) for a column name, good to 1e-15; Spark has no error function."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {_horner(NUMERATOR, a)} / {_horner(DENOMINATOR, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / {ROOT_TWO_PI!r}"
    tail = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {SPLIT!r} THEN {near} ELSE {far} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def _norm_cdf(x: Column) -> Column:
    """The same as a column; for use on a lambda's variable, which is computed once."""
    a = F.abs(x)

    def horner(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + c
        return out

    e = F.exp(-a * a / 2)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / ROOT_TWO_PI
    tail = F.when(a > 37, 0.0).when(a < SPLIT, e * horner(NUMERATOR) / horner(DENOMINATOR)).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf(x: np.ndarray) -> np.ndarray:
    a = np.minimum(np.abs(x), 37.0)
    e = np.exp(-a * a / 2)
    near = e * np.polyval(NUMERATOR, a) / np.polyval(DENOMINATOR, a)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / ROOT_TWO_PI
    tail = np.where(np.abs(x) > 37, 0.0, np.where(a < SPLIT, near, far))
    return np.where(np.asarray(x) > 0, 1 - tail, tail)


def with_bs_price(df: DataFrame, spot: str, strike: str, years: str, sigma: str, kind: str = "kind", rate: float = 0.0, out: str = "bs") -> DataFrame:
    """Adds the Black-Scholes price of calls ('c') and puts ('p'); intrinsic value without time or volatility, 0 without spot or strike."""
    s, k, t, v = (F.col(c) for c in (spot, strike, years, sigma))
    alive = (s > 0) & (k > 0) & (t > 0) & (v > 0)
    d1 = F.when(alive, (F.ln(s / k) + (rate + v * v / 2) * t) / (v * F.sqrt(t)))
    d2 = d1 - v * F.sqrt(t)
    n = F.transform(F.array(d1, d2, -d1, -d2), lambda x: F.when(x.isNotNull(), _norm_cdf(x)))
    df = df.withColumn("_n", n)
    discounted = k * F.exp(-rate * t)
    call, put = s * F.col("_n")[0] - discounted * F.col("_n")[1], discounted * F.col("_n")[3] - s * F.col("_n")[2]
    is_call = F.col(kind) == "c"
    intrinsic = F.greatest(F.when(is_call, s - k).otherwise(k - s), F.lit(0.0))
    price = F.when((s <= 0) | (k <= 0), 0.0).when(~alive, intrinsic).when(is_call, call).otherwise(put)
    return df.withColumn(out, price).drop("_n")


def bs_price(spot, strike, years, sigma, is_call, rate: float = 0.0) -> np.ndarray:
    """The same prices over arrays, for simulators that feed back on themselves."""
    s, k, t, v = (np.asarray(x, dtype=float) for x in (spot, strike, years, sigma))
    with np.errstate(all="ignore"):
        d1 = (np.log(s / k) + (rate + v * v / 2) * t) / (v * np.sqrt(t))
        d2 = d1 - v * np.sqrt(t)
        call = s * norm_cdf(d1) - k * np.exp(-rate * t) * norm_cdf(d2)
    put = call - s + k * np.exp(-rate * t)
    intrinsic = np.maximum(np.where(is_call, s - k, k - s), 0.0)
    return np.where((s <= 0) | (k <= 0), 0.0, np.where((t <= 0) | (v <= 0), intrinsic, np.where(is_call, call, put)))


def implied_vol(price: Column, spot: Column, strike: Column, years: Column, kind: Column, rate: float = 0.045, low: float = 0.01, high: float = 5.0, steps: int = 32) -> Column:
    """Volatility in [low, high] that gives a price back; null where none does, or where an argument is null or not positive.

    Newton's method from the volatility where the price bends, which closes in from one side; a step that leaves the
    bracket found so far halves it instead. The steps are a fold over a fixed sequence, so no Python runs.
    """
    usable = (spot > 0) & (strike > 0) & (years > 0) & price.isNotNull()
    root = F.sqrt(F.when(years > 0, years))
    forward = F.ln(F.when(usable, spot / F.nullif(strike, F.lit(0.0)))) + rate * years
    discounted = strike * F.exp(-rate * years)
    is_call = kind == "c"

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), body)[0]

    def at(v: Column) -> Column:
        """(price, vega) of a volatility."""
        def priced(d: Column) -> Column:
            n = F.transform(F.when(is_call, F.array(d, d - v * root)).otherwise(F.array(v * root - d, -d)), _norm_cdf)
            worth = let(n, lambda n: F.when(is_call, spot * n[0] - discounted * n[1]).otherwise(discounted * n[0] - spot * n[1]))
            return F.struct(worth.alias("price"), (spot * root * F.exp(-d * d / 2) / math.sqrt(2 * math.pi)).alias("vega"))

        return let((forward + v * v / 2 * years) / (v * root), priced)

    def step(a: Column, _: Column) -> Column:
        def moved(q: Column) -> Column:
            under = q["price"] < price
            lo, hi = F.when(under, a["v"]).otherwise(a["lo"]), F.when(under, a["hi"]).otherwise(a["v"])
            newton = a["v"] - F.try_divide(q["price"] - price, q["vega"])
            inside = F.coalesce((newton > lo) & (newton < hi), F.lit(False))
            return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(q["price"] == price, a["v"]).when(inside, newton).otherwise((lo + hi) / 2).alias("v"))

        return let(at(a["v"]), moved)

    bend = F.least(F.greatest(F.sqrt(2 * F.abs(forward) / years), F.lit(2 * low)), F.lit(high / 2))
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), bend.alias("v"))
    found = F.aggregate(F.array_repeat(F.lit(0), steps), start, step, lambda a: a["v"])
    reachable = (price > at(F.lit(low))["price"]) & (price < at(F.lit(high))["price"])
    return F.when(usable & reachable, found)


def next_opex(day: Column) -> Column:
    """Third Friday of the month after `day`'s."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(F.add_months(day, 1), "MM"), 1), "FRI"), 14)
