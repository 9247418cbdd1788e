"""What a report says about results: verdicts, labels, positions, horizons, summaries. All are column expressions or one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.surface import keep_calls_and_puts, no_arbitrage

YEAR = 252
UNITS = {"days": 1, "weeks": 5, "months": 21, "years": 252}
MAGNITUDES = (5.0, 10.0, 15.0, 20.0, 30.0, 50.0)


def trading_days(value: Column, unit: Column) -> Column:
    """A horizon in bars: a day counts at least once, an unknown unit leaves the number as it is."""
    out = value
    for name, n in UNITS.items():
        out = F.when(unit == name, F.greatest(value, F.lit(1)) if n == 1 else value * n).otherwise(out)
    return out


def since(df: DataFrame, as_of: Column, months: int, date_col: str = "bar_date") -> DataFrame:
    """Rows of the last months before `as_of`."""
    return df.where(F.col(date_col) >= F.add_months(as_of, -months))


def earliest(as_of: Column, years: int) -> Column:
    """The first day that a vendor of so many years has."""
    return F.date_sub(as_of, 365 * years)


def probability_verdict(direction: Column, prob: Column) -> Column:
    """What a share of past periods, in percent, means for a move down, up or either way."""
    down = F.when(prob < 25, "historically unlikely").when(prob < 50, "moderate risk").otherwise("elevated risk")
    up = F.when(prob > 60, "strong tailwind").when(prob > 35, "decent odds").otherwise("a big move")
    return F.when(direction == "DOWN", down).when(direction == "UP", up).otherwise(F.when(prob > 60, "high volatility").otherwise("as often as that"))


def one_in(prob: Column) -> Column:
    """The chance as one in so many; null for none."""
    return F.round(F.try_divide(F.lit(100.0), prob)).cast("int")


def deviation_label(deviation: Column) -> Column:
    return F.when(deviation < -0.01, "oversold").when(deviation > 0.01, "overbought").otherwise("near baseline")


def headline(panel: DataFrame, share: float = 0.2) -> DataFrame:
    """Per symbol the latest allocation with its regime and label, and the part of all money that the sleeve gets."""
    last = panel.groupBy("symbol").agg(F.max_by(F.struct("bar_date", "allocation", "deviation", "regime_mult"), "bar_date").alias("x")).select("symbol", "x.*")
    regime = F.when(F.col("regime_mult") < 1.0, "BEAR").otherwise("Normal")
    return last.select("symbol", "bar_date", "allocation", (F.col("allocation") * share).alias("of_all"), regime.alias("regime"), deviation_label(F.col("deviation")).alias("label"))


def closest_bucket(actual: Column, magnitudes: tuple[float, ...] = MAGNITUDES) -> Column:
    """Number of the largest magnitude that a move reaches; 0 also for those below the first."""
    return F.greatest(sum((F.abs(actual) >= m).cast("int") for m in magnitudes) - 1, F.lit(0))


def range_positions(returns: DataFrame, keys: tuple[str, ...] = ("symbol",), col: str = "ret") -> DataFrame:
    """Where the 5th percentile, the median and the 95th lie between the worst and the best return, in percent of the way.

    Without a range they lie at 5, 50 and 95. Null returns do not count."""
    ends = returns.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.min(col).alias("worst"), F.max(col).alias("best"), *[F.percentile(col, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)])

    def at(q: int) -> Column:
        way = (F.col(f"q{q}") - F.col("worst")) / F.nullif(F.col("best") - F.col("worst"), F.lit(0.0)) * 100
        return F.coalesce(F.least(F.greatest(way, F.lit(0.0)), F.lit(100.0)), F.lit(float(q))).alias(f"at_{q}")

    return ends.select(*keys, "worst", "best", at(5), at(50), at(95))


def beyond(returns: DataFrame, limit: float = 5.0, keys: tuple[str, ...] = ("symbol",), col: str = "ret") -> DataFrame:
    """Shares of returns at or beyond the limit, up and down, in percent."""
    share = lambda hit: F.avg(F.when(hit, 100.0).otherwise(0.0))
    return returns.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), share(F.col(col) >= limit).alias("up"), share(F.col(col) <= -limit).alias("down"))


def term_slope(atm: DataFrame, near: int = 30, far: int = 90) -> DataFrame:
    """One row: at-the-money volatility at `far` days less that at `near`, in points."""
    iv = lambda t: F.max(F.when(F.col("target") == t, F.col("iv")))
    return atm.agg(((iv(far) - iv(near)) * 100).alias("slope"))


def contract_label(kind: Column, strike: Column, expiry: Column) -> Column:
    """$100 Call Jan 2024."""
    return F.format_string("$%.0f %s %s", strike, F.when(kind == "c", "Call").otherwise("Put"), F.date_format(expiry, "MMM yyyy"))


def no_arbitrage_drops(df: DataFrame) -> DataFrame:
    """(rule, dropped): how many contracts each no-arbitrage rule drops, in their order."""
    counts = lambda d: d.groupBy("kind").agg(F.count("*").alias("n"))
    before, after, last = counts(df), counts(keep_calls_and_puts(df)), no_arbitrage(df).agg(F.count("*").alias("n"))
    named = lambda d, sign: d.select(F.when(F.col("kind") == "c", "call_mono").otherwise("put_mono").alias("rule"), (F.col("n") * sign).alias("n"))
    calendar = after.select(F.lit("calendar").alias("rule"), "n").unionByName(last.select(F.lit("calendar").alias("rule"), (-F.col("n")).alias("n")))
    none = df.sparkSession.createDataFrame([(r, 0) for r in ("call_mono", "put_mono", "calendar")], "rule string, n bigint")
    return named(before, 1).unionByName(named(after, -1)).unionByName(calendar).unionByName(none).groupBy("rule").agg(F.sum("n").alias("dropped"))


def profit_stats(pnl: DataFrame, col: str = "pnl") -> DataFrame:
    """One row of a set of results in percent: contracts, mean, median, share of wins, best and worst; zeros for none."""
    p = F.col(col)
    some = lambda c: F.coalesce(c, F.lit(0.0))
    return pnl.where(p.isNotNull()).agg(
        F.count("*").alias("contracts"), some(F.avg(p)).alias("mean_pnl"), some(F.percentile(p, F.lit(0.5))).alias("median_pnl"), some(F.avg(F.when(p > 0, 100.0).otherwise(0.0))).alias("win_rate"),
        some(F.max(p)).alias("best"), some(F.min(p)).alias("worst"),
    )


def windows_of_sweep(n: Column, lengths: tuple[int, ...], step: int) -> Column:
    """How many windows a sweep over n bars has, estimated."""
    return sum(F.greatest(F.ceil((n - k) / step), F.lit(0)) for k in lengths)


def equity_stats(curves: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "bar_date", col: str = "equity") -> DataFrame:
    """Total return, CAGR, worst drawdown, Sharpe, hit rate, mean win and loss and number of returns of equity curves.

    Null equity is left out; a curve of under two points has no row; a return below 1e-12 is none. One window by key serves all columns.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    e = F.col(col)
    df = curves.where(e.isNotNull()).select(*keys, order, e, F.round(e / F.lag(col).over(w) - 1, 12).alias("r"), (e / F.max(col).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("dd"))
    r = F.col("r")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by(e, order).alias("first"), F.max_by(e, order).alias("last"), (F.min("dd") * 100).alias("max_drawdown"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
        F.avg(F.when(r > 0, 100.0).when(r.isNotNull(), 0.0)).alias("hit_rate"), F.coalesce(100 * F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(100 * F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"), F.count(r).alias("trades"),
    ).where("n >= 2")
    grown = F.col("last") / F.col("first")
    return out.select(*keys, ((grown - 1) * 100).alias("total_return"), ((F.pow(grown, YEAR / F.col("n")) - 1) * 100).alias("cagr"), "max_drawdown", F.coalesce(F.try_divide("mean", F.nullif("std", F.lit(0.0))) * F.sqrt(F.lit(float(YEAR))), F.lit(0.0)).alias("sharpe"), "hit_rate", "avg_win", "avg_loss", "trades")


def signed_percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f%%", x)


def dollars(x: Column) -> Column:
    return F.format_string("$%,.2f", x)
