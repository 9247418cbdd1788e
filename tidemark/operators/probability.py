"""Move probabilities from forward returns, unconditional or on days that resemble today's benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import bar_number, by_symbol

QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def forward(h: int, col: str = "close") -> Column:
    """Percent return over the next `h` bars; null for the last `h`."""
    return (F.try_divide(F.lead(col, h).over(by_symbol()), F.col(col)) - 1) * 100


def grid(df: DataFrame, horizons: list[int], magnitudes: list[float]) -> DataFrame:
    """(symbol, horizon, magnitude, up_prob, down_prob, n): one window pass and one aggregate, whatever the grid's size.

    A horizon that no bar of a symbol reaches has no row.
    """
    df = df.select("symbol", *[forward(h).alias(f"r{h}") for h in horizons])
    long = df.select("symbol", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"r{h}").alias("r")) for h in horizons])).alias("x")).select("symbol", "x.*").where("r is not null")
    share = lambda c: 100 * F.avg(F.when(c, 1.0).otherwise(0.0))
    cells = F.array(*[F.struct(F.lit(float(m)).alias("magnitude"), share(F.col("r") >= m).alias("up_prob"), share(F.col("r") <= -m).alias("down_prob")) for m in magnitudes])
    return long.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), cells.alias("cells")).select("symbol", "horizon", "n", F.explode("cells").alias("x")).select("symbol", "horizon", "x.*", "n")


def ranked_quantiles(df: DataFrame, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Floor-index quantiles: of n sorted values the one at floor(n q). By rank in a window, so no group is an array."""
    df = df.where(F.col(r).isNotNull())
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(r)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = df.select(*keys, r, at.alias("at"), n.alias("n"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("at") == F.floor(F.col("n") * q), F.col(r))).alias(k) for k, q in QUANTILES.items()])


def result(df: DataFrame, magnitude: float, direction: str, r: str = "r", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Probability of a move and the distribution that it comes from. No returns, no row."""
    if direction not in ("UP", "DOWN", "EITHER"):
        raise ValueError(f"direction {direction!r} is not UP, DOWN or EITHER")
    x = F.col(r)
    hit = {"UP": x >= magnitude, "DOWN": x <= -magnitude, "EITHER": F.abs(x) >= magnitude}[direction]
    df = df.where(x.isNotNull())
    one = df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("count"), F.count_if(x > 0).alias("up_count"), F.count_if(x < 0).alias("down_count"),
        F.avg(x).alias("avg_return"), F.max(x).alias("best"), F.min(x).alias("worst"),
    )
    return one.join(ranked_quantiles(df, r, keys), list(keys)).withColumn("prob", 100 * F.col("count") / F.col("total"))


def summary(df: DataFrame) -> DataFrame:
    """Last, highest and lowest close, distance from them, trailing returns and worst drawdown of each symbol.

    Trailing returns go back one bar less than their name says (a 5-bar week from the fifth bar from the end) and are 0
    where the series is no longer than that.
    """
    w = by_symbol()
    back = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}
    peak = F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("dd", F.col("close") / peak - 1).withColumns({f"b{k}": F.lag("close", n - 1).over(w) for k, n in back.items()})
    last = lambda c: F.max_by(c, "bar_date")
    out = df.groupBy("symbol").agg(F.count("*").alias("n"), last("close").alias("current"), F.max("close").alias("high"), F.min("close").alias("low"), (100 * F.min("dd")).alias("max_drawdown"), *[last(f"b{k}").alias(f"b{k}") for k in back])
    change = lambda c: (F.col("current") / F.col(c) - 1) * 100
    trailing = [F.when(F.col("n") > n, change(f"b{k}")).otherwise(0.0).alias(f"return_{k}") for k, n in back.items()]
    return out.select("symbol", "current", "high", "low", change("high").alias("pct_from_high"), change("low").alias("pct_from_low"), *trailing, "max_drawdown")


def period_predictions(df: DataFrame, start: str, end: str, horizons: list[int], magnitudes: list[float]) -> DataFrame:
    """Within [start, end]: mean and median forward return and move shares by horizon, with what came after the window."""
    w = by_symbol()
    inside = F.col("bar_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    last_in = F.max(F.when(inside, F.col("bar_date"))).over(Window.partitionBy("symbol"))
    df = df.withColumn("inside", inside).withColumn("end_bar", F.col("bar_date") == last_in)
    rows = []
    for h in horizons:
        ahead = F.lead("close", h).over(w)
        rows.append(F.struct(F.lit(h).alias("horizon"), F.when(F.lead("inside", h).over(w), (ahead / F.col("close") - 1) * 100).alias("r"), F.when(F.col("end_bar"), (ahead / F.col("close") - 1) * 100).alias("actual")))
    long = df.select("symbol", "inside", F.array(*rows).alias("xs")).where("inside").select("symbol", F.explode("xs").alias("x")).select("symbol", "x.*")
    x = F.col("r")
    share = lambda c: 100 * F.avg(F.when(x.isNotNull(), F.when(c, 1.0).otherwise(0.0)))
    moves = F.map_from_arrays(F.array(*[F.lit(float(m)) for m in magnitudes]), F.array(*[F.struct(share(x >= m).alias("up"), share(x <= -m).alias("down")) for m in magnitudes]))
    return long.groupBy("symbol", "horizon").agg(F.count("r").alias("total"), F.avg("r").alias("avg_return"), F.percentile("r", F.lit(0.5)).alias("median_return"), F.max("actual").alias("actual_return"), moves.alias("moves")).where("total > 0")


def analogues(pair: DataFrame, horizon: int, lookback: int = 21, narrow: tuple[float, float] = (5.0, 0.3), wide: tuple[float, float] = (10.0, 0.5), enough: int = 5) -> DataFrame:
    """Forward returns on days whose benchmark return over `lookback` bars was close to the last one.

    Close is max(5, 0.3 |r|) points; with fewer than `enough` matches, max(10, 0.5 |r|). Both are counted in one pass.
    Adds br, current, tolerance and r; symbols with fewer than three matches are left out.
    """
    w, every = by_symbol(), Window.partitionBy("symbol")
    df = pair.withColumn("rn", bar_number()).withColumn("br", (F.col("bench") / F.lag("bench", lookback).over(w) - 1) * 100).withColumn("r", forward(horizon))
    df = df.withColumn("current", F.max_by("br", "bar_date").over(every)).where("br is not null and r is not null")
    gap, size = F.abs(F.col("br") - F.col("current")), F.abs("current")
    tight, loose = F.greatest(F.lit(narrow[0]), size * narrow[1]), F.greatest(F.lit(wide[0]), size * wide[1])
    df = df.withColumn("tolerance", F.when(F.count_if(gap <= tight).over(every) >= enough, tight).otherwise(loose)).where(gap <= F.col("tolerance"))
    return df.withColumn("matches", F.count("*").over(every)).where("matches >= 3")


def window_analogues(pair: DataFrame, start: str, end: str, horizons: list[int], magnitudes: list[float], lookback: int = 21, enough: int = 3) -> DataFrame:
    """Within [start, end]: what followed on days whose benchmark return over `lookback` bars was close to that at the window's end.

    Only bars of the window count, for the benchmark's return and for what follows. Close is max(5, 0.3 |r|) points; with
    fewer than `enough` matches of a horizon max(10, 0.5 |r|); with fewer even then the horizon has no row. actual_return is what
    came after the window, null where the bars end before. One row per symbol and horizon, all from one pass.
    """
    w, every = by_symbol(), Window.partitionBy("symbol")
    inside = F.col("bar_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    held = lambda c, h: F.lead(c, h).over(w)
    df = pair.withColumn("inside", inside).withColumn("last_in", F.max(F.when(inside, F.col("bar_date"))).over(every))
    df = df.withColumn("br", F.when(F.col("inside") & F.lag("inside", lookback).over(w), (F.col("bench") / F.lag("bench", lookback).over(w) - 1) * 100))
    rows = [F.struct(F.lit(h).alias("horizon"), F.when(held("inside", h), (held("close", h) / F.col("close") - 1) * 100).alias("r"), F.when(F.col("bar_date") == F.col("last_in"), (held("close", h) / F.col("close") - 1) * 100).alias("actual")) for h in horizons]
    df = df.select("symbol", "bar_date", "inside", "last_in", "br", F.array(*rows).alias("xs")).where("inside")
    df = df.withColumn("current", F.max(F.when(F.col("bar_date") == F.col("last_in"), F.col("br"))).over(every)).where("current is not null")
    long = df.select("symbol", "br", "current", F.explode("xs").alias("x")).select("symbol", "br", "current", "x.*")
    gap, size, r = F.abs(F.col("br") - F.col("current")), F.abs("current"), F.col("r")
    near = lambda low, share: (gap <= F.greatest(F.lit(low), size * share)) & r.isNotNull()
    long = long.withColumn("tight", near(5.0, 0.3)).withColumn("loose", near(10.0, 0.5))
    narrow = F.count_if("tight").over(Window.partitionBy("symbol", "horizon")) >= enough
    matched = F.when(F.when(narrow, F.col("tight")).otherwise(F.col("loose")), r)
    share = lambda hit: 100 * F.avg(F.when(F.col("m").isNotNull(), F.when(hit, 1.0).otherwise(0.0)))
    moves = F.map_from_arrays(F.array(*[F.lit(float(m)) for m in magnitudes]), F.array(*[F.struct(share(F.col("m") >= m).alias("up"), share(F.col("m") <= -m).alias("down")) for m in magnitudes]))
    out = long.withColumn("m", matched).groupBy("symbol", "horizon").agg(
        F.count("m").alias("total"), F.max("current").alias("bench_return"), F.avg("m").alias("avg_return"), F.percentile("m", F.lit(0.5)).alias("median_return"), F.max("actual").alias("actual_return"), moves.alias("moves")
    )
    return out.where(F.col("total") >= enough)
