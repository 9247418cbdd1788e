"""Joins of series by date: inner and forward-filled alignment, as-of lookups, overlays on another's scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol


def filled(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """`left` with `col` of `right` on the same date, else of the last earlier date that `left` has too."""
    joined = left.join(right.select("bar_date", col), "bar_date", "left")
    return joined.withColumn(col, F.last(col, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))


def rescaled_overlay(asset: DataFrame, overlay: DataFrame, col: str) -> DataFrame:
    """(symbol, bar_date, overlay): every overlay value on the scale of each symbol at their first common date.

    A scale that is not finite and positive leaves the overlay as it is; so does a symbol without a common date.
    """
    common = asset.select("symbol", "bar_date", "close").join(overlay, "bar_date")
    first = common.groupBy("symbol").agg(F.min_by("close", "bar_date").alias("a0"), F.min_by(col, "bar_date").alias("o0"))
    scale = F.try_divide(F.col("a0"), F.nullif(F.col("o0"), F.lit(0.0)))
    ok = scale.isNotNull() & (scale > 0) & (scale < float("inf"))
    scales = asset.select("symbol").distinct().join(first, "symbol", "left").select("symbol", F.when(ok, scale).otherwise(1.0).alias("scale"))
    # one row per symbol against the overlay's dates: the result itself has symbols x dates rows
    return overlay.crossJoin(scales).select("symbol", "bar_date", (F.col(col) * F.col("scale")).alias("overlay"))


def asof(bars: DataFrame, targets: DataFrame) -> DataFrame:
    """`targets` (symbol, target, ...) with asof_date and asof_close of the last bar at or before target: one union and
    one window per symbol, not a join of every bar with every target."""
    extra = [c for c in targets.columns if c not in ("symbol", "target")]
    both = bars.select("symbol", F.col("bar_date").alias("at"), F.col("bar_date").alias("asof_date"), F.col("close").alias("asof_close"), F.lit(0).alias("is_target"), *[F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in extra])
    both = both.unionByName(targets.select("symbol", F.col("target").alias("at"), F.lit(1).alias("is_target"), *extra), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("at", "is_target").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return both.withColumn("asof_date", last("asof_date")).withColumn("asof_close", last("asof_close")).where("is_target = 1").select("symbol", F.col("at").alias("target"), "asof_date", "asof_close", *extra)


def period_changes(bars: DataFrame, days: dict[str, int | None]) -> DataFrame:
    """Percent change of each symbol's last close against its close some calendar days before (None: its first bar)."""
    last = bars.groupBy("symbol").agg(F.max("bar_date").alias("last_date"), F.max_by("close", "bar_date").alias("last_close"), F.min("bar_date").alias("first_date"))
    label = F.explode(F.array(*[F.struct(F.lit(k).alias("period"), F.lit(d).cast("int").alias("days")) for k, d in days.items()])).alias("x")
    targets = last.select("symbol", "last_close", "last_date", "first_date", label).select("symbol", "x.period", "last_close", F.coalesce(F.expr("date_sub(last_date, x.days)"), "first_date").alias("target"))
    found = asof(bars, targets)
    return found.select("symbol", "period", "target", "asof_date", "asof_close", ((F.try_divide(F.col("last_close"), F.col("asof_close")) - 1) * 100).alias("change"))


def tolerance(value: Column, floor: float, share: float) -> Column:
    return F.greatest(F.lit(floor), F.abs(value) * share)


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, length: str, bucket: int) -> DataFrame:
    """Points and intervals of equal `keys` with start <= at < start + length, whole numbers.

    Both meet by buckets of `bucket` numbers: an interval is repeated for each that it touches, so that it is compared
    with its own points and those of two half-filled buckets at most, however long the series is. Each pair comes
    once. Intervals of no length, or with null ends, have no points.
    """
    touched = F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(start) + F.col(length) - 1) / bucket))
    spread = intervals.where(F.col(length) > 0).withColumn("_bucket", F.explode(touched))
    near = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return near.join(spread, [*keys, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length))).drop("_bucket")
