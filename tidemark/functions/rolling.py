"""Rolling windows by bar count, null until the window holds as many values as it is long."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("bar_date")


def rolling(fn: Callable[..., Column], n: int, *cols: str | Column, w: WindowSpec | None = None, least: int | None = None) -> Column:
    """`fn` of the last `n` bars, the current one included; null unless at least `least` (default n) of them are known."""
    frame = (w or by_symbol()).rowsBetween(1 - n, 0)
    known = F.count(cols[0]).over(frame)
    return F.when(known >= (least or n), fn(*cols).over(frame))


def running(fn: Callable[..., Column], *cols: str | Column, w: WindowSpec | None = None) -> Column:
    return fn(*cols).over((w or by_symbol()).rowsBetween(Window.unboundedPreceding, 0))


def trailing_percentile(col: str, q: float, n: int, least: int, w: WindowSpec | None = None) -> Column:
    """Linear percentile of the `n` bars before the current one; null with fewer than `least` known values."""
    frame = (w or by_symbol()).rowsBetween(-n, -1)
    return F.when(F.count(col).over(frame) >= least, F.percentile(col, F.lit(q)).over(frame))


def first_value(col: str, w: WindowSpec | None = None) -> Column:
    return F.first(col).over((w or by_symbol()).rowsBetween(Window.unboundedPreceding, 0))


def bar_number(w: WindowSpec | None = None) -> Column:
    """0-based number of the bar within its symbol."""
    return F.row_number().over(w or by_symbol()) - 1


def rolling_z(df: DataFrame, cols: dict[str, str], n: int, w: WindowSpec | None = None) -> DataFrame:
    """Adds z-scores (output name -> input column) over the last `n` bars, the current one included; null until all are
    known and where they do not vary.

    A sliding frame is summed anew for every row, so long windows are taken as differences of running sums: the cost
    no longer grows with the window. Values are centred on their symbol's mean first, so that the sums keep their
    digits; a variance below what the running sums may have rounded away counts as none.
    """
    w = w or by_symbol()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    inputs, kept = list(dict.fromkeys(cols.values())), df.columns
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({f"_c_{c}": F.col(c) - F.avg(c).over(whole) for c in inputs})
    for k, f in (("s", lambda c: F.sum(c)), ("q", lambda c: F.sum(F.col(c) * F.col(c))), ("k", lambda c: F.count(c))):
        df = df.withColumns({f"_{k}_{c}": f(f"_c_{c}").over(so_far) for c in inputs})
    df = df.withColumns({f"_{k}0_{c}": F.coalesce(F.lag(f"_{k}_{c}", n).over(w), F.lit(0)) for c in inputs for k in "sqk"})
    out = {}
    for name, c in cols.items():
        s, q, k = (F.coalesce(F.col(f"_{x}_{c}"), F.lit(0)) - F.col(f"_{x}0_{c}") for x in "sqk")
        var = (q - s * s / n) / (n - 1)
        out[name] = F.when((k == n) & (var > 1e-14 * F.col(f"_q_{c}") / n), (F.col(f"_c_{c}") - s / n) / F.sqrt(var))
    return df.withColumns(out).select(*kept, *out)
