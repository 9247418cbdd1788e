"""Rule language: strategies as JSON documents over named indicators, compiled to columns and traded bar by bar."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rolling import by_symbol, rolling
from tidemark.operators import indicators as ind

OPERATORS = (">", "<", "=", "crosses above", "crosses below")
DAYS_HELD = "Days held in position"


@dataclass(frozen=True)
class Indicator:
    """How an indicator is computed: by a column of (n, n2) over bars with close, bench and volidx, or by a whole frame."""

    name: str
    n: float | None = None
    n2: float | None = None
    column: Callable[[int | float | None, int | float | None], Column] | None = None
    frame: Callable[[DataFrame, int | float | None, int | float | None], DataFrame] | None = None
    values: tuple[str, ...] = ()


def _z(df: DataFrame, n, _):
    from tidemark.operators.dislocation import beta

    df = df.withColumn("ra", F.ln(F.col("close") / ind.prev())).withColumn("rb", F.ln(F.col("bench") / ind.prev("bench")))
    df = df.withColumn("res", F.col("ra") - beta(20) * F.col("rb")).withColumn("cum", rolling(F.sum, 20, "res"))
    n = int(n)
    return df.select("symbol", "bar_date", F.try_divide(F.col("cum") - rolling(F.avg, n, "cum"), rolling(F.stddev_samp, n, "cum")).alias("v"))


def _of(col: str, make: Callable[[DataFrame], DataFrame]):
    return lambda df, n, n2: make(df).select("symbol", "bar_date", F.col(col).alias("v"))


def _signal(df: DataFrame) -> DataFrame:
    return ind.index_signal(df)


CATALOG: dict[str, Indicator] = {i.name: i for i in (
    Indicator("Asset price", column=lambda n, m: F.col("close")),
    Indicator("Benchmark price", column=lambda n, m: F.col("bench")),
    Indicator("Volatility index", column=lambda n, m: F.col("volidx")),
    Indicator("SMA(N)", 50, column=lambda n, m: ind.sma(int(n))),
    Indicator("EMA(N)", 20, frame=lambda df, n, m: ind.ema(df, [int(n)]).withColumnRenamed(f"ema_{int(n)}", "v")),
    Indicator("RSI(N)", 14, frame=lambda df, n, m: ind.rsi(df, int(n)).withColumnRenamed("rsi", "v")),
    Indicator("MACD", frame=lambda df, n, m: ind.ema(df, [12, 26]).select("symbol", "bar_date", (F.col("ema_12") - F.col("ema_26")).alias("v"))),
    Indicator("Bollinger %B(N)", 20, column=lambda n, m: ind.bollinger_b(int(n))),
    Indicator("N-day high", 30, column=lambda n, m: rolling(F.max, int(n), "close")),
    Indicator("N-day low", 30, column=lambda n, m: rolling(F.min, int(n), "close")),
    Indicator("N-day % change", 30, column=lambda n, m: ind.change(int(n))),
    Indicator("Realized vol(N)", 30, frame=lambda df, n, m: ind.with_returns(df).select("symbol", "bar_date", ind.realized_vol(int(n)).alias("v"))),
    Indicator("ATR(N)", 14, frame=lambda df, n, m: ind.atr(df, int(n)).withColumnRenamed("atr", "v")),
    Indicator("Drawdown from peak (%)", column=lambda n, m: ind.drawdown()),
    Indicator("Asset/benchmark ratio", column=lambda n, m: F.try_divide(F.col("close"), F.col("bench"))),
    Indicator("Asset z-score vs benchmark(N)", 60, frame=_z),
    Indicator(DAYS_HELD),
    Indicator("Vol Regime Label", frame=_of("regime", ind.vol_regime), values=("CHEAP", "MID-RANGE", "EXPENSIVE")),
    Indicator("Surface Signal (Calls)", frame=_of("signal", _signal), values=("BUY", "SELL", "NEUTRAL")),
    Indicator("Surface Signal (Puts)", frame=_of("signal", _signal), values=("BUY", "SELL", "NEUTRAL")),
    Indicator("Move Probability P(M%, Hd)", 10.0, 30, frame=lambda df, n, m: ind.with_prob_pit(df, float(n), int(m)).select("symbol", "bar_date", F.col("prob").alias("v"))),
    Indicator("Period Percentile(N)", 30, frame=lambda df, n, m: ind.period_percentile(df, int(n)).withColumnRenamed("pctile", "v")),
)}


@dataclass(frozen=True)
class Side:
    indicator: str | None = None
    n: float | None = None
    n2: float | None = None
    value: float | str | None = None

    @property
    def categorical(self) -> bool:
        return isinstance(self.value, str) or bool(self.indicator in CATALOG and CATALOG[self.indicator].values)


@dataclass(frozen=True)
class Condition:
    lhs: Side
    op: str
    rhs: Side

    @property
    def dynamic(self) -> bool:
        return DAYS_HELD in (self.lhs.indicator, self.rhs.indicator)


@dataclass(frozen=True)
class Panel:
    conditions: tuple[Condition, ...] = ()
    combinator: str = "AND"


@dataclass(frozen=True)
class Strategy:
    entry: Panel
    exit: Panel = field(default_factory=Panel)
    max_hold: int | None = 60
    stop_pct: float | None = 15.0
    tp_pct: float | None = 30.0
    direction: str = "Long"


# fixed values: names that documents use for the same indicators
ALIASES = {
    "SOXL price": "Asset price", "QQQ price": "Benchmark price", "VIX level": "Volatility index", "SOXL/QQQ ratio": "Asset/benchmark ratio", "SOXL z-score vs QQQ(N)": "Asset z-score vs benchmark(N)",
    "Days held in position": DAYS_HELD, "Vol Surface Signal (Calls)": "Surface Signal (Calls)", "Vol Surface Signal (Puts)": "Surface Signal (Puts)",
    "Probability Engine P(M%, Hd)": "Move Probability P(M%, Hd)", "Period Analysis Percentile(N)": "Period Percentile(N)",
}


def catalog(spark) -> DataFrame:
    """(name, default_n, default_n2, categorical, categories) of every indicator that a rule may name."""
    rows = [(i.name, float(i.n) if i.n is not None else None, float(i.n2) if i.n2 is not None else None, bool(i.values), list(i.values or ())) for i in CATALOG.values()]
    return spark.createDataFrame(rows, "name string, default_n double, default_n2 double, categorical boolean, categories array<string>")


def catalog_text() -> str:
    """The catalog as lines of text, one an indicator: what it gives and which parameters it takes."""
    def line(i: Indicator) -> str:
        if i.values:
            return f"{i.name}: categorical, one of {', '.join(i.values)}"
        if i.n2 is not None:
            return f"{i.name}: numeric, requires n (percent moved, default {i.n:g}) and n2 (days, default {i.n2:g})"
        return f"{i.name}: numeric, requires n (default {i.n:g})" if i.n is not None else f"{i.name}: numeric, no parameter"

    return "\n".join(line(i) for i in CATALOG.values())


def _side(d) -> Side | None:
    if not isinstance(d, dict):
        return None
    kind, value = d.get("kind"), d.get("value")
    if kind == "value" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return Side(value=float(value))
    if kind == "category" and isinstance(value, str):
        return Side(value=value)
    name = d.get("indicator") if isinstance(d.get("indicator"), str) else ""
    known = CATALOG.get(ALIASES.get(name, name)) if kind == "indicator" else None
    if known is None:
        return None
    return Side(known.name, d.get("n") if d.get("n") is not None else known.n, d.get("n2") if d.get("n2") is not None else known.n2)


def _panel(d) -> Panel:
    d = d if isinstance(d, dict) else {}
    found = []
    for c in d.get("conditions") or []:
        if isinstance(c, dict) and c.get("op") in OPERATORS:
            lhs, rhs = _side(c.get("lhs")), _side(c.get("rhs"))
            if lhs and rhs:
                found.append(Condition(lhs, c["op"], rhs))
    return Panel(tuple(found), "OR" if d.get("combinator") == "OR" else "AND")


def normalize(document) -> Strategy | None:
    """A strategy from a document: conditions that are not valid go, defaults are filled in; None without an entry rule."""
    if not isinstance(document, dict):
        return None
    entry, controls = _panel(document.get("entry")), document.get("controls") or {}
    if not entry.conditions:
        return None
    direction = controls.get("direction")
    return Strategy(entry, _panel(document.get("exit")), int(controls.get("max_hold") or 60), float(controls.get("stop_pct") or 15.0), float(controls.get("tp_pct") or 30.0), direction if direction in ("Long", "Short", "Both") else "Long")


def parse(text: str, begin: str = "<strategy>", end: str = "</strategy>") -> Strategy | None:
    """The strategy in a text, between markers if it has them, with or without a code fence; None if it is not JSON."""
    if begin in text and end in text:
        text = text.split(begin, 1)[1].split(end, 1)[0]
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    try:
        return normalize(json.loads(text))
    except json.JSONDecodeError:
        return None


def isclose(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-6 + 1e-3 * F.abs(b)


def compare(op: str, a: Column, b: Column, categorical: bool = False) -> Column:
    """An operator over two columns of bars; null counts as false, and categories know equality only."""
    if categorical:
        hit = a == b if op == "=" else F.lit(False)
    elif op == "=":
        hit = isclose(a, b)
    elif op in (">", "<"):
        hit = a > b if op == ">" else a < b
    else:
        w = by_symbol()
        a0, b0 = F.lag(a, 1).over(w), F.lag(b, 1).over(w)
        hit = (a > b) & (a0 <= b0) if op == "crosses above" else (a < b) & (a0 >= b0)
    return F.coalesce(hit, F.lit(False))


def with_indicators(bars: DataFrame, sides: list[Side]) -> tuple[DataFrame, dict[Side, str]]:
    """Adds one column for each indicator used; returns their names. Window indicators share one sort; the others are
    grouped maps joined by (symbol, bar_date). An indicator that is not in the catalog is null on every bar, so that a
    condition on it never holds."""
    names: dict[Side, str] = {}
    windows = {}
    for s in dict.fromkeys(sides):
        if s.indicator and s.indicator != DAYS_HELD:
            names[s] = f"i{len(names)}"
            if s.indicator not in CATALOG:
                windows[names[s]] = F.lit(None).cast("double")
            elif CATALOG[s.indicator].column:
                windows[names[s]] = CATALOG[s.indicator].column(s.n, s.n2)
    out = bars.withColumns(windows) if windows else bars
    for s, name in names.items():
        if s.indicator in CATALOG and CATALOG[s.indicator].frame:
            out = out.join(CATALOG[s.indicator].frame(bars, s.n, s.n2).withColumnRenamed("v", name), ["symbol", "bar_date"], "left")
    return out, names


def _column(s: Side, names: dict[Side, str]) -> Column:
    return F.col(names[s]) if s in names else F.lit(s.value)


def with_conditions(bars: DataFrame, panels: dict[str, Panel]) -> DataFrame:
    """Adds a boolean column {panel}_{i} for each condition that does not depend on the position."""
    every = [c for p in panels.values() for c in p.conditions]
    df, names = with_indicators(bars, [s for c in every for s in (c.lhs, c.rhs)])
    cols = {f"{k}_{i}": compare(c.op, _column(c.lhs, names), _column(c.rhs, names), c.lhs.categorical or c.rhs.categorical) for k, p in panels.items() for i, c in enumerate(p.conditions) if not c.dynamic}
    return df.withColumns(cols) if cols else df


def evaluate(bars: DataFrame, panel: Panel, name: str = "signal") -> DataFrame:
    """(symbol, bar_date, signal) of a panel that does not depend on the position; without conditions it is false."""
    df = with_conditions(bars, {"c": panel})
    cols = [F.col(f"c_{i}") for i in range(len(panel.conditions))]
    hit = reduce(lambda a, b: a & b if panel.combinator == "AND" else a | b, cols) if cols else F.lit(False)
    return df.select("symbol", "bar_date", hit.alias(name))


def _held(side: Side, days: np.ndarray) -> np.ndarray:
    return days if side.indicator == DAYS_HELD else np.full(len(days), side.value if isinstance(side.value, float) else np.nan)


def _dynamic(c: Condition, days: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A condition on the days held against a value, over the bars of one position."""
    a, b, a0, b0 = _held(c.lhs, days), _held(c.rhs, days), _held(c.lhs, before), _held(c.rhs, before)
    if c.op == "=":
        return np.abs(a - b) <= 1e-6 + 1e-3 * np.abs(b)
    return {">": a > b, "<": a < b, "crosses above": (a > b) & (a0 <= b0), "crosses below": (a < b) & (a0 >= b0)}[c.op]


def _panel_over(panel: Panel, static: dict[int, np.ndarray], at: slice, days: np.ndarray) -> np.ndarray:
    before = np.maximum(days - 1, 0)
    hits = [static[i][at] if i in static else _dynamic(c, days, before) for i, c in enumerate(panel.conditions)]
    return (np.all if panel.combinator == "AND" else np.any)(hits, axis=0) if hits else np.zeros(len(days), bool)


def trades_of(close: np.ndarray, s: Strategy, entry: dict[int, np.ndarray], exits: dict[int, np.ndarray]) -> list[tuple[int, int, str]]:
    """(entry bar, exit bar, reason) of one series, from trade to trade: a position's whole future is searched at once.

    Entries count from the second bar; exits from the bar after. Of reasons on one bar take-profit goes before stop
    before max-hold before the exit rule. A bar that closes a position may open the next; one still open at the end is
    not counted. Conditions on days held against another indicator never hold.
    """
    n, sign, out, at = len(close), -1 if s.direction == "Short" else 1, [], 1
    flat = _panel_over(s.entry, entry, slice(0, n), np.zeros(n))
    opens = np.nonzero(flat & np.isfinite(close))[0]
    while True:
        k = np.searchsorted(opens, at)
        if k == len(opens):
            return out
        e = int(opens[k])
        ahead = slice(e + 1, min(n, e + 1 + s.max_hold) if s.max_hold else n)
        move = (close[ahead] / close[e] - 1) * 100 * sign
        days = np.arange(1.0, len(move) + 1)
        tests = {
            "take_profit": move >= s.tp_pct if s.tp_pct else np.zeros(len(days), bool), "stop": move <= -s.stop_pct if s.stop_pct else np.zeros(len(days), bool),
            "max_hold": days >= s.max_hold if s.max_hold else np.zeros(len(days), bool), "exit_rule": _panel_over(s.exit, exits, ahead, days),
        }
        first = {name: int(np.argmax(hit)) for name, hit in tests.items() if hit.any()}
        if not first:
            return out
        x = min(first.values())
        out.append((e, e + 1 + x, next(name for name, i in first.items() if i == x)))
        at = e + 1 + x


def simulate(bars: DataFrame, s: Strategy) -> DataFrame:
    """Trade log of a strategy per symbol: entry_date, exit_date, direction, entry_price, exit_price, days_held, ret, exit_reason.

    Bars without a finite close are passed over: they open and close nothing and do not count as held."""
    df = with_conditions(bars, {"entry": s.entry, "exit": s.exit}).where(F.col("close").isNotNull() & ~F.isnan("close") & (F.abs("close") < F.lit(float("inf"))))
    flags = [c for c in df.columns if re.fullmatch(r"(entry|exit)_\d+", c)]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bar_date")
        static = {k: {int(c.split("_")[1]): g[c].to_numpy(bool) for c in flags if c.startswith(k)} for k in ("entry", "exit")}
        close, dates, sign = g["close"].to_numpy(float), g["bar_date"].to_numpy(), -1 if s.direction == "Short" else 1
        rows = [(g["symbol"].iloc[0], dates[a], dates[b], "SHORT" if sign < 0 else "LONG", close[a], close[b], b - a, (close[b] / close[a] - 1) * sign, why, a, b) for a, b, why in trades_of(close, s, static["entry"], static["exit"])]
        return pd.DataFrame(rows, columns=["symbol", "entry_date", "exit_date", "direction", "entry_price", "exit_price", "days_held", "ret", "exit_reason", "rn", "exit_rn"])

    return df.select("symbol", "bar_date", "close", *flags).groupBy("symbol").applyInPandas(run, "symbol string, entry_date date, exit_date date, direction string, entry_price double, exit_price double, days_held int, ret double, exit_reason string, rn int, exit_rn int")
