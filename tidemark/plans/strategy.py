"""Queries over the rule language, the call sleeve and its sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.operators import align, allocation, rules, sleeve, trades
from tidemark.plans.indicators import FILLED, RETS
from tidemark.plans.registry import BARS, BENCH, PAIR, VOLIDX, query, r6, roll
from tidemark.sources import views

W = "OVER (PARTITION BY symbol ORDER BY bar_date)"


def series(spark, sf):
    """Bars with the benchmark and the volatility index of the same date, filled forward."""
    return align.filled(align.filled(views.bars(spark, sf), views.bench_bars(spark, sf), "bench"), views.volidx_bars(spark, sf), "volidx")


def _cond(lhs, op, rhs):
    side = lambda x: {"kind": "value", "value": x} if isinstance(x, (int, float)) else {"kind": "category", "value": x[1:]} if isinstance(x, str) and x[0] == "=" else {"kind": "indicator", "indicator": x[0], "n": x[1] if len(x) > 1 else None}
    return {"lhs": side(lhs), "op": op, "rhs": side(rhs)}


CROSS = {"combinator": "AND", "conditions": [_cond(("Asset price",), "crosses above", ("SMA(N)", 50))]}
CLOSE = {"combinator": "AND", "conditions": [_cond(("Asset price",), "=", ("N-day low", 20))]}
MIXED = {"combinator": "OR", "conditions": [_cond(("N-day % change", 10), "<", -20), _cond(("Drawdown from peak (%)",), ">", -10), _cond(("Volatility index",), "crosses below", 18)]}
STRATEGY = {"entry": {"combinator": "AND", "conditions": [_cond(("N-day % change", 5), "<", -10), _cond(("RSI(N)", 14), "<", 55)]}, "exit": {"combinator": "OR", "conditions": [_cond(("RSI(N)", 14), ">", 60), _cond((rules.DAYS_HELD,), ">", 25)]}, "controls": {"max_hold": 40, "stop_pct": 30, "tp_pct": 40}}


def _signal(spark, sf, panel):
    s = rules.normalize({"entry": panel})
    return rules.evaluate(series(spark, sf), s.entry)


@query(f"""WITH {BARS}, s AS (SELECT symbol, bar_date, close, {roll('avg', 'close', 50)} AS m FROM bars)
SELECT symbol, bar_date, coalesce(close > m AND lag(close) {W} <= lag(m) {W}, false) AS signal FROM s""")
def rule_cross_above(spark, sf):
    return _signal(spark, sf, CROSS)


@query(f"WITH {BARS}, s AS (SELECT symbol, bar_date, close, {roll('min', 'close', 20)} AS m FROM bars) SELECT symbol, bar_date, coalesce(abs(close - m) <= 1e-6 + 1e-3 * abs(m), false) AS signal FROM s")
def rule_isclose(spark, sf):
    return _signal(spark, sf, CLOSE)


@query(f"""WITH {BARS}, {VOLIDX}, j AS (SELECT symbol, bar_date, (close / lag(close, 10) {W} - 1) * 100 AS ch, (close / max(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1) * 100 AS dd,
 last_value(volidx IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS v FROM bars LEFT JOIN volidx USING (bar_date))
SELECT symbol, bar_date, coalesce(ch < -20, false) OR coalesce(dd > -10, false) OR coalesce(v < 18 AND lag(v) {W} >= 18, false) AS signal FROM j""")
def rule_and_or(spark, sf):
    return _signal(spark, sf, MIXED)


@query()
def custom_sim(spark, sf):
    """Trade log of a strategy with rules on indicators and on the days held: state that SQL would fold bar by bar."""
    out = rules.simulate(series(spark, sf), rules.normalize(STRATEGY))
    return out.select("symbol", "entry_date", "exit_date", "direction", "entry_price", "exit_price", "days_held", r6("ret"), "exit_reason")


@query()
def custom_equity(spark, sf):
    bars = series(spark, sf)
    return trades.accrued(bars, rules.simulate(bars, rules.normalize(STRATEGY))).select("symbol", "bar_date", r6("log_equity"))


@query()
def call_sleeve(spark, sf):
    """Flagship: allocation, then a path-dependent option sleeve, bar by bar."""
    out = sleeve.call_sleeve(views.pair(spark, sf))
    return out.select("symbol", "bar_date", *[r6(c) for c in ("equity", "sleeve_value", "cash_value", "target", "actual", "sigma", "contracts")], "rolled")


@query()
def sleeve_metrics(spark, sf):
    """Risk metrics of the sleeve, of holding the asset and of the benchmark."""
    out = sleeve.call_sleeve(views.pair(spark, sf))
    three = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(c).alias("equity")) for k, c in (("sleeve", "equity"), ("asset", "close"), ("bench", "bench"))])).alias("x")
    return allocation.risk_metrics(out.select("symbol", "bar_date", three).select("symbol", "bar_date", "x.*"), capital_at_risk=0.2)


SIZES = f"{PAIR}, sz AS (SELECT symbol, count(*) AS n FROM pair GROUP BY 1)"


@query(f"""WITH {SIZES}, e AS (SELECT symbol, n, least(len, n)::INT AS window_len FROM sz, (VALUES (126), (252), (504), (1260), (2520)) AS l(len))
SELECT DISTINCT symbol, window_len, start FROM (SELECT symbol, window_len, unnest(range(0, n - window_len + 1, 126))::INT AS start FROM e UNION ALL SELECT symbol, window_len, (n - window_len)::INT FROM e)""")
def sweep_plan(spark, sf):
    return sleeve.plan(views.pair(spark, sf).groupBy("symbol").agg(F.count("*").alias("n")))


WINDOWS = f"""{SIZES}, e AS (SELECT symbol, n, least(len, n)::INT AS window_len FROM sz, (VALUES (126), (252), (504), (1260), (2520)) AS l(len)),
pl AS (SELECT DISTINCT symbol, window_len, start FROM (SELECT symbol, window_len, unnest(range(0, n - window_len + 1, 126))::INT AS start FROM e UNION ALL SELECT symbol, window_len, (n - window_len)::INT FROM e)),
nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS rn FROM pair)"""


@query(f"WITH {WINDOWS} SELECT symbol, window_len, start, count(*) AS n, min(bar_date) AS from_date, max(bar_date) AS to_date, round(max_by(close, rn) / min_by(close, rn) - 1, 6) AS total_return FROM pl JOIN nb USING (symbol) WHERE rn >= start AND rn < start + window_len GROUP BY 1, 2, 3")
def sweep_windows(spark, sf):
    """Every window of the sweep with its bars, by the interval join."""
    bars = trades.numbered(views.pair(spark, sf)).select("symbol", "rn", "bar_date", "close")
    plan = sleeve.plan(bars.groupBy("symbol").agg(F.count("*").alias("n")))
    rows = align.interval_join(bars, plan, ["symbol"], "rn", "start", "window_len", sleeve.STEP)
    out = rows.groupBy("symbol", "window_len", "start").agg(F.count("*").alias("n"), F.min("bar_date").alias("from_date"), F.max("bar_date").alias("to_date"), (F.max_by("close", "rn") / F.min_by("close", "rn") - 1).alias("r"))
    return out.select("symbol", "window_len", "start", "n", "from_date", "to_date", r6("r", "total_return"))


@query(f"WITH {WINDOWS} SELECT symbol, window_len, start, min(bar_date) AS from_date, max(bar_date) AS to_date FROM pl JOIN nb USING (symbol) WHERE rn = start OR rn = start + window_len - 1 GROUP BY 1, 2, 3")
def sweep_windows_sql(spark, sf):
    """The same plan from SQL, by the registered table function over bars partitioned by symbol."""
    sql.register(spark)
    return spark.sql("SELECT symbol, window_len, start, from_date, to_date FROM sweep_windows(TABLE(SELECT symbol, bar_date FROM {pair}) PARTITION BY symbol ORDER BY bar_date)", pair=views.pair(spark, sf))


@query()
def sweep_runs(spark, sf):
    return sleeve.sweep(views.pair(spark, sf))


@query()
def sweep_rollup(spark, sf):
    """The whole sweep, window x parameter, rolled up by regime, parameter and length."""
    return sleeve.rollup(sleeve.sweep(views.pair(spark, sf)))


@query()
def sweep_verdict(spark, sf):
    """The sweep in one row: hit rates, means and what they amount to."""
    return sleeve.sweep_verdict(sleeve.rollup(sleeve.sweep(views.pair(spark, sf))))
