"""Queries over single series: returns, indicators, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.rolling import rolling
from tidemark.operators import align, indicators
from tidemark.plans.registry import BARS, BENCH, PAIR, VOLIDX, query, r6, roll
from tidemark.sources import views

W = "OVER (PARTITION BY symbol ORDER BY bar_date)"
KEY = ("symbol", "bar_date")
RETS = f"r AS (SELECT *, close / lag(close) {W} - 1 AS ret, ln(close / lag(close) {W}) AS log_ret FROM bars)"


@query(f"WITH {BARS}, {RETS} SELECT symbol, bar_date, round(ret, 6) AS ret, round(log_ret, 6) AS log_ret FROM r")
def returns(spark, sf):
    return indicators.with_returns(views.bars(spark, sf)).select(*KEY, r6("ret"), r6("log_ret"))


@query(f"WITH {BARS} SELECT symbol, bar_date, round({roll('avg', 'close', 20)}, 6) AS sma FROM bars")
def sma(spark, sf):
    return views.bars(spark, sf).select(*KEY, r6(indicators.sma(20), "sma"))


@query(f"""WITH {BARS}, b AS (SELECT symbol, bar_date, close, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars)
SELECT symbol, bar_date, round((close - (m - 2 * s)) / nullif(4 * s, 0), 6) AS bollinger_b FROM b""")
def bollinger_b(spark, sf):
    return views.bars(spark, sf).select(*KEY, r6(indicators.bollinger_b(20), "bollinger_b"))


@query(f"WITH {BARS} SELECT symbol, bar_date, {roll('max', 'close', 20)} AS high_20, {roll('min', 'close', 20)} AS low_20 FROM bars")
def nday_high_low(spark, sf):
    return views.bars(spark, sf).select(*KEY, rolling(F.max, 20, "close").alias("high_20"), rolling(F.min, 20, "close").alias("low_20"))


@query(f"WITH {BARS} SELECT symbol, bar_date, round((close / lag(close, 10) {W} - 1) * 100, 6) AS change_10 FROM bars")
def nday_change(spark, sf):
    return views.bars(spark, sf).select(*KEY, r6(indicators.change(10), "change_10"))


@query(f"WITH {BARS}, {RETS} SELECT symbol, bar_date, round(({roll('stddev_samp', 'log_ret', 30)}) * sqrt(252) * 100, 6) AS rv_30 FROM r")
def realized_vol(spark, sf):
    return indicators.with_returns(views.bars(spark, sf)).select(*KEY, r6(indicators.realized_vol(30), "rv_30"))


@query(f"WITH {BARS} SELECT symbol, bar_date, round((close / max(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1) * 100, 6) AS drawdown FROM bars")
def drawdown(spark, sf):
    return views.bars(spark, sf).select(*KEY, r6(indicators.drawdown(), "drawdown"))


FILLED = "f AS (SELECT symbol, bar_date, close, last_value(bench IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS bench FROM bars LEFT JOIN bench USING (bar_date))"


@query(f"WITH {BARS}, {BENCH}, {FILLED} SELECT symbol, bar_date, close, bench FROM f")
def align_ffill(spark, sf):
    return align.filled(views.bars(spark, sf), views.bench_bars(spark, sf), "bench").select(*KEY, "close", "bench")


@query(f"WITH {BARS}, {BENCH}, {FILLED} SELECT symbol, bar_date, round(close / bench * 1000, 6) AS ratio FROM f")
def ratio(spark, sf):
    return align.filled(views.bars(spark, sf), views.bench_bars(spark, sf), "bench").select(*KEY, r6(F.try_divide(F.col("close"), F.col("bench")) * 1000, "ratio"))


@query(f"""WITH {BARS}, {BENCH}, c AS (SELECT symbol, min_by(close, bar_date) AS a0, min_by(bench, bar_date) AS o0 FROM bars JOIN bench USING (bar_date) GROUP BY 1),
s AS (SELECT symbol, CASE WHEN a0 / nullif(o0, 0) > 0 THEN a0 / o0 ELSE 1 END AS scale FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN c USING (symbol))
SELECT symbol, bar_date, round(bench * scale, 6) AS overlay FROM bench, s""")
def rescale_overlay(spark, sf):
    return align.rescaled_overlay(views.bars(spark, sf), views.bench_bars(spark, sf), "bench").select(*KEY, r6("overlay"))


PERIODS = {"1D": 1, "1W": 7, "1M": 30, "1Y": 365, "5Y": 1825, "ALL": None}


@query(f"""WITH {BARS}, l AS (SELECT symbol, max(bar_date) AS last_date, max_by(close, bar_date) AS last_close, min(bar_date) AS first_date FROM bars GROUP BY 1),
t AS (SELECT symbol, period, last_close, CAST(CASE WHEN days IS NULL THEN first_date ELSE last_date - days END AS DATE) AS target
 FROM l, (VALUES ('1D', 1), ('1W', 7), ('1M', 30), ('1Y', 365), ('5Y', 1825), ('ALL', NULL)) AS p(period, days))
SELECT t.symbol, period, target, b.bar_date AS asof_date, b.close AS asof_close, round((last_close / b.close - 1) * 100, 6) AS change
FROM t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.target >= b.bar_date""")
def asof_period_changes(spark, sf):
    return align.period_changes(views.bars(spark, sf), PERIODS).withColumn("change", r6("change"))


def _ewm_sql(inputs: str, outs: dict[str, tuple[str, float]], final: str) -> str:
    """Recursive SQL of exponentially weighted means over columns of `s` (symbol, bar_date, rn, ...)."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {o}" for o, (x, _) in outs.items())
    step = ", ".join(f"CASE WHEN s.{x} IS NULL THEN e.{o} WHEN e.{o} IS NULL THEN s.{x} ELSE (1 - {a!r}) * e.{o} + {a!r} * s.{x} END" for o, (x, a) in outs.items())
    return f"""WITH RECURSIVE {BARS}, s AS MATERIALIZED (SELECT symbol, bar_date, row_number() {W} AS rn, {inputs} FROM bars),
e AS (SELECT symbol, bar_date, rn, {seed} FROM s WHERE rn = 1 UNION ALL SELECT s.symbol, s.bar_date, s.rn, {step} FROM e JOIN s ON s.symbol = e.symbol AND s.rn = e.rn + 1)
SELECT symbol, bar_date, {final} FROM e"""


@query(_ewm_sql("close", {"a": ("close", 2 / 21)}, "round(a, 6) AS ema_20"))
def ema(spark, sf):
    return indicators.ema(views.bars(spark, sf), [20]).select(*KEY, r6("ema_20"))


@query(_ewm_sql("close", {"a": ("close", 2 / 13), "b": ("close", 2 / 27)}, "round(a - b, 6) AS macd"))
def macd(spark, sf):
    return indicators.ema(views.bars(spark, sf), [12, 26]).select(*KEY, r6(F.col("ema_12") - F.col("ema_26"), "macd"))


@query(_ewm_sql(f"greatest(close - lag(close) {W}, 0) + 0 * (close - lag(close) {W}) AS up, greatest(lag(close) {W} - close, 0) + 0 * (close - lag(close) {W}) AS down", {"u": ("up", 1 / 14), "d": ("down", 1 / 14)}, "round(100 - 100 / (1 + u / nullif(d, 0)), 6) AS rsi"))
def rsi_wilder(spark, sf):
    return indicators.rsi(views.bars(spark, sf)).select(*KEY, r6("rsi"))


@query(_ewm_sql(f"greatest(high - low, coalesce(abs(high - lag(close) {W}), 0), coalesce(abs(low - lag(close) {W}), 0)) AS tr", {"a": ("tr", 1 / 14)}, "round(a, 6) AS atr"))
def atr_wilder(spark, sf):
    return indicators.atr(views.bars(spark, sf)).select(*KEY, r6("atr"))


def _vs_bench(base, n):
    """z-score of the 20-bar residual against a rolling beta on the benchmark, over `n` bars."""
    from tidemark.operators.dislocation import beta

    lr = base.withColumn("ra", F.ln(F.col("close") / indicators.prev())).withColumn("rb", F.ln(F.col("bench") / indicators.prev("bench")))
    res = lr.withColumn("res", F.col("ra") - beta(20) * F.col("rb"))
    cum = res.withColumn("cum", rolling(F.sum, 20, "res"))
    return cum.withColumn("z", F.try_divide(F.col("cum") - rolling(F.avg, n, "cum"), rolling(F.stddev_samp, n, "cum")))


@query(f"""WITH {BARS}, {BENCH}, {FILLED}, l AS (SELECT symbol, bar_date, ln(close / lag(close) {W}) AS ra, ln(bench / lag(bench) {W}) AS rb FROM f),
x AS (SELECT *, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN ra END AS pa, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN rb END AS pb FROM l),
b AS (SELECT *, ra - ({roll('covar_samp', 'pa, pb', 20)}) / nullif({roll('var_samp', 'rb', 20)}, 0) * rb AS res FROM x),
c AS (SELECT *, {roll('sum', 'res', 20)} AS cum FROM b)
SELECT symbol, bar_date, round((cum - {roll('avg', 'cum', 60)}) / nullif({roll('stddev_samp', 'cum', 60)}, 0), 6) AS z FROM c""")
def zscore_vs_bench(spark, sf):
    base = align.filled(views.bars(spark, sf), views.bench_bars(spark, sf), "bench")
    return _vs_bench(base, 60).select(*KEY, r6("z"))


def _pct(x: str, q: float) -> str:
    w = "OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {w} >= 60 THEN quantile_cont({x}, {q}) {w} END"


REGIME = f"""v AS (SELECT *, ({roll('stddev_samp', 'log_ret', 30)}) * sqrt(252) AS rv, row_number() {W} - 1 AS rn FROM r),
q AS (SELECT *, {_pct('rv', 0.33)} AS lo, {_pct('rv', 0.67)} AS hi FROM v)"""


@query(f"""WITH {BARS}, {RETS}, {REGIME} SELECT symbol, bar_date, CASE WHEN rn >= 282 AND rv <= lo + 1e-9 THEN 'CHEAP' WHEN rn >= 282 AND rv >= hi - 1e-9 THEN 'EXPENSIVE' ELSE 'MID-RANGE' END AS regime FROM q""")
def vol_regime_label(spark, sf):
    return indicators.vol_regime(views.bars(spark, sf)).select(*KEY, "regime")


@query(f"""WITH {BARS}, {VOLIDX}, j AS (SELECT symbol, bar_date, last_value(volidx IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) AS v, row_number() {W} - 1 AS rn FROM bars LEFT JOIN volidx USING (bar_date)),
q AS (SELECT *, {_pct('v', 0.25)} AS lo, {_pct('v', 0.75)} AS hi FROM j)
SELECT symbol, bar_date, CASE WHEN rn >= 252 AND v <= lo + 1e-9 THEN 'BUY' WHEN rn >= 252 AND v >= hi - 1e-9 THEN 'SELL' ELSE 'NEUTRAL' END AS signal FROM q""")
def volidx_signal(spark, sf):
    return indicators.index_signal(views.bars(spark, sf).join(views.volidx_bars(spark, sf), "bar_date", "left")).select(*KEY, "signal")


@query(f"""WITH {BARS}, h AS (SELECT symbol, bar_date, (close / lag(close, 20) {W} - 1) * 100 AS rh, row_number() {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, bar_date, round(CASE WHEN rn >= 524 AND rn < n - 21 THEN avg(CASE WHEN abs(rh) >= 10 THEN 1.0 WHEN rh IS NOT NULL THEN 0.0 END) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 484 PRECEDING AND 1 PRECEDING) END, 6) AS prob FROM h""")
def prob_pit(spark, sf):
    return indicators.with_prob_pit(views.bars(spark, sf), 10.0, 20).select(*KEY, r6("prob"))


@query(f"""WITH {BARS}, h AS (SELECT symbol, bar_date, (close / lag(close, 20) {W} - 1) * 100 AS r, row_number() {W} - 1 AS rn FROM bars)
SELECT a.symbol, a.bar_date, CASE WHEN a.rn >= 80 AND count(b.r) >= 30 AND any_value(a.r) IS NOT NULL THEN round(100.0 * count(*) FILTER (b.r <= a.r) / count(b.r), 6) END AS pctile
FROM h a LEFT JOIN h b ON a.symbol = b.symbol AND b.rn < a.rn GROUP BY a.symbol, a.bar_date, a.rn""")
def period_pctile(spark, sf):
    return indicators.period_percentile(views.bars(spark, sf), 20).select(*KEY, r6("pctile"))
