"""Queries over allocation, equity curves, forecasts and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import allocation, dislocation, indicators, trades
from tidemark.plans.indicators import REGIME, RETS
from tidemark.plans.probability import _cube, _z
from tidemark.plans.registry import ASSET, BARS, BENCH, PAIR, VOLIDX, query, r6
from tidemark.sources import views

W = "OVER (PARTITION BY symbol ORDER BY bar_date)"
ALL = "OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING)"
PANEL = f"""{PAIR}, n AS (SELECT *, row_number() {W} AS rn, greatest(2, round_even(count(*) OVER (PARTITION BY symbol) * 0.25, 0)) AS lb, close / first_value(close) {W} AS asset_norm, bench / first_value(bench) {W} AS bench_norm FROM pair),
pk AS (SELECT a.symbol, a.bar_date, max(b.bench) AS peak FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - a.lb + 1 AND a.rn GROUP BY 1, 2),
d AS (SELECT n.*, peak, asset_norm - bench_norm AS deviation, greatest(avg(abs(asset_norm - bench_norm)) {ALL}, 0.01) AS dev_scale FROM n JOIN pk USING (symbol, bar_date)),
w AS (SELECT *, 0.5 + 0.4 * tanh(-2 * deviation / dev_scale) AS raw_allocation, CASE WHEN bench / peak - 1 <= -0.1 THEN 0.4 ELSE 1.0 END AS regime_mult FROM d),
panel AS (SELECT *, greatest(least(raw_allocation * regime_mult, 0.9), 0.1) AS allocation FROM w)"""


@query(f"WITH {PANEL} SELECT symbol, bar_date, round(asset_norm, 6) AS asset_norm, round(bench_norm, 6) AS bench_norm, round(deviation, 6) AS deviation, round(dev_scale, 6) AS dev_scale, round(raw_allocation, 6) AS raw_allocation, regime_mult, round(allocation, 6) AS allocation FROM panel")
def allocation_panel(spark, sf):
    out = allocation.panel(views.pair(spark, sf))
    return out.select("symbol", "bar_date", *[r6(c) for c in ("asset_norm", "bench_norm", "deviation", "dev_scale", "raw_allocation")], "regime_mult", r6("allocation"))


@query(f"""WITH {PANEL}, s AS (SELECT symbol, bar_date, ln(1 + coalesce(lag(allocation) {W}, allocation) * coalesce(close / lag(close) {W} - 1, 0)) AS step FROM panel)
SELECT symbol, bar_date, round(sum(step) {ALL}, 6) AS log_equity FROM s""")
def spot_allocator(spark, sf):
    return allocation.spot_curve(allocation.panel(views.pair(spark, sf))).select("symbol", "bar_date", r6("log_equity"))


@query(f"WITH {BARS} SELECT symbol, bar_date, round(close / first_value(close) {W}, 6) AS equity FROM bars")
def buy_hold(spark, sf):
    return allocation.buy_and_hold(views.bars(spark, sf)).select("symbol", "bar_date", r6("equity"))


METRICS = ("total_return", "cagr", "vol", "max_drawdown", "sharpe", "sortino", "calmar", "capital_at_risk", "return_at_risk")
RISK = f"""r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol, series ORDER BY bar_date) - 1 AS r, equity / max(equity) OVER (PARTITION BY symbol, series ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curves),
g AS (SELECT symbol, series, count(*) AS n, min_by(equity, bar_date) AS e0, max_by(equity, bar_date) AS e1, avg(r) AS m, coalesce(stddev_samp(r), 0) AS sd, coalesce(stddev_samp(CASE WHEN r < 0 THEN r END), 0) AS down, min(dd) AS mdd FROM r GROUP BY 1, 2)
SELECT symbol, series, round((e1 / e0 - 1) * 100, 6) AS total_return, round((pow(e1 / e0, 252.0 / n) - 1) * 100, 6) AS cagr, round(sd * sqrt(252) * 100, 6) AS vol, round(mdd * 100, 6) AS max_drawdown,
round(CASE WHEN sd > 0 THEN m / sd * sqrt(252) ELSE 0 END, 6) AS sharpe, round(CASE WHEN down > 0 THEN m / down * sqrt(252) ELSE 0 END, 6) AS sortino,
round(CASE WHEN mdd < 0 THEN (pow(e1 / e0, 252.0 / n) - 1) / abs(mdd) ELSE 0 END, 6) AS calmar, 20.0::DOUBLE AS capital_at_risk, round((e1 / e0 - 1) / 0.2 * 100, 6) AS return_at_risk FROM g"""


@query(f"""WITH {PAIR}, curves AS (SELECT symbol, 'asset' AS series, bar_date, close AS equity FROM pair UNION ALL SELECT symbol, 'bench', bar_date, bench FROM pair), {RISK}""")
def risk_metrics(spark, sf):
    """Both sides of each aligned pair, in one scan: the pair is unpivoted, not read twice."""
    pair = views.pair(spark, sf)
    both = F.explode(F.array(F.struct(F.lit("asset").alias("series"), F.col("close").alias("equity")), F.struct(F.lit("bench").alias("series"), F.col("bench").alias("equity")))).alias("x")
    out = allocation.risk_metrics(pair.select("symbol", "bar_date", both).select("symbol", "bar_date", "x.*"), capital_at_risk=0.2)
    return out.select("symbol", "series", *[r6(m) for m in METRICS])


FORECAST = f"""h AS (SELECT symbol, bar_date, (close / lag(close, 20) {W} - 1) * 100 AS rh, (lead(close, 20) {W} / close - 1) * 100 AS ahead, row_number() {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
fc AS (SELECT symbol, bar_date, CASE WHEN rn >= 524 AND rn < n - 21 THEN avg(CASE WHEN abs(rh) >= 30 THEN 1.0 WHEN rh IS NOT NULL THEN 0.0 END) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 484 PRECEDING AND 1 PRECEDING) END AS p,
 CASE WHEN abs(ahead) >= 30 THEN 1.0 WHEN ahead IS NOT NULL THEN 0.0 END AS y FROM h), known AS (SELECT * FROM fc WHERE p IS NOT NULL AND y IS NOT NULL)"""


def _forecasts(spark, sf):
    """Share of moves of 30 percent over 20 bars in the training window, and whether such a move came."""
    bars = indicators.with_prob_pit(views.bars(spark, sf), 30.0, 20)
    ahead = (F.lead("close", 20).over(indicators.by_symbol()) / F.col("close") - 1) * 100
    return bars.select("symbol", "bar_date", F.col("prob").alias("p"), F.when(F.abs(ahead) >= 30, 1.0).when(ahead.isNotNull(), 0.0).alias("y"))


@query(f"""WITH {BARS}, {FORECAST}, b AS (SELECT symbol, least(floor(p * 10 + 1e-9), 9)::INT AS bin, avg(p) AS mean_p, avg(y) AS mean_y, count(*) AS n FROM known GROUP BY 1, 2)
SELECT s.symbol, e.bin, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, coalesce(n, 0) AS n FROM (SELECT DISTINCT symbol FROM known) s CROSS JOIN (SELECT range::INT AS bin FROM range(10)) e LEFT JOIN b ON b.symbol = s.symbol AND b.bin = e.bin""")
def calibration(spark, sf):
    return allocation.calibration(_forecasts(spark, sf)).select("symbol", "bin", r6("mean_p"), r6("mean_y"), "n")


@query(f"WITH {BARS}, {FORECAST} SELECT symbol, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(var_pop(y), 6) AS climatology, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS base_rate FROM known GROUP BY 1")
def brier(spark, sf):
    return allocation.brier(_forecasts(spark, sf)).select("symbol", "n", *[r6(c) for c in ("brier", "climatology", "mean_p", "base_rate")])


HELD = f"""{REGIME}, sg AS (SELECT symbol, bar_date, ret, coalesce(rn >= 252 AND rv <= lo + 1e-9, false) AS signal FROM q), hd AS (SELECT *, coalesce(lag(signal) {W}, false) AS held FROM sg)"""


def _held(spark, sf):
    df = indicators.vol_regime(views.bars(spark, sf))
    signal = F.coalesce((F.col("rn") >= 252) & (F.col("rv") <= F.col("lo") + indicators.TIE), F.lit(False))
    return df.withColumn("signal", signal).withColumn("held", F.coalesce(F.lag("signal").over(indicators.by_symbol()), F.lit(False)))


@query(f"WITH {BARS}, {RETS}, {HELD} SELECT symbol, bar_date, held, round(sum(CASE WHEN held THEN ln(1 + coalesce(ret, 0)) ELSE 0 END) {ALL}, 6) AS log_equity FROM hd")
def vol_regime_backtest(spark, sf):
    """Long on days after realised volatility was low against its own past."""
    df = _held(spark, sf).withColumn("step", F.when(F.col("held"), F.log1p(F.coalesce("ret", F.lit(0.0)))).otherwise(0.0))
    return df.select("symbol", "bar_date", "held", r6(indicators.running(F.sum, "step"), "log_equity"))


@query(f"""WITH {BARS}, {RETS}, {HELD}, c AS (SELECT *, sum(CASE WHEN held <> prev THEN 1 ELSE 0 END) {ALL} AS run FROM (SELECT *, coalesce(lag(held) {W}, false) AS prev FROM hd))
SELECT symbol, min(bar_date) AS entry_date, max(bar_date) AS exit_date, count(*) AS days_held, round(exp(sum(ln(1 + coalesce(ret, 0)))) - 1, 6) AS ret FROM c WHERE held GROUP BY symbol, run""")
def islands_trades(spark, sf):
    return trades.runs(_held(spark, sf)).withColumn("ret", r6("ret"))


def _greedy_sql(ctes: str, entries: str, gap: int) -> str:
    """CTEs ending in t: trades chosen greedily from `entries` (symbol, rn, exit_rn), with prices from `b` (symbol, rn, bar_date, close)."""
    return f"""WITH RECURSIVE {ctes}, en AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM ({entries})),
nx AS MATERIALIZED (SELECT a.symbol, a.k, min(b.k) AS next FROM en a LEFT JOIN en b ON a.symbol = b.symbol AND b.rn >= a.exit_rn + {gap} GROUP BY 1, 2),
ch AS (SELECT symbol, 1::BIGINT AS k FROM en WHERE k = 1 UNION ALL SELECT ch.symbol, nx.next FROM ch JOIN nx ON nx.symbol = ch.symbol AND nx.k = ch.k WHERE nx.next IS NOT NULL),
t AS (SELECT en.symbol, x.bar_date AS entry_date, y.bar_date AS exit_date, x.close AS entry_price, y.close AS exit_price, en.exit_rn - en.rn AS days_held, y.close / x.close - 1 AS ret, en.rn, en.exit_rn
 FROM ch JOIN en USING (symbol, k) JOIN b x ON x.symbol = en.symbol AND x.rn = en.rn JOIN b y ON y.symbol = en.symbol AND y.rn = en.exit_rn)"""


NUMBERED = f"b AS (SELECT symbol, bar_date, close, row_number() {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
FALLS = _greedy_sql(f"{BARS}, {NUMBERED}", f"SELECT * FROM (SELECT symbol, rn, rn + 10 AS exit_rn, n, (close / lag(close, 20) {W} - 1) * 100 AS fall FROM b) WHERE fall <= -5 AND rn >= 20 AND rn < n - 11", 0)
TRADES = "symbol, entry_date, exit_date, entry_price, exit_price, days_held, round(ret, 6) AS ret"


def _shown(df):
    return df.select("symbol", "entry_date", "exit_date", "entry_price", "exit_price", "days_held", r6("ret"))


@query(f"{FALLS} SELECT {TRADES} FROM t")
def period_backtest(spark, sf):
    return _shown(trades.after_falls(views.bars(spark, sf)))


STATS = """SELECT symbol, count(*) AS trades, round(100.0 * count(*) FILTER (ret > 0) / count(*), 6) AS hit_rate, round(coalesce(100 * avg(ret) FILTER (ret > 0), 0), 6) AS avg_win, round(coalesce(100 * avg(ret) FILTER (ret < 0), 0), 6) AS avg_loss,
round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0), 6) AS sharpe FROM t GROUP BY 1"""


@query(f"{FALLS} {STATS}")
def trade_stats(spark, sf):
    out = allocation.trade_stats(trades.after_falls(views.bars(spark, sf)))
    return out.select("symbol", "trades", *[r6(c) for c in ("hit_rate", "avg_win", "avg_loss", "sharpe")])


@query(f"""{FALLS}, a AS (SELECT symbol, unnest(range(rn + 1, exit_rn + 1)) AS rn, pow(greatest(1 + ret, 0), 1.0 / (exit_rn - rn)) - 1 AS d FROM t), s AS (SELECT symbol, rn, sum(d) AS d FROM a GROUP BY 1, 2)
SELECT symbol, bar_date, round(sum(ln(1 + greatest(coalesce(d, 0), -0.999999999))) {ALL}, 6) AS log_equity FROM b LEFT JOIN s USING (symbol, rn)""")
def accrued_equity(spark, sf):
    bars = views.bars(spark, sf)
    return trades.accrued(bars, trades.after_falls(bars)).select("symbol", "bar_date", r6("log_equity"))


DISLOCATED = _greedy_sql(
    f"""{_cube((20,), (20,))}, b AS (SELECT symbol, bar_date, close, z20_20 AS z, row_number() {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM z),
p AS (SELECT x.symbol, x.rn, min(y.rn) AS back FROM b x LEFT JOIN b y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn + 1 AND x.rn + 20 AND abs(y.z) < 0.5 WHERE x.z < -1.5 AND x.rn >= 252 AND x.rn < x.n - 21 GROUP BY 1, 2)""",
    "SELECT symbol, rn, coalesce(back, rn + 20) AS exit_rn FROM p", 1,
)


@query(f"{DISLOCATED} SELECT {TRADES} FROM t")
def dislocation_backtest(spark, sf):
    return _shown(trades.on_dislocation(_z(spark, sf)))


LEVELS = _greedy_sql(
    f"""{BARS}, b0 AS (SELECT symbol, bar_date, close, row_number() {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
b AS (SELECT symbol, bar_date, close, row_number() {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n, max(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hb FROM b0 WHERE rn >= floor(n * 0.7 + 1e-9)),
p AS (SELECT x.symbol, x.rn, min(y.rn) AS back FROM b x LEFT JOIN b y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn + 1 AND x.rn + 20 AND (y.close >= x.close * 1.1 OR y.close <= x.close * 0.92) WHERE x.close <= x.hb * 0.9 AND x.rn >= 20 AND x.rn < x.n - 21 GROUP BY 1, 2)""",
    "SELECT symbol, rn, coalesce(back, rn + 20) AS exit_rn FROM p", 1,
)


@query(f"{LEVELS} SELECT {TRADES} FROM t")
def level_backtest(spark, sf):
    return _shown(trades.on_levels(views.bars(spark, sf)))


@query(f"""WITH {BARS}, {NUMBERED}, d AS (SELECT *, ('0x' || substr(md5('42|' || symbol || '|' || rn), 1, 8))::BIGINT AS mix FROM b WHERE rn < n - 11),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mix, rn) <= 25)
SELECT e.symbol, e.bar_date AS entry_date, y.bar_date AS exit_date, e.close AS entry_price, y.close AS exit_price, round(y.close / e.close - 1, 6) AS ret FROM e JOIN b y ON y.symbol = e.symbol AND y.rn = e.rn + 10""")
def random_baseline(spark, sf):
    """Twenty-five random entries per symbol, held ten bars: a baseline for the rules above."""
    return trades.random_entries(views.bars(spark, sf), 25, 10).select("symbol", "entry_date", "exit_date", "entry_price", "exit_price", r6("ret"))


@query(f"""WITH {BARS}, {NUMBERED}, p AS (SELECT x.symbol, x.bar_date, x.rn, min(y.rn - x.rn) AS days FROM b x LEFT JOIN b y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn + 1 AND x.rn + 10 AND y.close >= x.close * 1.2 WHERE x.rn + 10 < x.n GROUP BY 1, 2, 3)
SELECT symbol, bar_date, days FROM p""")
def first_passage(spark, sf):
    """Bars until the close first is a fifth higher, within ten; null if it is not."""
    bars = trades.numbered(views.bars(spark, sf))
    ahead = F.collect_list("close").over(indicators.by_symbol().rowsBetween(1, 10))
    k = F.array_position(F.transform(ahead, lambda p: p >= F.col("close") * 1.2), True)
    return bars.withColumn("k", k).where(F.col("rn") + 10 < F.col("n")).select("symbol", "bar_date", F.when(F.col("k") > 0, F.col("k")).alias("days"))
