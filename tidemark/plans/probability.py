"""Queries over forward returns and over the asset's dislocation from its benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dislocation, probability
from tidemark.plans.registry import BARS, PAIR, query, r6, roll
from tidemark.sources import views

W = "OVER (PARTITION BY symbol ORDER BY bar_date)"
HORIZONS, MAGNITUDES = [5, 20, 60], [5.0, 10.0, 20.0]


@query(f"""WITH {BARS}, f AS (SELECT symbol, horizon, (lead(close, horizon) {W.replace('symbol ORDER', 'symbol, horizon ORDER')} / close - 1) * 100 AS r FROM bars, (VALUES (5), (20), (60)) AS h(horizon))
SELECT symbol, horizon, magnitude, count(*) AS n, round(100.0 * count(*) FILTER (r >= magnitude) / count(*), 6) AS up_prob, round(100.0 * count(*) FILTER (r <= -magnitude) / count(*), 6) AS down_prob
FROM f, (VALUES (5.0::DOUBLE), (10.0), (20.0)) AS m(magnitude) WHERE r IS NOT NULL GROUP BY 1, 2, 3""")
def prob_grid(spark, sf):
    return probability.grid(views.bars(spark, sf), HORIZONS, MAGNITUDES).select("symbol", "horizon", "magnitude", "n", r6("up_prob"), r6("down_prob"))


RANKED = "q AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE r IS NOT NULL)"
FLOORS = ", ".join(f"round(max(CASE WHEN ix = CAST(floor(n * {q}) AS BIGINT) THEN r END), 6) AS {k}" for k, q in probability.QUANTILES.items())


@query(f"""WITH {BARS}, f AS (SELECT symbol, (lead(close, 20) {W} / close - 1) * 100 AS r FROM bars), {RANKED}
SELECT symbol, count(*) AS total, count(*) FILTER (abs(r) >= 10) AS count, count(*) FILTER (r > 0) AS up_count, count(*) FILTER (r < 0) AS down_count, round(100.0 * count(*) FILTER (abs(r) >= 10) / count(*), 6) AS prob,
round(avg(r), 6) AS avg_return, round(max(r), 6) AS best, round(min(r), 6) AS worst, {FLOORS} FROM q GROUP BY 1""")
def prob_result(spark, sf):
    out = probability.result(views.bars(spark, sf).select("symbol", probability.forward(20).alias("r")), 10.0, "EITHER")
    return out.select("symbol", "total", "count", "up_count", "down_count", *[r6(c) for c in ("prob", "avg_return", "best", "worst", *probability.QUANTILES)])


@query(f"WITH {BARS}, f AS (SELECT symbol, (lead(close, 5) {W} / close - 1) * 100 AS r FROM bars), {RANKED} SELECT symbol, {FLOORS} FROM q GROUP BY 1")
def prob_quantiles_floor(spark, sf):
    return probability.ranked_quantiles(views.bars(spark, sf).select("symbol", probability.forward(5).alias("r"))).select("symbol", *[r6(c) for c in probability.QUANTILES])


@query(f"""WITH {BARS}, f AS (SELECT symbol, (lead(close, 5) {W} / close - 1) * 100 AS r FROM bars),
b AS (SELECT symbol, r >= 0 AS gain, min(r) OVER (PARTITION BY symbol, r >= 0) AS lo, max(r) OVER (PARTITION BY symbol, r >= 0) AS hi, r FROM f WHERE r IS NOT NULL)
SELECT symbol, gain, least(floor((r - lo) / nullif(hi - lo, 0) * 40), 39)::INT AS bin, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def return_histogram(spark, sf):
    """Losses and gains of five-bar returns in forty bins each."""
    df = views.bars(spark, sf).select("symbol", probability.forward(5).alias("r")).where("r is not null").withColumn("gain", F.col("r") >= 0)
    bounds = df.groupBy("symbol", "gain").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    at = F.least(F.floor(F.try_divide(F.col("r") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) * 40), F.lit(39)).cast("int")
    return df.join(bounds, ["symbol", "gain"]).groupBy("symbol", "gain", at.alias("bin")).agg(F.count("*").alias("n"))


BACK = {"1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252}


@query(f"""WITH {BARS}, l AS (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1 AS dd, {', '.join(f'lag(close, {n - 1}) {W} AS b{k}' for k, n in BACK.items())} FROM bars),
s AS (SELECT symbol, count(*) AS n, max_by(close, bar_date) AS current, max(close) AS high, min(close) AS low, 100 * min(dd) AS mdd, {', '.join(f'max_by(b{k}, bar_date) AS b{k}' for k in BACK)} FROM l GROUP BY 1)
SELECT symbol, current, high, low, round((current / high - 1) * 100, 6) AS pct_from_high, round((current / low - 1) * 100, 6) AS pct_from_low,
{', '.join(f'round(CASE WHEN n > {n} THEN (current / b{k} - 1) * 100 ELSE 0 END, 6) AS return_{k}' for k, n in BACK.items())}, round(mdd, 6) AS max_drawdown FROM s""")
def stats_summary(spark, sf):
    out = probability.summary(views.bars(spark, sf))
    return out.select("symbol", "current", "high", "low", *[r6(c) for c in out.columns[4:]])


START, END, PH, PM = "1996-01-01", "1998-12-31", [5, 10, 21, 63, 126, 252], [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 50.0]


@query(f"""WITH {BARS}, h(horizon) AS (VALUES (5), (10), (21), (63), (126), (252)), i AS (SELECT *, bar_date BETWEEN DATE '{START}' AND DATE '{END}' AS inside FROM bars),
e AS (SELECT *, bar_date = max(CASE WHEN inside THEN bar_date END) OVER (PARTITION BY symbol) AS end_bar FROM i),
f AS (SELECT symbol, horizon, inside, end_bar, (lead(close, horizon) OVER w / close - 1) * 100 AS r, lead(inside, horizon) OVER w AS still FROM e, h WINDOW w AS (PARTITION BY symbol, horizon ORDER BY bar_date)),
g AS (SELECT symbol, horizon, CASE WHEN still THEN r END AS r, CASE WHEN end_bar THEN r END AS actual FROM f WHERE inside)
SELECT symbol, horizon, count(r) AS total, round(avg(r), 6) AS avg_return, round(median(r), 6) AS median_return, round(max(actual), 6) AS actual_return, {', '.join(f'round(100.0 * count(*) FILTER (r >= {m}) / count(r), 6) AS up_{int(m)}, round(100.0 * count(*) FILTER (r <= -{m}) / count(r), 6) AS down_{int(m)}' for m in PM)}
FROM g GROUP BY 1, 2 HAVING count(r) > 0""")
def period_predictions(spark, sf):
    out = probability.period_predictions(views.bars(spark, sf), START, END, PH, PM)
    moves = [r6(F.col("moves")[F.lit(m)][s], f"{s}_{int(m)}") for m in PM for s in ("up", "down")]
    return out.select("symbol", "horizon", "total", r6("avg_return"), r6("median_return"), r6("actual_return"), *moves)


@query(f"""WITH {PAIR}, b AS (SELECT symbol, bar_date, (bench / lag(bench, 21) {W} - 1) * 100 AS br, (lead(close, 20) {W} / close - 1) * 100 AS r FROM pair),
c AS (SELECT *, max_by(br, bar_date) OVER (PARTITION BY symbol) AS current FROM b), d AS (SELECT *, abs(br - current) AS gap, greatest(5.0, abs(current) * 0.3) AS tight, greatest(10.0, abs(current) * 0.5) AS loose FROM c WHERE br IS NOT NULL AND r IS NOT NULL),
e AS (SELECT *, CASE WHEN count(*) FILTER (gap <= tight) OVER (PARTITION BY symbol) >= 5 THEN tight ELSE loose END AS tolerance FROM d), f AS (SELECT * FROM e WHERE gap <= tolerance), {RANKED.replace('SELECT symbol, r,', 'SELECT symbol, current, tolerance, r,')}
SELECT symbol, count(*) AS total, round(any_value(current), 6) AS bench_return, round(any_value(tolerance), 6) AS tolerance, count(*) FILTER (abs(r) >= 10) AS count, count(*) FILTER (r > 0) AS up_count, count(*) FILTER (r < 0) AS down_count,
round(100.0 * count(*) FILTER (abs(r) >= 10) / count(*), 6) AS prob, round(avg(r), 6) AS avg_return, round(max(r), 6) AS best, round(min(r), 6) AS worst, {FLOORS} FROM q GROUP BY 1 HAVING count(*) >= 3""")
def bench_analogues(spark, sf):
    found = probability.analogues(views.pair(spark, sf), 20)
    out = probability.result(found, 10.0, "EITHER").join(found.groupBy("symbol").agg(F.max("current").alias("bench_return"), F.max("tolerance").alias("tolerance")), "symbol")
    return out.select("symbol", "total", "count", "up_count", "down_count", *[r6(c) for c in ("bench_return", "tolerance", "prob", "avg_return", "best", "worst", *probability.QUANTILES)])


LR = f"{PAIR}, l0 AS (SELECT symbol, bar_date, close, ln(close / lag(close) {W}) AS ra, ln(bench / lag(bench) {W}) AS rb FROM pair), l AS (SELECT * FROM l0 WHERE ra IS NOT NULL)"
BETA = {n: f"({roll('covar_samp', 'ra, rb', n)}) / nullif({roll('var_samp', 'rb', n)}, 0)" for n in dislocation.BETAS}


@query(f"WITH {LR} SELECT symbol, bar_date, {', '.join(f'round({BETA[n]}, 6) AS beta_{n}' for n in dislocation.BETAS)} FROM l")
def rolling_betas(spark, sf):
    out = dislocation.with_betas(dislocation.log_returns(views.pair(spark, sf)))
    return out.select("symbol", "bar_date", *[r6(f"beta_{n}") for n in dislocation.BETAS])


@query(f"""WITH {LR}, b AS ({' UNION ALL '.join(f'SELECT symbol, bar_date, {n} AS lookback, {BETA[n]} AS beta FROM l' for n in dislocation.BETAS)})
SELECT symbol, lookback, round(max_by(beta, bar_date), 6) AS current, round(avg(beta), 6) AS mean, round(median(beta), 6) AS median, round(min(beta), 6) AS min, round(max(beta), 6) AS max, round(stddev_samp(beta), 6) AS std FROM b WHERE beta IS NOT NULL GROUP BY 1, 2""")
def beta_summary(spark, sf):
    wide = dislocation.with_betas(dislocation.log_returns(views.pair(spark, sf)))
    long = wide.select("symbol", "bar_date", F.explode(F.array(*[F.struct(F.lit(n).alias("lookback"), F.col(f"beta_{n}").alias("beta")) for n in dislocation.BETAS])).alias("x")).select("symbol", "bar_date", "x.*").where("beta is not null")
    b = F.col("beta")
    return long.groupBy("symbol", "lookback").agg(r6(F.max_by("beta", "bar_date"), "current"), r6(F.avg(b), "mean"), r6(F.percentile(b, F.lit(0.5)), "median"), r6(F.min(b), "min"), r6(F.max(b), "max"), r6(F.stddev_samp(b), "std"))


def _cube(betas, sums, lookback=252):
    """CTEs r, c and z: residuals, their sums and z-scores, for betas x sums."""
    names = [(w, n) for w in betas for n in sums]
    r = f"r AS (SELECT symbol, bar_date, close, {', '.join(f'ra - {BETA[w]} * rb AS res{w}' for w in betas)} FROM l)"
    c = f"c AS (SELECT symbol, bar_date, close, {', '.join(f'{roll("sum", f"res{w}", n)} AS c{w}_{n}' for w, n in names)} FROM r)"
    z = f"z AS (SELECT symbol, bar_date, close, {', '.join(f'(c{w}_{n} - {roll("avg", f"c{w}_{n}", lookback)}) / nullif({roll("stddev_samp", f"c{w}_{n}", lookback)}, 0) AS z{w}_{n}' for w, n in names)} FROM c)"
    return f"{LR}, {r}, {c}, {z}"


CUBE = [(w, n) for w in dislocation.BETAS for n in dislocation.SUMS]


@query(f"WITH {_cube(dislocation.BETAS, dislocation.SUMS)} SELECT symbol, bar_date, {', '.join(f'round(z{w}_{n}, 6) AS z_b{w}_n{n}' for w, n in CUBE)} FROM z")
def residual_zcube(spark, sf):
    out = dislocation.zcube(dislocation.log_returns(views.pair(spark, sf)))
    return out.select("symbol", "bar_date", *[r6(f"z_b{w}_n{n}") for w, n in CUBE])


@query(f"""WITH {_cube(dislocation.BETAS, dislocation.SUMS)}, u AS ({' UNION ALL '.join(f'SELECT symbol, bar_date, {n} AS resid_n, {w} AS beta_w, z{w}_{n} AS z FROM z' for w, n in CUBE)}),
t AS (SELECT * FROM u QUALIFY bar_date = max(bar_date) OVER (PARTITION BY symbol)), m AS (SELECT symbol, resid_n, median(z) AS z FROM t GROUP BY 1, 2)
SELECT symbol, resid_n, round(z, 6) AS composite_z, CASE WHEN z IS NULL THEN 'N/A' WHEN z >= 1.5 THEN 'SELL' WHEN z >= 0.75 THEN 'WEAK SELL' WHEN z <= -1.5 THEN 'BUY' WHEN z <= -0.75 THEN 'WEAK BUY' ELSE 'NEUTRAL' END AS verdict FROM m""")
def dislocation_verdict(spark, sf):
    """Median z over the betas on each symbol's last bar, by residual window, and what it says."""
    cube = dislocation.zcube(dislocation.log_returns(views.pair(spark, sf)))
    last = cube.groupBy("symbol").agg(*[F.max_by(f"z_b{w}_n{n}", "bar_date").alias(f"z_b{w}_n{n}") for w, n in CUBE])
    long = last.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("resid_n"), F.col(f"z_b{w}_n{n}").alias("z")) for w, n in CUBE])).alias("x")).select("symbol", "x.*")
    out = long.groupBy("symbol", "resid_n").agg(F.percentile("z", F.lit(0.5)).alias("z"))
    return out.select("symbol", "resid_n", r6("z", "composite_z"), dislocation.verdict(F.col("z")).alias("verdict"))


EVENTS = f"""{_cube((20,), (20,))}, n AS (SELECT symbol, bar_date, z20_20 AS z, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM z WHERE z20_20 IS NOT NULL),
p AS (SELECT a.symbol, a.bar_date, a.z AS start_z, a.rn, min(b.rn - a.rn) AS k FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 60 AND (abs(b.z) <= 0.5 OR sign(a.z) * b.z < 0) WHERE abs(a.z) > 1.5 AND a.rn <= a.n - 60 GROUP BY ALL),
ev AS (SELECT p.symbol, p.bar_date, start_z, abs(start_z) AS abs_start_z, CAST(k AS INT) AS days_to_revert, k IS NOT NULL AS reverted, n.z - start_z AS z_move FROM p JOIN n ON n.symbol = p.symbol AND n.rn = p.rn + coalesce(k, 60))"""


def _z(spark, sf):
    cube = dislocation.zcube(dislocation.log_returns(views.pair(spark, sf)), betas=(20,), sums=(20,))
    return cube.select("symbol", "bar_date", "close", F.col("z_b20_n20").alias("z"))


@query(f"WITH {EVENTS} SELECT symbol, bar_date, round(start_z, 6) AS start_z, round(abs_start_z, 6) AS abs_start_z, days_to_revert, reverted, round(z_move, 6) AS z_move FROM ev")
def reversion_events(spark, sf):
    return dislocation.reversion_events(_z(spark, sf)).select("symbol", "bar_date", r6("start_z"), r6("abs_start_z"), "days_to_revert", "reverted", r6("z_move"))


@query(f"""WITH {EVENTS} SELECT symbol, CASE WHEN abs_start_z < 2 THEN 1.5 WHEN abs_start_z < 2.5 THEN 2.0 WHEN abs_start_z < 3 THEN 2.5 ELSE 3.0 END::DOUBLE AS band_lo, count(*) AS n_events, round(100 * avg(reverted::INT), 6) AS reversion_rate,
round(median(days_to_revert), 6) AS median_days, round(median(z_move), 6) AS median_z_move FROM ev WHERE abs_start_z < 99 GROUP BY 1, 2""")
def reversion_lookup(spark, sf):
    out = dislocation.reversion_lookup(dislocation.reversion_events(_z(spark, sf)))
    return out.select("symbol", "band_lo", "n_events", r6("reversion_rate"), r6("median_days"), r6("median_z_move"))


@query(f"""WITH {PAIR}, i AS (SELECT * FROM pair WHERE bar_date BETWEEN DATE '{START}' AND DATE '{END}'), b AS (SELECT *, (bench / lag(bench, 21) {W} - 1) * 100 AS br FROM i),
d AS (SELECT *, max(CASE WHEN last THEN br END) OVER (PARTITION BY symbol) AS cur FROM (SELECT *, bar_date = max(bar_date) OVER (PARTITION BY symbol) AS last FROM b)),
f AS (SELECT symbol, horizon, bar_date, br, cur, (lead(close, horizon) OVER (PARTITION BY symbol, horizon ORDER BY bar_date) / close - 1) * 100 AS r FROM d, (VALUES (5), (10), (21), (63), (126), (252)) AS h(horizon)),
a AS (SELECT symbol, horizon, bar_date, (lead(close, horizon) OVER (PARTITION BY symbol, horizon ORDER BY bar_date) / close - 1) * 100 AS after FROM pair, (VALUES (5), (10), (21), (63), (126), (252)) AS h(horizon)),
l AS (SELECT symbol, max(bar_date) AS bar_date FROM i GROUP BY 1), y AS (SELECT symbol, horizon, after FROM a JOIN l USING (symbol, bar_date)),
t AS (SELECT *, r IS NOT NULL AND abs(br - cur) <= greatest(5.0, abs(cur) * 0.3) AS tight, r IS NOT NULL AND abs(br - cur) <= greatest(10.0, abs(cur) * 0.5) AS loose FROM f WHERE cur IS NOT NULL),
m AS (SELECT symbol, horizon, cur, CASE WHEN CASE WHEN count(*) FILTER (tight) OVER (PARTITION BY symbol, horizon) >= 3 THEN tight ELSE loose END THEN r END AS m FROM t)
SELECT symbol, horizon, count(m) AS total, round(any_value(cur), 6) AS bench_return, round(avg(m), 6) AS avg_return, round(median(m), 6) AS median_return, round(any_value(after), 6) AS actual_return, {', '.join(f'round(100.0 * count(*) FILTER (m >= {x}) / count(m), 6) AS up_{int(x)}, round(100.0 * count(*) FILTER (m <= -{x}) / count(m), 6) AS down_{int(x)}' for x in PM)}
FROM m LEFT JOIN y USING (symbol, horizon) GROUP BY 1, 2 HAVING count(m) >= 3""")
def bench_period_predictions(spark, sf):
    """As period_predictions, on the days of the window that were like its end by the benchmark's return."""
    out = probability.window_analogues(views.pair(spark, sf), START, END, PH, PM)
    moves = [r6(F.col("moves")[F.lit(m)][s], f"{s}_{int(m)}") for m in PM for s in ("up", "down")]
    return out.select("symbol", "horizon", "total", r6("bench_return"), r6("avg_return"), r6("median_return"), r6("actual_return"), *moves)


PRESENT = EVENTS.replace(_cube((20,), (20,)), _cube(dislocation.BETAS, (20,)))


@query(f"""WITH {PRESENT}, u AS ({' UNION ALL '.join(f'SELECT symbol, bar_date, z{w}_20 AS z FROM z' for w in dislocation.BETAS)}), t AS (SELECT * FROM u QUALIFY bar_date = max(bar_date) OVER (PARTITION BY symbol)), m AS (SELECT symbol, median(z) AS z FROM t GROUP BY 1),
b AS (SELECT *, CASE WHEN abs(z) < 1.5 THEN NULL WHEN abs(z) < 2 THEN 1.5 WHEN abs(z) < 2.5 THEN 2.0 WHEN abs(z) < 3 THEN 2.5 WHEN abs(z) < 99 THEN 3.0 END::DOUBLE AS band_lo FROM m),
k AS (SELECT symbol, CASE WHEN abs_start_z < 2 THEN 1.5 WHEN abs_start_z < 2.5 THEN 2.0 WHEN abs_start_z < 3 THEN 2.5 ELSE 3.0 END::DOUBLE AS band_lo, count(*) AS n_events, avg(reverted::INT) * 100 AS rate, median(days_to_revert) AS days FROM ev WHERE abs_start_z < 99 GROUP BY 1, 2)
SELECT symbol, round(z, 6) AS composite_z, band_lo, n_events, round(rate, 6) AS reversion_rate, round(days, 6) AS median_days FROM b LEFT JOIN k USING (symbol, band_lo)""")
def present_reversion(spark, sf):
    """What became of events as large as the present dislocation, for each symbol's last bar."""
    cube = dislocation.zcube(dislocation.log_returns(views.pair(spark, sf)), sums=(20,))
    names = [f"z_b{w}_n20" for w in dislocation.BETAS]
    last = cube.groupBy("symbol").agg(*[F.max_by(c, "bar_date").alias(c) for c in names])
    last = last.select("symbol", F.explode(F.array(*names)).alias("z")).groupBy("symbol").agg(F.percentile("z", F.lit(0.5)).alias("composite_z"))
    lookup = dislocation.reversion_lookup(dislocation.reversion_events(cube.select("symbol", "bar_date", "close", F.col("z_b20_n20").alias("z"))))
    out = dislocation.present_band(last, lookup)
    return out.select("symbol", r6("composite_z"), "band_lo", "n_events", r6("reversion_rate"), r6("median_days"))
