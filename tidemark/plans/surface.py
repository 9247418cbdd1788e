"""Queries over the option chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.functions.options import implied_vol, next_opex, norm_cdf_sql, with_bs_price
from tidemark.functions.rolling import rolling
from tidemark.operators import indicators, surface
from tidemark.plans.indicators import RETS
from tidemark.plans.registry import ASSET, BARS, CHAIN, query, r6, roll
from tidemark.sources import views
from tidemark.sources.views import TIE

REASONS = f"""{CHAIN}, md AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / nullif((bid + ask) / 2, 0) AS spread FROM chain),
rs AS (SELECT *, CASE WHEN dte < 7 THEN 'short_dte' WHEN bid <= 0 OR ask <= 0 OR strike <= 0 OR mid <= 0 THEN 'no_quote' WHEN mid < 1 THEN 'thin_price' WHEN kind = 'p' AND strike < 50 THEN 'deep_otm_put'
 WHEN spread > 0.25 THEN 'spread' WHEN open_interest < 50 OR volume < 1 THEN 'liquidity' WHEN iv IS NULL OR iv NOT BETWEEN 0.05 AND 5 THEN 'iv_fail' END AS reason FROM md), kp AS (SELECT * FROM rs WHERE reason IS NULL)"""


@query(f"WITH {REASONS} SELECT dte, coalesce(reason, 'kept') AS reason, count(*) AS n FROM rs GROUP BY 1, 2")
def chain_reject_counts(spark, sf):
    return surface.with_reason(views.chain(spark, sf)).groupBy("dte", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _fold(name: str, source: str, keys: str, order: str, drop: str) -> str:
    on = " AND ".join(f"o.{k} = {name}_f.{k}" for k in keys.split(", "))
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {source}),
{name}_f AS (SELECT *, mid AS prev, true AS keep FROM {name}_o WHERE k = 1 UNION ALL SELECT o.*, CASE WHEN {drop} THEN prev ELSE o.mid END, NOT ({drop}) FROM {name}_f JOIN {name}_o o ON {on} AND o.k = {name}_f.k + 1),
{name} AS (SELECT kind, dte, strike, mid FROM {name}_f WHERE keep)"""


@query(f"""WITH RECURSIVE {REASONS}, s0 AS (SELECT kind, dte, strike, mid FROM kp), {_fold('s1', 's0', 'kind, dte', 'strike', "(o.kind = 'c' AND o.mid > prev + 1e-6) OR (o.kind = 'p' AND o.mid < prev - 1e-6)")},
{_fold('s2', 's1', 'kind, strike', 'dte', 'o.mid < prev - 0.05')} SELECT kind, dte, strike, round(mid, 6) AS mid FROM s2""")
def chain_no_arb(spark, sf):
    return surface.no_arbitrage(surface.kept(views.chain(spark, sf))).select("kind", "dte", "strike", r6("mid"))


@query(f"""WITH {REASONS}, p AS (SELECT a.kind, a.dte, a.strike, a.iv, b.iv AS iv2, row_number() OVER (PARTITION BY a.kind, a.dte, a.strike ORDER BY round(pow((a.mny - b.mny) / 0.05, 2) + pow((a.dte - b.dte) / 30.0, 2), 9), b.dte, b.strike) AS place
 FROM kp a JOIN kp b ON a.kind = b.kind AND NOT (a.dte = b.dte AND a.strike = b.strike)), nb AS (SELECT kind, dte, strike, any_value(iv) AS iv, median(iv2) AS near_iv, count(*) AS n FROM p WHERE place <= 5 GROUP BY 1, 2, 3)
SELECT kind, dte, strike, round(near_iv, 6) AS near_iv, n >= 5 AND near_iv > 0 AND NOT (iv / near_iv BETWEEN 0.8 AND 1.25) AS outlier FROM nb""")
def chain_knn_outliers(spark, sf):
    """With closer bounds than the default, so that the test chain has outliers."""
    return surface.local_outliers(surface.kept(views.chain(spark, sf)), low=0.8, high=1.25).select("kind", "dte", "strike", r6("near_iv"), "outlier")


@query(f"WITH {REASONS} SELECT kind, dte, strike, mny, iv FROM kp WHERE (kind = 'c' AND mny >= 1) OR (kind = 'p' AND mny < 1)")
def otm_blend(spark, sf):
    return surface.otm_blend(surface.kept(views.chain(spark, sf))).select("kind", "dte", "strike", "mny", "iv")


@query(f"""WITH {REASONS} SELECT target, round(coalesce(median(iv) FILTER (abs(mny - 1) <= 0.05 AND abs(dte - target) <= 15), median(iv) FILTER (abs(mny - 1) <= 0.1 AND abs(dte - target) <= 30)), 6) AS iv
FROM kp, (VALUES (30), (60), (90)) AS t(target) GROUP BY 1""")
def atm_iv(spark, sf):
    return surface.atm_iv(surface.kept(views.chain(spark, sf)), [30, 60, 90]).select("target", r6("iv"))


@query(f"""WITH {REASONS} SELECT round(CASE WHEN count(*) >= 4 THEN median(iv) FILTER (kind = 'p' AND mny BETWEEN 0.85 AND 0.95) - median(iv) FILTER (kind = 'c' AND mny BETWEEN 1.05 AND 1.15) END, 6) AS skew FROM kp WHERE abs(dte - 30) <= 15""")
def skew(spark, sf):
    return surface.skew(surface.kept(views.chain(spark, sf))).select(r6("skew"))


W = "OVER (PARTITION BY symbol ORDER BY bar_date"


@query(f"""WITH {BARS}, {RETS}, v AS (SELECT symbol, bar_date, ({roll('stddev_samp', 'log_ret', 30)}) * sqrt(252) * 100 AS rv FROM r),
k AS (SELECT symbol, bar_date, rv, min(rv) {W} ROWS 251 PRECEDING) AS lo, max(rv) {W} ROWS 251 PRECEDING) AS hi, count(rv) {W} ROWS UNBOUNDED PRECEDING) AS known FROM v),
l AS (SELECT * FROM k QUALIFY bar_date = max(bar_date) OVER (PARTITION BY symbol)), x AS (SELECT *, CASE WHEN known < 30 THEN NULL WHEN hi = lo THEN 50.0 ELSE (rv - lo) / (hi - lo) * 100 END AS iv_rank FROM l)
SELECT symbol, round(rv, 6) AS rv, round(iv_rank, 6) AS iv_rank, CASE WHEN iv_rank < 25 THEN 'CHEAP' WHEN iv_rank > 75 THEN 'EXPENSIVE' WHEN iv_rank IS NOT NULL THEN 'MID-RANGE' END AS verdict FROM x""")
def iv_rank(spark, sf):
    """Rank of today's 30-bar realised volatility in its range of a year."""
    w = indicators.by_symbol()
    df = indicators.with_returns(views.bars(spark, sf)).withColumn("rv", indicators.realized_vol(30))
    df = df.withColumn("lo", F.min("rv").over(w.rowsBetween(-251, 0))).withColumn("hi", F.max("rv").over(w.rowsBetween(-251, 0))).withColumn("known", indicators.running(F.count, "rv"))
    last = df.groupBy("symbol").agg(F.max_by(F.struct("rv", "lo", "hi", "known"), "bar_date").alias("x")).select("symbol", "x.*")
    rank = F.when(F.col("known") < 30, None).when(F.col("hi") == F.col("lo"), 50.0).otherwise((F.col("rv") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 100)
    last = last.withColumn("iv_rank", rank)
    verdict = F.when(F.col("iv_rank") < 25, "CHEAP").when(F.col("iv_rank") > 75, "EXPENSIVE").when(F.col("iv_rank").isNotNull(), "MID-RANGE")
    return last.select("symbol", r6("rv"), r6("iv_rank"), verdict.alias("verdict"))


@query(f"""WITH {ASSET}, d AS (SELECT DISTINCT bar_date FROM asset), m AS (SELECT bar_date, CAST(date_trunc('month', bar_date) + INTERVAL 1 MONTH AS DATE) AS first FROM d)
SELECT bar_date, CAST(first + CAST((5 - dayofweek(first) + 7) % 7 + 14 AS INT) AS DATE) AS opex FROM m""")
def next_expiry(spark, sf):
    return views.asset_bars(spark, sf).select("bar_date").distinct().select("bar_date", next_opex(F.col("bar_date")).alias("opex"))


@query(f"WITH {CHAIN} SELECT kind, dte, strike, volume, open_interest FROM chain WHERE bid > 0 AND ask > 0 AND open_interest >= 50 AND volume >= 1 ORDER BY volume DESC, open_interest DESC, kind, dte, strike LIMIT 20")
def topk_volume(spark, sf):
    liquid = views.chain(spark, sf).where("bid > 0 and ask > 0 and open_interest >= 50 and volume >= 1")
    return liquid.orderBy(F.desc("volume"), F.desc("open_interest"), "kind", "dte", "strike").limit(20).select("kind", "dte", "strike", "volume", "open_interest")


CALL = f"100.0 * {norm_cdf_sql('d1')} - strike * exp(-0.045 * years) * {norm_cdf_sql('d2')}"
PUT = f"strike * exp(-0.045 * years) * {norm_cdf_sql('m2')} - 100.0 * {norm_cdf_sql('m1')}"


@query(f"""WITH {CHAIN}, y AS (SELECT kind, dte, strike, iv, greatest(dte, 1) / 365.0 AS years FROM chain), z AS (SELECT *, (ln(100.0 / strike) + (0.045 + iv * iv / 2) * years) / (iv * sqrt(years)) AS d1 FROM y),
q AS (SELECT *, d1 - iv * sqrt(years) AS d2, -d1 AS m1, -(d1 - iv * sqrt(years)) AS m2 FROM z) SELECT kind, dte, strike, round(CASE WHEN kind = 'c' THEN {CALL} ELSE {PUT} END, 6) AS price FROM q""")
def bs_call(spark, sf):
    """Model prices of calls and puts of the whole chain."""
    df = views.chain(spark, sf).withColumn("spot", F.lit(100.0)).withColumn("years", F.greatest(F.col("dte"), F.lit(1)) / 365.0)
    return with_bs_price(df, "spot", "strike", "years", "iv", rate=0.045, out="price").select("kind", "dte", "strike", r6("price"))


@query(f"""WITH {CHAIN}, y AS (SELECT kind, dte, strike, iv, greatest(dte, 1) / 365.0 AS years FROM chain), z AS (SELECT *, (ln(100.0 / strike) + (0.045 + iv * iv / 2) * years) / (iv * sqrt(years)) AS d1 FROM y),
q AS (SELECT *, d1 - iv * sqrt(years) AS d2, -d1 AS m1, -(d1 - iv * sqrt(years)) AS m2 FROM z) SELECT kind, dte, count(*) AS n, round(avg(CASE WHEN kind = 'c' THEN {CALL} ELSE {PUT} END), 6) AS mean_price, round(max({norm_cdf_sql('d1')}), 6) AS most FROM q GROUP BY 1, 2""")
def bs_price_sql(spark, sf):
    """Mean model price and largest N(d1) by expiry, from SQL by the registered functions."""
    sql.register(spark)
    return spark.sql(
        f"""SELECT kind, dte, count(*) AS n, round(avg(bs_price(kind, 100.0D, strike, years, iv, 0.045D)) + {TIE}, 6) AS mean_price, round(max(norm_cdf((ln(100.0D / strike) + (0.045D + iv * iv / 2) * years) / (iv * sqrt(years)))) + {TIE}, 6) AS most
        FROM (SELECT *, greatest(dte, 1) / 365.0D AS years FROM {{chain}}) GROUP BY kind, dte""",
        chain=views.chain(spark, sf),
    )


def _price_sql(v: str) -> str:
    """SQL of the model price of a contract at spot 100 for a volatility, each part computed once."""
    n = f"list_transform([d, d - {v} * sqrt(years), -d, {v} * sqrt(years) - d], lambda x: {norm_cdf_sql('x')})"
    worth = f"list_transform([{n}], lambda n: CASE WHEN kind = 'c' THEN 100.0 * n[1] - strike * exp(-0.045 * years) * n[2] ELSE strike * exp(-0.045 * years) * n[4] - 100.0 * n[3] END)[1]"
    return f"list_transform([(ln(100.0 / strike) + (0.045 + {v} * {v} / 2) * years) / ({v} * sqrt(years))], lambda d: {worth})[1]"


@query(f"""WITH {CHAIN}, y AS (SELECT kind, dte, strike, (bid + ask) / 2 AS mid, greatest(dte, 1) / 365.0 AS years FROM chain WHERE (bid + ask) / 2 > 0),
b AS (SELECT kind, dte, strike, mid > {_price_sql('0.01::DOUBLE')} AND mid < {_price_sql('5.0::DOUBLE')} AS reachable,
 list_reduce([[0.01::DOUBLE, 5.0::DOUBLE]] || list_transform(range(60), lambda i: [0.0::DOUBLE, 0.0::DOUBLE]), lambda a, z: list_transform([(a[1] + a[2]) / 2], lambda v: CASE WHEN {_price_sql('v')} < mid THEN [v, a[2]] ELSE [a[1], v] END)[1]) AS ends FROM y)
SELECT kind, dte, strike, round(CASE WHEN reachable THEN (ends[1] + ends[2]) / 2 END, 6) AS implied FROM b""")
def implied_vols(spark, sf):
    """Volatility that gives back each contract's mid."""
    df = surface.with_reason(views.chain(spark, sf)).where("mid > 0").withColumn("years", F.greatest(F.col("dte"), F.lit(1)) / 365.0)
    return df.select("kind", "dte", "strike", r6(implied_vol(F.col("mid"), F.lit(100.0), F.col("strike"), F.col("years"), F.col("kind")), "implied"))


NO_ARB = f"""{_fold('s1', 's0', 'kind, dte', 'strike', "(o.kind = 'c' AND o.mid > prev + 1e-6) OR (o.kind = 'p' AND o.mid < prev - 1e-6)")},
{_fold('s2', 's1', 'kind, strike', 'dte', 'o.mid < prev - 0.05')}"""
CLEAN = f"{REASONS}, s0 AS (SELECT kind, dte, strike, mid FROM kp), {NO_ARB}, na AS (SELECT kind, dte, strike, s2.mid, iv FROM s2 JOIN kp USING (kind, dte, strike))"
#: Splines without one point at a time: for each inner point the others are numbered, and their tridiagonal system is solved forwards and back.
LOO = f"""{CLEAN}, pt AS MATERIALIZED (SELECT kind, dte, strike, mid, iv AS y, ln(strike / (100.0 * exp(0.045 * greatest(dte, 1) / 365.0))) AS x, row_number() OVER (PARTITION BY kind, dte ORDER BY strike) AS i, count(*) OVER (PARTITION BY kind, dte) AS n FROM na),
o AS MATERIALIZED (SELECT a.kind, a.dte, a.i AS j, row_number() OVER w - 1 AS k, a.n - 1 AS n, b.x, b.y, b.x - lag(b.x) OVER w AS h0, lead(b.x) OVER w - b.x AS h1, lag(b.y) OVER w AS y0, lead(b.y) OVER w AS y1
 FROM pt a JOIN pt b ON a.kind = b.kind AND a.dte = b.dte AND a.i <> b.i WHERE a.n >= 5 AND a.i > 1 AND a.i < a.n WINDOW w AS (PARTITION BY a.kind, a.dte, a.i ORDER BY b.x)),
fw AS (SELECT kind, dte, j, k, n, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM o WHERE k = 0
 UNION ALL SELECT o.kind, o.dte, o.j, o.k, o.n, h1 / (2 * (h0 + h1) - h0 * c), (6 * ((y1 - y) / h1 - (y - y0) / h0) - h0 * d) / (2 * (h0 + h1) - h0 * c) FROM fw JOIN o ON o.kind = fw.kind AND o.dte = fw.dte AND o.j = fw.j AND o.k = fw.k + 1 WHERE o.k < o.n - 1),
fm AS MATERIALIZED (SELECT * FROM fw), bw AS (SELECT kind, dte, j, n - 1 AS k, 0.0::DOUBLE AS m FROM fm WHERE k = 0 UNION ALL SELECT fm.kind, fm.dte, fm.j, fm.k, d - c * m FROM bw JOIN fm ON fm.kind = bw.kind AND fm.dte = bw.dte AND fm.j = bw.j AND fm.k = bw.k - 1),
fit AS (SELECT p.kind, p.dte, p.strike, (l.m * pow(r.x - p.x, 3) + u.m * pow(p.x - q.x, 3)) / (6 * q.h1) + (q.y / q.h1 - l.m * q.h1 / 6) * (r.x - p.x) + (r.y / q.h1 - u.m * q.h1 / 6) * (p.x - q.x) AS f
 FROM pt p JOIN o q ON q.kind = p.kind AND q.dte = p.dte AND q.j = p.i AND q.k = p.i - 2 JOIN o r ON r.kind = p.kind AND r.dte = p.dte AND r.j = p.i AND r.k = p.i - 1
 JOIN bw l ON l.kind = p.kind AND l.dte = p.dte AND l.j = p.i AND l.k = q.k JOIN bw u ON u.kind = p.kind AND u.dte = p.dte AND u.j = p.i AND u.k = r.k),
loo AS (SELECT pt.kind, pt.dte, pt.strike, pt.mid, pt.y AS iv, CASE WHEN f >= 0.05 THEN f END AS fitted_iv, greatest(least((pt.y - CASE WHEN f >= 0.05 THEN f END) / f, 1.0), -1.0) AS residual FROM pt LEFT JOIN fit USING (kind, dte, strike))"""


def _fit(spark, sf, mode):
    chain = surface.no_arbitrage(surface.kept(views.chain(spark, sf)))
    return surface.spline_fit(chain, mode)


@query(f"""WITH RECURSIVE {CLEAN}, c AS (SELECT *, count(*) OVER (PARTITION BY kind, dte) AS n FROM na) SELECT kind, dte, strike, iv, round(CASE WHEN n >= 4 THEN iv END, 6) AS fitted_iv, round(CASE WHEN n >= 4 THEN 0.0 END, 6) AS residual FROM c""")
def spline_fit(spark, sf):
    """The spline runs through the points that it scores, so it gives them back."""
    return _fit(spark, sf, "interpolate").select("kind", "dte", "strike", "iv", r6("fitted_iv"), r6("residual"))


@query(f"WITH RECURSIVE {LOO} SELECT kind, dte, strike, round(fitted_iv, 6) AS fitted_iv, round(CASE WHEN fitted_iv IS NOT NULL THEN residual END, 6) AS residual FROM loo")
def spline_without_each(spark, sf):
    """Every inner contract against the spline through the others of its expiry."""
    return _fit(spark, sf, "loo").select("kind", "dte", "strike", r6("fitted_iv"), r6("residual"))


@query(f"""WITH RECURSIVE {LOO}, y AS (SELECT *, greatest(dte, 1) / 365.0 AS years FROM loo WHERE fitted_iv IS NOT NULL), z AS (SELECT *, (ln(100.0 / strike) + (0.045 + fitted_iv * fitted_iv / 2) * years) / (fitted_iv * sqrt(years)) AS d1 FROM y),
q AS (SELECT *, d1 - fitted_iv * sqrt(years) AS d2, -d1 AS m1, -(d1 - fitted_iv * sqrt(years)) AS m2 FROM z), pr AS (SELECT *, CASE WHEN kind = 'c' THEN {CALL} ELSE {PUT} END AS model FROM q),
ok AS (SELECT *, stddev_samp(residual) OVER (PARTITION BY kind) AS sd FROM pr WHERE model > 0 AND abs(model - mid) / greatest(mid, 1.0) <= 0.5), sg AS (SELECT *, CASE WHEN sd > 0 THEN residual / sd ELSE 0.0 END AS z, CASE WHEN residual < 0 THEN 'BUY' ELSE 'SELL' END AS side FROM ok WHERE abs(residual) > 0.05)
SELECT kind, dte, strike, round(residual, 6) AS residual, round(z, 6) AS z, side, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'BUY' THEN z ELSE -z END, kind, dte, strike) AS place FROM sg""")
def anomalies(spark, sf):
    """Against a fit that leaves each contract out; buys by z ascending, sells descending."""
    return surface.anomalies(_fit(spark, sf, "loo")).select("kind", "dte", "strike", r6("residual"), r6("z"), "side", F.col("place").cast("long").alias("place"))


@query(f"""WITH RECURSIVE {REASONS}, p AS (SELECT a.kind, a.dte, a.strike, a.iv, b.iv AS iv2, row_number() OVER (PARTITION BY a.kind, a.dte, a.strike ORDER BY round(pow((a.mny - b.mny) / 0.05, 2) + pow((a.dte - b.dte) / 30.0, 2), 9), b.dte, b.strike) AS place
 FROM kp a JOIN kp b ON a.kind = b.kind AND NOT (a.dte = b.dte AND a.strike = b.strike)), nb AS (SELECT kind, dte, strike, any_value(iv) AS iv, median(iv2) AS near_iv, count(*) AS n FROM p WHERE place <= 5 GROUP BY 1, 2, 3),
s0 AS (SELECT kind, dte, strike, mid FROM kp LEFT JOIN (SELECT kind, dte, strike, n >= 5 AND near_iv > 0 AND NOT (iv / near_iv BETWEEN 0.8 AND 1.25) AS outlier FROM nb) USING (kind, dte, strike) WHERE NOT coalesce(outlier, false)),
{NO_ARB}, k0 AS (SELECT kind, count(*) AS n FROM kp GROUP BY 1), c0 AS (SELECT kind, count(*) AS n FROM s0 GROUP BY 1), c1 AS (SELECT kind, count(*) AS n FROM s1 GROUP BY 1), c2 AS (SELECT kind, count(*) AS n FROM s2 GROUP BY 1)
SELECT kind, k0.n AS pre, k0.n - c0.n AS outliers, c0.n - c2.n AS no_arb, CASE WHEN kind = 'c' THEN c0.n - c1.n ELSE 0 END AS call_mono, CASE WHEN kind = 'p' THEN c0.n - c1.n ELSE 0 END AS put_mono, c1.n - c2.n AS calendar, c2.n AS final
FROM k0 JOIN c0 USING (kind) JOIN c1 USING (kind) JOIN c2 USING (kind)""")
def surface_stages(spark, sf):
    """What outlier and arbitrage filters leave of each kind, counted while the surface is fitted; bounds as in chain_knn_outliers."""
    return surface.cleaned(surface.kept(views.chain(spark, sf)), low=0.8, high=1.25)[1]


@query()
def surface_grid(spark, sf):
    return surface.grid(surface.kept(views.chain(spark, sf)))


@query(f"""WITH {CHAIN}, top AS (SELECT kind, dte, strike FROM chain WHERE bid > 0 AND ask > 0 AND open_interest >= 50 AND volume >= 1 ORDER BY volume DESC, open_interest DESC, kind, dte, strike LIMIT 20),
ob AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'p' ELSE 'c' END AS kind, CAST(7 * (l_suppkey % 20) + 3 AS INT) AS dte, round(100 * (0.4 + 0.05 * (l_partkey % 25)), 2) AS strike, CAST(l_shipdate AS DATE) AS bar_date, round(avg(l_extendedprice / l_quantity), 6) AS close FROM lineitem GROUP BY 1, 2, 3, 4),
p AS (SELECT kind, dte, strike, min_by(close, bar_date) AS c0, max_by(close, bar_date) AS c1, count(*) AS n FROM ob JOIN top USING (kind, dte, strike) GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT kind, dte, strike, n, round((c1 / c0 - 1) * 100, 6) AS pnl FROM p""")
def contract_pnl(spark, sf):
    """First to last close of the twenty most traded contracts."""
    top = topk_volume(spark, sf).select("kind", "dte", "strike")
    bars = views.option_bars(spark, sf).join(F.broadcast(top), ["kind", "dte", "strike"])  # twenty rows
    out = bars.groupBy("kind", "dte", "strike").agg(F.min_by("close", "bar_date").alias("c0"), F.max_by("close", "bar_date").alias("c1"), F.count("*").alias("n")).where("n >= 2")
    return out.select("kind", "dte", "strike", "n", r6((F.col("c1") / F.col("c0") - 1) * 100, "pnl"))


HOLD = 60


@query(f"""WITH {CHAIN}, top AS (SELECT kind, dte, strike FROM chain WHERE bid > 0 AND ask > 0 AND open_interest >= 50 AND volume >= 1 ORDER BY volume DESC, open_interest DESC, kind, dte, strike LIMIT 20),
ob AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'p' ELSE 'c' END AS kind, CAST(7 * (l_suppkey % 20) + 3 AS INT) AS dte, round(100 * (0.4 + 0.05 * (l_partkey % 25)), 2) AS strike, CAST(l_shipdate AS DATE) AS bar_date, round(avg(l_extendedprice / l_quantity), 6) AS close FROM lineitem GROUP BY 1, 2, 3, 4),
ct AS (SELECT max(bar_date) - {HOLD + 5} AS cutoff FROM ob), p AS (SELECT kind, dte, strike, min_by(close, bar_date) AS c0, max_by(close, bar_date) AS c1, count(*) AS n FROM ob, ct WHERE bar_date <= cutoff AND bar_date >= cutoff - {HOLD + 30} GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT kind, dte, strike, n AS days_observed, c0 AS entry_close, c1 AS exit_close, round(CASE WHEN c0 > 0 THEN (c1 / c0 - 1) * 100 END, 6) AS pnl FROM top LEFT JOIN p USING (kind, dte, strike)""")
def contract_window_pnl(spark, sf):
    """The twenty most traded contracts over a holding window that ends at a cutoff; those without bars there have no result."""
    top = topk_volume(spark, sf).select("kind", "dte", "strike")
    bars = views.option_bars(spark, sf)
    last = bars.agg(F.date_sub(F.max("bar_date"), HOLD + 5).alias("cutoff"))  # one row
    mine = bars.join(F.broadcast(top), ["kind", "dte", "strike"]).crossJoin(F.broadcast(last))  # twenty rows
    out = surface.window_pnl(top, mine, F.col("cutoff"), HOLD)
    return out.select("kind", "dte", "strike", "days_observed", "entry_close", "exit_close", r6("pnl"))
