"""Queries of what reports say. Those that read other queries' results wrap their SQL as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import report, surface, trades
from tidemark.operators.sleeve import LENGTHS, STEP
from tidemark.plans.registry import BARS, ORACLES, PAIR, QUERIES, query, r6
from tidemark.plans.surface import REASONS, _fold
from tidemark.plans.trading import NUMBERED
from tidemark.sources import views

AHEAD = f"{BARS}, f AS (SELECT symbol, bar_date, (lead(close, 20) OVER (PARTITION BY symbol ORDER BY bar_date) / close - 1) * 100 AS ret FROM bars)"


def _ahead(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("bar_date")
    return views.bars(spark, sf).select("symbol", "bar_date", ((F.lead("close", 20).over(w) / F.col("close") - 1) * 100).alias("ret"))


def over(base: str, sql: str):
    """Register a query over another one's rows; {} in its SQL stands for that one's."""
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf: f(QUERIES[base](spark, sf))
        ORACLES[f.__name__] = sql.replace("{}", f"({ORACLES[base]})")
        return f

    return put


@over("prob_grid", """SELECT symbol, horizon, magnitude, direction, prob, CASE direction WHEN 'DOWN' THEN CASE WHEN prob < 25 THEN 'historically unlikely' WHEN prob < 50 THEN 'moderate risk' ELSE 'elevated risk' END
 WHEN 'UP' THEN CASE WHEN prob > 60 THEN 'strong tailwind' WHEN prob > 35 THEN 'decent odds' ELSE 'a big move' END ELSE CASE WHEN prob > 60 THEN 'high volatility' ELSE 'as often as that' END END AS verdict,
 CASE WHEN prob > 0 THEN CAST(round(100 / prob) AS INT) END AS one_in FROM (SELECT symbol, horizon, magnitude, unnest(['UP', 'DOWN', 'EITHER']) AS direction, unnest([up_prob, down_prob, up_prob + down_prob]) AS prob FROM {})""")
def prob_verdict(grid):
    three = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), p.alias("prob")) for d, p in (("UP", F.col("up_prob")), ("DOWN", F.col("down_prob")), ("EITHER", F.col("up_prob") + F.col("down_prob")))])).alias("x")
    out = grid.select("symbol", "horizon", "magnitude", three).select("symbol", "horizon", "magnitude", "x.*")
    return out.withColumn("verdict", report.probability_verdict(F.col("direction"), F.col("prob"))).withColumn("one_in", report.one_in(F.col("prob")))


@over("allocation_panel", """SELECT symbol, bar_date, allocation, round(allocation * 0.2, 6) AS of_all, CASE WHEN regime_mult < 1.0 THEN 'BEAR' ELSE 'Normal' END AS regime,
 CASE WHEN deviation < -0.01 THEN 'oversold' WHEN deviation > 0.01 THEN 'overbought' ELSE 'near baseline' END AS label FROM {} QUALIFY bar_date = max(bar_date) OVER (PARTITION BY symbol)""")
def headline(panel):
    return report.headline(panel).withColumn("of_all", F.round("of_all", 6))


@over("allocation_panel", "SELECT symbol, CASE WHEN deviation < -0.01 THEN 'oversold' WHEN deviation > 0.01 THEN 'overbought' ELSE 'near baseline' END AS label, count(*) AS n FROM {} GROUP BY 1, 2")
def deviation_labels(panel):
    return panel.groupBy("symbol", report.deviation_label(F.col("deviation")).alias("label")).agg(F.count("*").alias("n"))


@over("allocation_panel", "SELECT symbol, round(avg(nullif(round(allocation - 0.1, 6), 0)) + 1e-9, 6) AS mean_above_floor, round(avg(nullif(dev_scale, 0)) + 1e-9, 6) AS mean_scale FROM {} GROUP BY 1")
def mean_nonzero(panel):
    """Means over the bars at which a value is not zero, as for a sleeve that is held at times."""
    return panel.groupBy("symbol").agg(r6(F.avg(F.nullif(F.round(F.col("allocation") - 0.1, 6), F.lit(0.0))), "mean_above_floor"), r6(F.avg(F.nullif("dev_scale", F.lit(0.0))), "mean_scale"))


@over("atm_iv", "SELECT round((max(iv) FILTER (target = 90) - max(iv) FILTER (target = 30)) * 100 + 1e-9, 6) AS slope FROM {}")
def term_slope(atm):
    return report.term_slope(atm).select(r6("slope"))


@over("islands_trades", "SELECT symbol, count(*) AS trades, round(avg(days_held) + 1e-9, 6) AS avg_holding, max(days_held) AS longest FROM {} GROUP BY 1")
def average_holding(found):
    return found.groupBy("symbol").agg(F.count("*").alias("trades"), r6(F.avg("days_held"), "avg_holding"), F.max("days_held").alias("longest"))


@over("contract_pnl", """SELECT count(*) AS contracts, round(coalesce(avg(pnl), 0) + 1e-9, 6) AS mean_pnl, round(coalesce(median(pnl), 0) + 1e-9, 6) AS median_pnl, round(100.0 * count(*) FILTER (pnl > 0) / count(*) + 1e-9, 6) AS win_rate,
 max(pnl) AS best, min(pnl) AS worst FROM {}""")
def surface_pnl_stats(pnl):
    return report.profit_stats(pnl).select("contracts", r6("mean_pnl"), r6("median_pnl"), r6("win_rate"), "best", "worst")


@over("contract_pnl", "SELECT kind, dte, strike, printf('%+.1f%%', round(pnl::DECIMAL(18, 6), 1)::DOUBLE) AS pnl, printf('$%.2f', round(strike::DECIMAL(18, 6), 2)::DOUBLE) AS price FROM {}")
def formatted(pnl):
    """Halves go away from zero, as decimals have it."""
    return pnl.select("kind", "dte", "strike", report.signed_percent(F.col("pnl")).alias("pnl"), report.dollars(F.col("strike")).alias("price"))


@query(f"WITH {AHEAD}, g AS (SELECT symbol, ret, greatest((abs(ret) >= 5)::INT + (abs(ret) >= 10)::INT + (abs(ret) >= 15)::INT + (abs(ret) >= 20)::INT + (abs(ret) >= 30)::INT + (abs(ret) >= 50)::INT - 1, 0) AS bucket FROM f WHERE ret IS NOT NULL) SELECT symbol, ret >= 0 AS up, bucket, count(*) AS n FROM g GROUP BY 1, 2, 3")
def closest_buckets(spark, sf):
    """Moves of twenty bars by the magnitude they come closest to."""
    return _ahead(spark, sf).where("ret is not null").groupBy("symbol", (F.col("ret") >= 0).alias("up"), report.closest_bucket(F.col("ret")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {AHEAD}, e AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi, quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.5) AS b, quantile_cont(ret, 0.95) AS c FROM f WHERE ret IS NOT NULL GROUP BY 1)
SELECT symbol, round(lo, 6) AS worst, round(hi, 6) AS best, round(coalesce((a - lo) / nullif(hi - lo, 0) * 100, 5), 6) AS at_5, round(coalesce((b - lo) / nullif(hi - lo, 0) * 100, 50), 6) AS at_50, round(coalesce((c - lo) / nullif(hi - lo, 0) * 100, 95), 6) AS at_95 FROM e""")
def range_bar(spark, sf):
    return report.range_positions(_ahead(spark, sf)).select("symbol", *[r6(c) for c in ("worst", "best", "at_5", "at_50", "at_95")])


@query(f"WITH {AHEAD} SELECT symbol, count(*) AS n, round(100.0 * count(*) FILTER (ret >= 5) / count(*), 6) AS up, round(100.0 * count(*) FILTER (ret <= -5) / count(*), 6) AS down FROM f WHERE ret IS NOT NULL GROUP BY 1")
def conditional_share(spark, sf):
    return report.beyond(_ahead(spark, sf)).select("symbol", "n", r6("up"), r6("down"))


@query(f"WITH {REASONS} SELECT kind, dte, strike, '$' || printf('%.0f', strike) || CASE WHEN kind = 'c' THEN ' Call ' ELSE ' Put ' END || strftime(DATE '2024-01-02' + dte, '%b %Y') AS label FROM kp")
def contract_labels(spark, sf):
    expiry = F.date_add(F.lit("2024-01-02").cast("date"), F.col("dte"))
    return surface.kept(views.chain(spark, sf)).select("kind", "dte", "strike", report.contract_label(F.col("kind"), F.col("strike"), expiry).alias("label"))


@query(f"""WITH RECURSIVE {REASONS}, s0 AS (SELECT kind, dte, strike, mid FROM kp), {_fold('s1', 's0', 'kind, dte', 'strike', "(o.kind = 'c' AND o.mid > prev + 1e-6) OR (o.kind = 'p' AND o.mid < prev - 1e-6)")},
{_fold('s2', 's1', 'kind, strike', 'dte', 'o.mid < prev - 0.05')} SELECT 'call_mono' AS rule, (SELECT count(*) FROM s0 WHERE kind = 'c') - (SELECT count(*) FROM s1 WHERE kind = 'c') AS dropped
UNION ALL SELECT 'put_mono', (SELECT count(*) FROM s0 WHERE kind = 'p') - (SELECT count(*) FROM s1 WHERE kind = 'p') UNION ALL SELECT 'calendar', (SELECT count(*) FROM s1) - (SELECT count(*) FROM s2)""")
def no_arb_drops(spark, sf):
    return report.no_arbitrage_drops(surface.kept(views.chain(spark, sf)))


@query(f"WITH {BARS}, s AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1) SELECT symbol, n, CAST({' + '.join(f'greatest(ceil((n - {k}) / {STEP}.0), 0)' for k in LENGTHS)} AS BIGINT) AS windows FROM s")
def sweep_size(spark, sf):
    counts = views.bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return counts.select("symbol", "n", report.windows_of_sweep(F.col("n"), LENGTHS, STEP).cast("long").alias("windows"))


@query("""SELECT DISTINCT (l_linenumber - 1)::INT AS value, unit, CASE unit WHEN 'days' THEN greatest(l_linenumber - 1, 1) WHEN 'weeks' THEN (l_linenumber - 1) * 5 WHEN 'months' THEN (l_linenumber - 1) * 21 WHEN 'years' THEN (l_linenumber - 1) * 252 ELSE l_linenumber - 1 END::INT AS bars
FROM lineitem, (VALUES ('days'), ('weeks'), ('months'), ('years'), ('eons')) AS u(unit)""")
def horizon_bars(spark, sf):
    """Horizons in several units as bars."""
    values = views.read(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("value")).distinct()
    each = values.select("value", F.explode(F.array(*[F.lit(u) for u in (*report.UNITS, "eons")])).alias("unit"))
    return each.select("value", "unit", report.trading_days(F.col("value"), F.col("unit")).cast("int").alias("bars"))


@query(f"WITH {BARS}, l AS (SELECT max(bar_date) AS as_of FROM bars) SELECT symbol, count(*) AS n, min(bar_date) AS first, max(bar_date) AS last FROM bars, l WHERE bar_date >= as_of - INTERVAL 6 MONTH GROUP BY 1")
def cutoff_filter(spark, sf):
    """Bars of the last six months before the latest one of all."""
    bars = views.bars(spark, sf)
    dated = bars.join(F.broadcast(bars.agg(F.max("bar_date").alias("as_of"))))  # one row
    return report.since(dated, F.col("as_of"), 6).groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar_date").alias("first"), F.max("bar_date").alias("last"))


@query(f"WITH {BARS} SELECT symbol, CAST(max(bar_date) - 730 AS DATE) AS options_from, CAST(max(bar_date) - 1825 AS DATE) AS bars_from FROM bars GROUP BY 1")
def date_bounds(spark, sf):
    last = views.bars(spark, sf).groupBy("symbol").agg(F.max("bar_date").alias("d"))
    return last.select("symbol", report.earliest(F.col("d"), 2).alias("options_from"), report.earliest(F.col("d"), 5).alias("bars_from"))


STATS = """w AS (SELECT *, round(equity / lag(equity) OVER (PARTITION BY symbol, series ORDER BY bar_date) - 1, 12) AS r, equity / max(equity) OVER (PARTITION BY symbol, series ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cv WHERE equity IS NOT NULL),
g AS (SELECT symbol, series, count(*) AS n, max_by(equity, bar_date) / min_by(equity, bar_date) AS grown, min(dd) * 100 AS mdd, avg(r) AS m, stddev_samp(r) AS sd, 100.0 * count(*) FILTER (r > 0) / nullif(count(r), 0) AS hit,
 coalesce(100 * avg(r) FILTER (r > 0), 0) AS aw, coalesce(100 * avg(r) FILTER (r < 0), 0) AS al, count(r) AS trades FROM w GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT symbol, series, round(ln(grown), 6) AS log_growth, round(ln(grown) * 252 / n, 6) AS log_growth_a_year, round(mdd, 6) AS max_drawdown, round(coalesce(m / nullif(sd, 0) * sqrt(252), 0), 6) AS sharpe, round(hit, 6) AS hit_rate, round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, trades FROM g"""
ALLOCATED = ORACLES["spot_allocator"].replace(" + 1e-09, 6)", ", 6)")


RANDOM = f"""{NUMBERED}, rd AS (SELECT *, ('0x' || substr(md5('42|' || symbol || '|' || rn), 1, 8))::BIGINT AS mix FROM b WHERE rn < n - 11), re AS (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mix, rn) <= 25),
rt AS (SELECT re.symbol, unnest(range(re.rn + 1, re.rn + 11)) AS rn, pow(y.close / re.close, 0.1) - 1 AS d FROM re JOIN b y ON y.symbol = re.symbol AND y.rn = re.rn + 10), rs AS (SELECT symbol, rn, sum(d) AS d FROM rt GROUP BY 1, 2),
rc AS (SELECT symbol, bar_date, exp(sum(ln(1 + greatest(coalesce(d, 0), -0.999999999))) OVER (PARTITION BY symbol ORDER BY bar_date ROWS UNBOUNDED PRECEDING)) AS equity FROM b LEFT JOIN rs USING (symbol, rn))"""


@query(f"WITH {PAIR}, {RANDOM}, st AS ({ALLOCATED}), cv AS (SELECT symbol, bar_date, 'strategy' AS series, exp(log_equity) AS equity FROM st UNION ALL SELECT symbol, bar_date, 'asset', close FROM pair UNION ALL SELECT symbol, bar_date, 'benchmark', bench FROM pair UNION ALL SELECT symbol, bar_date, 'random', equity FROM rc), {STATS}")
def results_table(spark, sf):
    """Strategy, asset, benchmark and a baseline of random entries, each with the same statistics, in one table.

    Growth is shown as logarithms: the synthetic series grow beyond what a percentage shows."""
    pair, bars = views.pair(spark, sf), views.bars(spark, sf)
    other = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(c).alias("equity")) for n, c in (("asset", "close"), ("benchmark", "bench"))])).alias("x")
    curves = pair.select("symbol", "bar_date", other).select("symbol", "bar_date", "x.*")
    named = lambda df, name: df.select("symbol", "bar_date", F.lit(name).alias("series"), F.exp("log_equity").alias("equity"))
    curves = curves.unionByName(named(QUERIES["spot_allocator"](spark, sf), "strategy")).unionByName(named(trades.accrued(bars, trades.random_entries(bars, 25, 10)), "random"))
    out = report.equity_stats(curves, ("symbol", "series"))
    growth = F.log1p(F.col("total_return") / 100)
    return out.select("symbol", "series", r6(growth, "log_growth"), r6(F.log1p(F.col("cagr") / 100), "log_growth_a_year"), *[r6(c) for c in ("max_drawdown", "sharpe", "hit_rate", "avg_win", "avg_loss")], "trades")
