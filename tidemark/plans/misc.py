"""Queries over events, checks, audit rows and drawn lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.allocation import quality_verdict
from tidemark.plans.registry import BARS, query, r6
from tidemark.sources import views
from tidemark.streaming import event_bars


@query("""SELECT event_type, date_trunc('day', ts) AS day, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, count(*) AS n, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2""")
def events_tumbling(spark, sf):
    """Daily bars of events by type: the batch form of the streaming query."""
    out = event_bars.tumbling(views.read(spark, sf, "events"))
    return out.select("event_type", "day", "open", "high", "low", "close", "n", F.round("volume", 4).alias("volume"))


@query("""SELECT event_type, CAST(s AS TIMESTAMP) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), INTERVAL 12 HOUR)) AS s FROM events) GROUP BY 1, 2""")
def events_sliding(spark, sf):
    """Windows of a day every twelve hours."""
    out = event_bars.sliding(views.read(spark, sf, "events"))
    return out.select("event_type", "start", "n", r6("mean"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    """Sessions of users, closed by six idle hours."""
    return event_bars.sessions(views.read(spark, sf, "events")).select("user_id", "start", "last", "n")


@query(f"""WITH {BARS}, l AS (SELECT symbol, min(bar_date) AS d1, max(bar_date) AS d2, min_by(close, bar_date) AS y1, max_by(close, bar_date) AS y2 FROM bars GROUP BY 1),
p AS (SELECT *, log10(y1) + (log10(y2) - log10(y1)) / (d2 - d1) * (d2 + k - d1) AS e, k FROM l, (VALUES (-730), (0), (90), (730)) AS t(k))
SELECT symbol, k::INT AS days_ahead, CASE WHEN e BETWEEN -3 AND 6 THEN round(pow(10, e), 6) END AS price FROM p""")
def trendline_project(spark, sf):
    """Lines through first and last close, straight in log price, extended backward and forward."""
    line = views.bars(spark, sf).groupBy("symbol").agg(F.min("bar_date").alias("d1"), F.max("bar_date").alias("d2"), F.min_by("close", "bar_date").alias("y1"), F.max_by("close", "bar_date").alias("y2"))
    slope = (F.log10("y2") - F.log10("y1")) / F.nullif(F.datediff("d2", "d1"), F.lit(0))
    out = line.select("*", F.explode(F.array(*[F.lit(k) for k in (-730, 0, 90, 730)])).alias("days_ahead"))
    out = out.withColumn("e", F.log10("y1") + slope * (F.datediff("d2", "d1") + F.col("days_ahead")))
    return out.select("symbol", "days_ahead", F.when(F.col("e").between(-3, 6), r6(F.pow(F.lit(10.0), F.col("e")), "p")).alias("price"))


@query("""WITH q AS (SELECT doc_id, quality = 1 AS sound, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 100) / 100.0 END AS ai FROM labels)
SELECT sound, ai IS NULL AS unknown, count(*) AS n, count(*) FILTER (sound AND (ai IS NULL OR ai < 0.85)) AS passed FROM q GROUP BY 1, 2""")
def qc_verdict(spark, sf):
    q = views.read(spark, sf, "labels").select((F.col("quality") == 1).alias("sound"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 100) / 100.0).alias("ai"))
    return q.groupBy("sound", F.col("ai").isNull().alias("unknown")).agg(F.count("*").alias("n"), F.count_if(quality_verdict(F.col("sound"), F.col("ai"))).alias("passed"))


CHECKS = f"""{BARS}, c AS (SELECT symbol AS name, 'series' AS grp, CASE WHEN count(*) < 2 THEN 'skip' WHEN min(close) <= 0 OR max(bar_date) < (SELECT max(bar_date) FROM bars) - 365 THEN 'fail' ELSE 'pass' END AS status FROM bars GROUP BY 1)"""


@query(f"WITH {CHECKS} SELECT grp, status, count(*) AS n FROM c GROUP BY 1, 2")
def diagnostic_rollup(spark, sf):
    """Freshness and sanity of each series, counted by status."""
    bars = views.bars(spark, sf)
    latest = bars.agg(F.max("bar_date").alias("latest"))  # one row
    checks = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("close").alias("low"), F.max("bar_date").alias("last")).crossJoin(F.broadcast(latest))
    status = F.when(F.col("n") < 2, "skip").when((F.col("low") <= 0) | (F.col("last") < F.date_sub("latest", 365)), "fail").otherwise("pass")
    return checks.groupBy(F.lit("series").alias("grp"), status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {BARS}, l AS (SELECT max(bar_date) AS latest FROM bars), c AS (SELECT symbol, count(*) AS n, min(close) AS low, max(bar_date) AS last FROM bars GROUP BY 1)
SELECT symbol AS name, 'series' AS grp, CASE WHEN n < 2 THEN 'skip' WHEN low <= 0 OR last < latest - 365 THEN 'fail' ELSE 'pass' END AS status, n AS bars, last, CAST(latest - last AS INT) AS days_behind,
CASE WHEN n < 2 THEN 'under two bars' WHEN low <= 0 THEN 'close not positive' WHEN last < latest - 365 THEN 'over a year behind' ELSE 'ok' END AS evidence FROM c, l""")
def health_table(spark, sf):
    """One row a check, with its evidence."""
    bars = views.bars(spark, sf)
    latest = bars.agg(F.max("bar_date").alias("latest"))  # one row
    c = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("close").alias("low"), F.max("bar_date").alias("last")).crossJoin(F.broadcast(latest))
    behind = F.datediff("latest", "last")
    evidence = F.when(F.col("n") < 2, "under two bars").when(F.col("low") <= 0, "close not positive").when(behind > 365, "over a year behind").otherwise("ok")
    status = F.when(evidence == "ok", "pass").when(evidence == "under two bars", "skip").otherwise("fail")
    return c.select(F.col("symbol").alias("name"), F.lit("series").alias("grp"), status.alias("status"), F.col("n").alias("bars"), "last", behind.alias("days_behind"), evidence.alias("evidence"))


@query("SELECT event_id, ts, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def audit_recent_rows(spark, sf):
    """The ten most recent rows of an audit log, with a field of their JSON evidence."""
    df = views.read(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    return df.select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus))")
def grouping_sets(spark, sf):
    df = views.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return df.groupingSets([[], ["priority"], ["status"]], "priority", "status").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
