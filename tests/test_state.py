"""Snapshots, interval joins, functions of SQL, chunks of series, and state of streams."""

import datetime
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.operators import align, indicators, rules
from tidemark.sources import files, sinks, snapshots
from tidemark.streaming import event_bars


def test_snapshots_are_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots.read(spark, path) is None and snapshots.versions(spark, path) == []
    one = snapshots.publish(spark.range(3), path)
    reader = snapshots.read(spark, path)  # begun before the next write
    two = snapshots.publish(spark.range(5), path)
    assert (one.number, two.number) == (1, 2) and reader.count() == 3 and snapshots.read(spark, path).count() == 5
    assert snapshots.read(spark, path, number=1).count() == 3
    with pytest.raises(Exception, match="no"):
        snapshots.publish(spark.range(9).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert snapshots.current(spark, path) == two and snapshots.read(spark, path).count() == 5
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark.range(1), path, after=1)
    assert snapshots.read(spark, path).count() == 5


def test_snapshots_grow_old_and_are_cleared(spark, tmp_path, monkeypatch):
    path, loads = str(tmp_path / "s"), []

    def load():
        loads.append(1)
        return spark.range(len(loads))

    assert snapshots.cached(spark, path, load, 60).count() == 1 and snapshots.cached(spark, path, load, 60).count() == 1 and len(loads) == 1
    now = snapshots.time.time()
    monkeypatch.setattr(snapshots.time, "time", lambda: now + 61)
    assert snapshots.read(spark, path, max_age=60) is None and snapshots.cached(spark, path, load, 60).count() == 2
    with pytest.raises(ZeroDivisionError):
        monkeypatch.setattr(snapshots.time, "time", lambda: now + 200)
        snapshots.cached(spark, path, lambda: 1 / 0, 60)
    assert snapshots.read(spark, path).count() == 2
    snapshots.publish(spark.range(7), path)
    kept = [v.folder for v in snapshots.versions(spark, path)][-2:]
    gone = snapshots.vacuum(spark, path, keep=2)
    assert len(gone) == 1 and [v.folder for v in snapshots.versions(spark, path)] == kept and snapshots.read(spark, path).count() == 7


def test_a_writer_that_comes_second_takes_the_next_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    snapshots.publish(spark.range(1), path)
    seen, plain = [], snapshots._manifests

    def late(*a):  # the other writer publishes between look and rename
        found = plain(*a)
        if not seen:
            seen.append(1)
            monkeypatch.setattr(snapshots, "_manifests", plain)
            snapshots.publish(spark.range(2), path)
        return found

    monkeypatch.setattr(snapshots, "_manifests", late)
    assert snapshots.publish(spark.range(3), path).number == 3
    assert [snapshots.read(spark, path, number=n).count() for n in (1, 2, 3)] == [1, 2, 3]


def test_store_keeps_what_another_writer_saved(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    sinks.save_strategy(spark, path, "a", {"x": 1})
    plain = snapshots.publish

    def interrupted(df, where, after=None):
        monkeypatch.setattr(snapshots, "publish", plain)
        sinks.save_strategy(spark, path, "other", {})
        return plain(df, where, after)

    monkeypatch.setattr(snapshots, "publish", interrupted)
    assert set(sinks.save_strategy(spark, path, "b", {})) == {"a", "b", "other"}
    assert set(files.saved_documents(spark, path)) == {"a", "b", "other"} and set(files.saved_documents(spark, path, 1)) == {"a"}


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(2)
    points = [(s, k) for s in "ab" for k in range(500)] + [("a", 3)]
    spans = [(s, rng.randrange(-40, 520), rng.choice([0, 1, 7, 30, 400])) for s in "abc" for _ in range(30)] + [("a", None, 5), ("a", 5, None)]
    left, right = spark.createDataFrame(points, "symbol string, rn int"), spark.createDataFrame(spans, "symbol string, start int, len int")
    got = align.interval_join(left, right, ["symbol"], "rn", "start", "len", 32).collect()
    want = [(s, k, b, n) for s, k in points for t, b, n in spans if s == t and b is not None and n is not None and b <= k < b + n]
    assert sorted(map(tuple, got)) == sorted(want)


def test_interval_join_compares_near_pairs_only(spark):
    left = spark.range(20_000).select(F.lit("a").alias("symbol"), F.col("id").alias("rn"))
    right = spark.range(150).select(F.lit("a").alias("symbol"), (F.col("id") * 126).alias("start"), F.lit(252).alias("len"))
    joined = align.interval_join(left, right, ["symbol"], "rn", "start", "len", 126)
    compared = left.withColumn("b", F.floor(F.col("rn") / 126)).join(right.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / 126), F.floor((F.col("start") + 251) / 126)))), ["symbol", "b"]).count()
    assert joined.count() <= compared <= 2 * joined.count()


@pytest.mark.parametrize("n", [0, 1, 125, 126, 127, 700, 2520, 2700])
def test_sweep_windows_of_sql_are_the_plan(spark, n):
    from tidemark.operators.sleeve import plan

    sql.register(spark)
    bars = spark.range(n).select(F.lit("a").alias("symbol"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("bar_date"))
    got = spark.sql("SELECT * FROM sweep_windows(TABLE(SELECT symbol, bar_date FROM {b}) PARTITION BY symbol ORDER BY bar_date)", b=bars).collect()
    day = datetime.date(2000, 1, 1)
    assert all((r["from_date"] - day).days == r["start"] and (r["to_date"] - day).days == r["start"] + r["window_len"] - 1 for r in got)
    want = plan(bars.groupBy("symbol").agg(F.count("*").alias("n"))).collect()
    assert sorted((r["symbol"], r["window_len"], r["start"]) for r in got) == sorted(map(tuple, want))


def test_prices_of_sql(spark):
    sql.register(spark)
    r = spark.sql("SELECT norm_cdf(0D) a, norm_cdf(CAST(NULL AS DOUBLE)) b, bs_price('c', 100D, 100D, 30/365D, 0.5D, 0D) c, bs_price('p', 90D, 100D, 0D, 0.5D, 0D) d").first()
    assert r["a"] == 0.5 and r["b"] is None and r["c"] == pytest.approx(5.7138, abs=1e-4) and r["d"] == 10


def test_ewm_in_chunks_against_pandas(spark):
    rng = random.Random(6)
    values = [None if rng.random() < 0.3 else rng.uniform(1, 9) for _ in range(300)]
    values[40:130] = [None] * 90  # several chunks without a value
    day = datetime.date(2020, 1, 1)
    rows = [(s, day + datetime.timedelta(days=k * 2), v) for s, part in (("a", values), ("b", [None] * 50 + values), ("c", [None] * 10)) for k, v in enumerate(part)]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, x double").repartition(5)
    out = indicators.ewm(df, {"slow": ("x", 0.05), "fast": ("x", 0.7)}, chunk_days=32).orderBy("symbol", "bar_date").toPandas()
    for s, part in (("a", values), ("b", [None] * 50 + values), ("c", [None] * 10)):
        for name, alpha in (("slow", 0.05), ("fast", 0.7)):
            want = pd.Series(part, dtype="float64").ewm(alpha=alpha, adjust=False).mean().to_numpy()
            np.testing.assert_allclose(out[out["symbol"] == s][name].to_numpy(), want, rtol=1e-9)


def test_earlier_counts_against_a_loop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 300, 1000):
        x = np.round(rng.random(n), 2)
        assert indicators.earlier_no_greater(x).tolist() == [int((x[:i] <= x[i]).sum()) for i in range(n)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def _event(i, day, value, kind="a", hour=12):
    return i, datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day), 1, kind, value, "{}"


def test_running_mean_in_event_time_order(spark, rocks, tmp_path):
    """Files come out of order within the delay, and the stream is restarted after each."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        days = [0, 2, 1, 4, 3, 6, 5, 7]
        for k, d in enumerate([*days, 40]):
            spark.createDataFrame([_event(k, d, float(d + 1))], event_bars.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            event_bars.replay_batches(event_bars.running_ema(event_bars.read_stream(spark, str(tmp_path / "in")), 3, delay="3 days"), str(tmp_path / "out"), str(tmp_path / "state"))
        got = [(r["ts"].day, r["ema"]) for r in spark.read.parquet(str(tmp_path / "out")).select("ts", "ema").orderBy("ts").collect()]
        want, ema = [], None
        for d in sorted(days):
            ema = d + 1.0 if ema is None else 0.5 * ema + 0.5 * (d + 1)
            want.append((1 + d, pytest.approx(ema)))
        assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_idle_keys_begin_anew_and_late_rows_are_dropped(spark, rocks, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for rows in ([_event(1, 0, 8.0), _event(2, 0, 4.0, hour=13)], [_event(3, 50, 2.0)], [_event(4, 1, 100.0)], [_event(5, 90, 1.0, kind="b")], [_event(6, 120, 1.0, kind="b")]):
            spark.createDataFrame(rows, event_bars.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            event_bars.replay_batches(event_bars.running_ema(event_bars.read_stream(spark, str(tmp_path / "in")), 3, delay="1 hour", idle=20 * 86400.0), str(tmp_path / "out"), str(tmp_path / "state"))
        got = spark.read.parquet(str(tmp_path / "out")).where("event_type = 'a'").orderBy("ts").collect()
        assert [r["ema"] for r in got] == [8.0, 6.0, 2.0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    rows = [_event(i, i, float(i)) for i in range(4)]
    spark.createDataFrame(rows, event_bars.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    for state in ("one", "two"):  # without the first one's checkpoint the same batches are run again
        event_bars.replay_batches(event_bars.read_stream(spark, str(tmp_path / "in")).select("event_id"), str(tmp_path / "out"), str(tmp_path / state))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_plans_of_texts(spark):
    whole = {"title": "T", "cash_pct": 40, "tranches": [{"trigger": "-10%"}, {"status": "DONE", "notes": "n"}], "rules": [{"name": "r"}], "reserve": {"amount": "5"}, "extra": 1}
    say = lambda d: f"Here: ===STRATEGY_START===\n{d if isinstance(d, str) else json.dumps(d)}\n===STRATEGY_END=== done"
    texts = [say(whole), say({**whole, "tranches": []}), say({**whole, "rules": None}), say("{not json"), json.dumps(whole), None, "", "===STRATEGY_START===" + json.dumps(whole)]
    rows = files.plans(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")).orderBy("id").collect()
    assert [r["plan"] is None for r in rows] == [False] + [True] * 7
    p = rows[0]["plan"].asDict(recursive=True)
    assert (p["title"], p["subtitle"], p["cash_pct"], p["portfolio_total"], p["probabilities_used"]) == ("T", "", 40.0, 0.0, [])
    assert p["tranches"] == [{"trigger": "-10%", "action": "", "deploy_pct": "", "deploy_amount": "", "status": "WATCH", "notes": ""}, {"trigger": "", "action": "", "deploy_pct": "", "deploy_amount": "", "status": "DONE", "notes": "n"}]
    assert p["rules"] == [{"name": "r", "detail": ""}] and p["reserve"] == {"amount": "5", "pct": "", "label": "NEVER DEPLOY", "status": "PERMANENT FLOOR", "notes": ""}
    assert files.plans(spark.createDataFrame([], "text string")).count() == 0
    bare = say({"tranches": [{}], "rules": [{}]})
    assert files.plans(spark.createDataFrame([(bare,)], "text string"), title="X PLAN").first()["plan"]["title"] == "X PLAN"


def test_unknown_indicators_never_hold(spark):
    day = datetime.date(2020, 1, 1)
    bars = spark.createDataFrame([("a", day + datetime.timedelta(days=k), float(k + 1), 1.0, 1.0) for k in range(5)], "symbol string, bar_date date, close double, bench double, volidx double")
    known = rules.Condition(rules.Side("Asset price"), ">", rules.Side(value=2.0))
    for op in rules.OPERATORS:
        unknown = rules.Condition(rules.Side("No such"), op, rules.Side(value=1.0))
        got = {c: [r["signal"] for r in rules.evaluate(bars, rules.Panel((known, unknown), c)).orderBy("bar_date").collect()] for c in ("AND", "OR")}
        assert got == {"AND": [False] * 5, "OR": [False, False, True, True, True]}
    text = rules.catalog_text().splitlines()
    assert len(text) == len(rules.CATALOG) and "RSI(N): numeric, requires n (default 14)" in text and any("categorical, one of CHEAP, MID-RANGE, EXPENSIVE" in x for x in text)


def test_scores_of_series_far_from_zero(spark):
    from tidemark.functions.rolling import rolling_z

    rng = np.random.default_rng(2)
    day = datetime.date(2000, 1, 1)
    x = 1e7 + np.cumsum(rng.standard_normal(400)) * 1e-3
    rows = [("a", day + datetime.timedelta(days=k), float(v)) for k, v in enumerate(x)] + [("flat", day + datetime.timedelta(days=k), 1e9 / 3) for k in range(60)]
    got = rolling_z(spark.createDataFrame(rows, "symbol string, bar_date date, x double"), {"z": "x"}, 20).orderBy("symbol", "bar_date").toPandas()
    s = pd.Series(x - 1e7)
    want = ((s - s.rolling(20).mean()) / s.rolling(20).std()).to_numpy()
    np.testing.assert_allclose(got[got["symbol"] == "a"]["z"].to_numpy(), want, rtol=1e-4, atol=1e-4)
    assert got[got["symbol"] == "flat"]["z"].isna().all()


def test_window_results_of_contracts(spark):
    from tidemark.operators import surface

    day = datetime.date(2024, 3, 1)
    contracts = spark.createDataFrame([("c", 3, 100.0), ("p", 3, 90.0), ("c", 10, 80.0), ("c", 17, 80.0)], "kind string, dte int, strike double")
    at = lambda k, n, v: (*k, day - datetime.timedelta(days=n), v)
    bars = [at(("c", 3, 100.0), n, v) for n, v in ((50, 1.0), (40, 2.0), (10, 9.0), (0, 3.0), (-1, 50.0))] + [at(("p", 3, 90.0), 5, 1.0)] + [at(("c", 10, 80.0), n, v) for n, v in ((5, 0.0), (1, 4.0))]
    got = surface.window_pnl(contracts, spark.createDataFrame(bars, "kind string, dte int, strike double, bar_date date, close double"), F.lit(day), 10).collect()
    assert {(r["kind"], r["dte"]): (r["entry_close"], r["exit_close"], r["days_observed"], r["pnl"]) for r in got} == {("c", 3): (2.0, 3.0, 3, 50.0), ("p", 3): (None,) * 4, ("c", 10): (0.0, 4.0, 2, None), ("c", 17): (None,) * 4}


def test_reports_of_a_sleeve(spark):
    from tidemark.operators import allocation, sleeve

    day = datetime.date(2024, 1, 1)
    rng = np.random.default_rng(1)
    close = 100 * np.cumprod(1 + 0.02 * rng.standard_normal(90))
    pair = spark.createDataFrame([("a", day + datetime.timedelta(days=k), float(c), 100.0 + k) for k, c in enumerate(close)], "symbol string, bar_date date, close double, bench double")
    runs = sleeve.call_sleeve(pair).cache()
    p = runs.orderBy("bar_date").toPandas()
    d = sleeve.diagnostics(runs).first()
    assert d["mean_sleeve"] == pytest.approx(100 * (p["sleeve_value"] / p["equity"]).mean()) and d["rolls"] == p["rolled"].sum() and d["mean_sigma"] == pytest.approx(100 * p["sigma"].mean())
    h = sleeve.history(runs, 0.2, last=30).orderBy("bar_date").toPandas()
    assert len(h) == 30 and h["bar_date"].tolist() == p["bar_date"].tolist()[-30:]
    np.testing.assert_allclose(h["actual_fill"], (500 * p["actual"].tail(30)).round(2), atol=0.011)
    np.testing.assert_allclose(h["target_fill"], (100 * p["target"].tail(30)).round(2), atol=0.011)
    np.testing.assert_allclose(h["total"], p["equity"].tail(30).round(4), atol=1.1e-4)
    curves = runs.select("symbol", "bar_date", F.lit("sleeve").alias("series"), "equity").unionByName(runs.select("symbol", "bar_date", F.lit("asset").alias("series"), F.col("close").alias("equity")))
    m = allocation.risk_metrics(curves, capital_at_risk=1.0)
    ratio = {r["series"]: r["return_at_risk"] for r in m.collect()}
    assert ratio["sleeve"] != ratio["asset"] and sleeve.efficiency(m).first()["efficiency"] == pytest.approx(ratio["sleeve"] / ratio["asset"])
    assert sleeve.efficiency(m.where("series = 'sleeve'")).first()["efficiency"] is None


def test_results_in_percent(spark):
    from tidemark.operators import report

    day = datetime.date(2024, 1, 1)
    equity = [100.0, 110.0, 99.0, None, 105.0, 120.0]
    rows = [("a", day + datetime.timedelta(days=k), e) for k, e in enumerate(equity)] + [("b", day, 1.0)]
    got = report.equity_stats(spark.createDataFrame(rows, "symbol string, bar_date date, equity double")).collect()
    s = pd.Series([e for e in equity if e is not None])
    r = s.pct_change().dropna()
    assert len(got) == 1 and got[0]["total_return"] == pytest.approx(20.0) and got[0]["cagr"] == pytest.approx(100 * (1.2 ** (252 / 5) - 1))
    assert got[0]["max_drawdown"] == pytest.approx(100 * (s / s.cummax() - 1).min()) and got[0]["sharpe"] == pytest.approx(r.mean() / r.std() * 252**0.5)
    assert (got[0]["hit_rate"], got[0]["trades"]) == (75.0, 4) and got[0]["avg_win"] == pytest.approx(100 * r[r > 0].mean()) and got[0]["avg_loss"] == pytest.approx(100 * r[r < 0].mean())
