import datetime
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.options import bs_price, norm_cdf, with_bs_price
from tidemark.operators import align, allocation, dislocation, indicators, probability, rules, sleeve, surface, trades
from tidemark.sources import views

DAY = datetime.date(2020, 1, 1)


def bars(spark, closes, symbol="x", **more):
    rows = [(symbol, DAY + datetime.timedelta(days=i), None if c is None else float(c)) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, bar_date date, close double")
    for k, v in more.items():
        df = df.join(spark.createDataFrame([(DAY + datetime.timedelta(days=i), float(x)) for i, x in enumerate(v)], f"bar_date date, {k} double"), "bar_date", "left")
    return df.select("symbol", "bar_date", "close", *more)


def values(df, col):
    return [r[col] for r in df.orderBy("bar_date").collect()]


def test_normal_distribution():
    x = np.concatenate([np.linspace(-9, 9, 2001), [-40.0, 40.0]])
    exact = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(norm_cdf(x) - exact).max() < 1e-14


def test_known_price(spark):
    assert round(float(bs_price(100.0, 100.0, 30 / 365, 0.5, True)), 6) == 5.713768
    df = spark.createDataFrame([("c", 100.0, 100.0, 30 / 365, 0.5), ("p", 100.0, 90.0, 0.0, 0.5), ("c", 0.0, 90.0, 1.0, 0.5), ("p", 80.0, 90.0, 1.0, 0.3)], "kind string, s double, k double, t double, v double")
    got = [r["bs"] for r in with_bs_price(df, "s", "k", "t", "v").collect()]
    assert got == pytest.approx([5.713768, 0.0, 0.0, float(bs_price(80.0, 90.0, 1.0, 0.3, False))], abs=1e-6)


def test_known_metrics(spark):
    df = bars(spark, [1.0, 1.01, 0.99, 1.02, 1.05, 1.03, 1.06]).withColumnsRenamed({"close": "equity", "symbol": "series"})
    r = allocation.risk_metrics(df, ("series",), 0.2).first()
    assert [round(r[c], 2) for c in ("total_return", "cagr", "vol", "max_drawdown", "sharpe", "sortino", "calmar", "capital_at_risk", "return_at_risk")] == [6.0, 714.73, 38.14, -1.98, 6.61, 297.56, 360.94, 20.0, 30.0]


def test_known_probability_grid(spark):
    close = 100 * np.cumprod(1 + 0.02 * np.random.default_rng(42).standard_normal(300))
    got = {(r["horizon"], r["magnitude"]): (round(r["up_prob"], 1), round(r["down_prob"], 1), r["n"]) for r in probability.grid(bars(spark, close), [5, 20, 60], [0.05, 0.1, 0.2]).collect()}
    assert got == {
        (5, 0.05): (46.1, 52.2, 295), (5, 0.1): (44.7, 50.8, 295), (5, 0.2): (44.7, 49.8, 295), (20, 0.05): (41.4, 58.2, 280), (20, 0.1): (41.4, 58.2, 280),
        (20, 0.2): (41.1, 58.2, 280), (60, 0.05): (29.6, 70.0, 240), (60, 0.1): (29.2, 69.6, 240), (60, 0.2): (28.7, 68.8, 240),
    }


@pytest.mark.parametrize("n", [0, 1])
def test_metrics_of_short_curves(spark, n):
    df = bars(spark, [5.0, 6.0][:n]).withColumnsRenamed({"close": "equity", "symbol": "series"})
    rows = allocation.risk_metrics(df, ("series",)).collect()
    assert len(rows) == n and all(r["total_return"] == r["sharpe"] == r["max_drawdown"] == 0.0 for r in rows)


def test_windows_are_null_until_full(spark):
    df = bars(spark, [1, 2, None, 4, 5, 6])
    assert values(df.withColumn("v", indicators.sma(3)), "v") == [None, None, None, None, None, 5.0]
    flat = indicators.with_returns(bars(spark, [3.0] * 40))
    assert values(flat.withColumn("v", indicators.bollinger_b(20)), "v") == [None] * 40


def test_rsi_is_null_without_falls(spark):
    assert values(indicators.rsi(bars(spark, range(1, 30))), "rsi") == [None] * 29


def test_ewm_against_pandas(spark):
    close = np.random.default_rng(1).uniform(50, 150, 80)
    got = values(indicators.ema(bars(spark, close), [20]), "ema_20")
    assert got == pytest.approx(pd.Series(close).ewm(span=20, adjust=False).mean().tolist())


def test_period_percentile_against_loop(spark):
    close = np.random.default_rng(2).uniform(50, 150, 90)
    r = pd.Series(close).pct_change(5) * 100
    want = [float((r[:i].dropna() <= r[i]).mean() * 100) if i >= 20 and len(r[:i].dropna()) >= 30 else None for i in range(90)]
    assert values(indicators.period_percentile(bars(spark, close), 5), "pctile") == pytest.approx(want)


def test_fill_keeps_the_asset_calendar(spark):
    right = spark.createDataFrame([(DAY, 1.0), (DAY + datetime.timedelta(days=2), 3.0), (DAY + datetime.timedelta(days=9), 9.0)], "bar_date date, bench double")
    left = bars(spark, [1, 1, 1, 1]).where(f"bar_date <> '{DAY + datetime.timedelta(days=2)}'")
    assert values(align.filled(left, right, "bench"), "bench") == [1.0, 1.0, 1.0]


def test_asof_before_the_first_bar_is_null(spark):
    targets = spark.createDataFrame([("x", DAY - datetime.timedelta(days=1)), ("x", DAY + datetime.timedelta(days=30)), ("y", DAY)], "symbol string, target date")
    got = {(r["symbol"], r["target"]): r["asof_close"] for r in align.asof(bars(spark, [1, 2, 3]), targets).collect()}
    assert list(got.values()).count(None) == 2 and got["x", DAY + datetime.timedelta(days=30)] == 3.0


def test_no_variance_no_beta(spark):
    df = dislocation.log_returns(bars(spark, np.linspace(1, 2, 30), bench=[5.0] * 30))
    assert values(dislocation.with_betas(df, (5,)), "beta_5") == [None] * 29


def test_verdict_is_monotone(spark):
    df = spark.createDataFrame([(float(z),) for z in np.linspace(-3, 3, 61)], "z double").select("z", dislocation.verdict(dislocation.F.col("z")).alias("v"))
    ranks = [["BUY", "WEAK BUY", "NEUTRAL", "WEAK SELL", "SELL"].index(r["v"]) for r in df.orderBy("z").collect()]
    assert ranks == sorted(ranks) and set(ranks) == set(range(5))


def test_allocation_stays_in_bounds_and_looks_back_only(spark):
    rng = np.random.default_rng(4)
    close, bench = 100 * np.cumprod(1 + 0.03 * rng.standard_normal(200)), 300 * np.cumprod(1 + 0.01 * rng.standard_normal(200))
    full = bars(spark, close, bench=bench)
    a = values(allocation.panel(full, floor=0.0, ceiling=2.0), "allocation")
    assert min(a) >= 0.02 and max(a) <= 0.98
    short = full.where(f"bar_date < '{DAY + datetime.timedelta(days=150)}'")
    assert values(allocation.panel(short, lookback=40), "allocation") == values(allocation.panel(full, lookback=40), "allocation")[:150]


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 120), st.integers(0, 10_000), st.floats(0.05, 0.9), st.floats(0.8, 1.2))
def test_sleeve_invariants(n, seed, share, moneyness):
    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + np.clip(0.08 * rng.standard_normal((n, 1)), -0.7, 0.9), axis=0)
    s = sleeve.simulate(close, np.full((n, 1), 0.6), np.array([share]), moneyness=moneyness)
    assert np.allclose(s["equity"], s["sleeve"] + s["cash"]) and (s["cash"] >= -1e-9).all() and (s["equity"] > 0).all()
    held, rolled = s["contracts"][:, 0], s["rolled"][:, 0] > 0
    grew = np.nonzero(held[1:] > held[:-1] * (1 + 1e-12))[0] + 1
    assert all(rolled[i] or held[i - 1] == 0 for i in grew)
    assert (s["sigma"] >= 0.2).all() and (s["sigma"] <= 2).all()


def test_sleeve_against_a_plain_loop():
    rng = np.random.default_rng(9)
    close, alloc = 100 * np.cumprod(1 + 0.04 * rng.standard_normal(150)), rng.uniform(0.1, 0.9, 150)
    got = sleeve.simulate(close[:, None], alloc[:, None], np.array([0.3]))
    sigma = got["sigma"][:, 0]
    cash, held, strike, end, want = 1.0, 0.0, 0.0, -1, []
    for i, p in enumerate(close):
        price = 0.0 if not held else float(bs_price(p, strike, max((end - i) / 365, 1e-6), sigma[i], True)) if end > i else max(p - strike, 0.0)
        value = held * price
        if held and (end - i <= 10 or price <= 1e-6):
            cash, held, value = cash + value, 0.0, 0.0
        goal = (cash + value) * 0.3 * alloc[max(i - 1, 0)]
        new = float(bs_price(p, p, 45 / 365, sigma[i], True))
        if not held:
            if new > 1e-6 and goal > 1e-9:
                held, strike, end, cash, value = goal / new, p, i + 45, cash - goal, goal
        elif price > 1e-6 and goal < value:
            cash, held, value = cash + value - goal, goal / price, goal
        want.append(cash + value)
    assert got["equity"][:, 0] == pytest.approx(want)


def test_greedy_leaves_no_overlap(spark):
    rows = [("x", i, i + k) for i, k in zip(range(0, 60, 2), [9, 1, 5, 30, 2] * 6, strict=True)]
    for gap in (0, 1):
        got = sorted((r["rn"], r["exit_rn"]) for r in trades.greedy(spark.createDataFrame(rows, "symbol string, rn int, exit_rn int"), gap).collect())
        assert all(b[0] >= a[1] + gap for a, b in zip(got, got[1:], strict=False)) and got[0] == (0, 9)


def _loop(close, s, entry, exits):
    out, open_at = [], None
    for i in range(1, len(close)):
        if open_at is not None:
            held, move = i - open_at, (close[i] / close[open_at] - 1) * 100 * (-1 if s.direction == "Short" else 1)
            why = "take_profit" if s.tp_pct and move >= s.tp_pct else "stop" if s.stop_pct and move <= -s.stop_pct else "max_hold" if s.max_hold and held >= s.max_hold else "exit_rule" if exits[i] or held > 4 else None
            if why:
                out.append((open_at, i, why))
                open_at = None
        if open_at is None and entry[i]:
            open_at = i
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["Long", "Short", "Both"]), st.sampled_from([0, 3, 8]), st.sampled_from([0, 10.0]), st.sampled_from([0, 15.0]))
def test_strategy_trades_against_a_plain_loop(seed, direction, hold, stop, profit):
    rng = np.random.default_rng(seed)
    close, entry, exits = 100 * np.cumprod(1 + 0.1 * np.clip(rng.standard_normal(60), -3, 3)), rng.random(60) < 0.2, rng.random(60) < 0.1
    static = rules.Condition(rules.Side("Asset price"), ">", rules.Side(value=0.0))
    days = rules.Condition(rules.Side(rules.DAYS_HELD), ">", rules.Side(value=4.0))
    s = rules.Strategy(rules.Panel((static,)), rules.Panel((static, days), "OR"), hold, stop, profit, direction)
    assert rules.trades_of(close, s, {0: entry}, {0: exits}) == _loop(close, s, entry, exits)


def test_documents_are_normalized():
    assert len(rules.CATALOG) == 22
    doc = '<strategy>```json\n{"entry": {"combinator": "XOR", "conditions": [{"lhs": {"kind": "indicator", "indicator": "RSI(N)"}, "op": "<", "rhs": {"kind": "value", "value": 30}}, {"lhs": {"kind": "indicator", "indicator": "No such"}, "op": "<", "rhs": {"kind": "value", "value": 1}}, {"lhs": 1, "op": "~", "rhs": 2}]}, "controls": {"max_hold": 0, "direction": "Up"}}\n```</strategy>'
    s = rules.parse(doc)
    assert s.entry == rules.Panel((rules.Condition(rules.Side("RSI(N)", 14), "<", rules.Side(value=30.0)),)) and (s.max_hold, s.stop_pct, s.tp_pct, s.direction) == (60, 15.0, 30.0, "Long")
    assert rules.parse("not json") is None and rules.normalize({"entry": {}}) is None and rules.normalize(None) is None


def test_bars_without_a_close_do_not_count(spark):
    always = rules.Condition(rules.Side("Benchmark price"), ">", rules.Side(value=0.0))
    b = bars(spark, [100.0, 100.0, 101.0, None, 102.0, 103.0], bench=[1.0] * 6)
    got = rules.simulate(b, rules.Strategy(rules.Panel((always,)), rules.Panel(()), 2, 0, 0, "Long")).orderBy("entry_date").first()
    dates = [r["bar_date"] for r in b.orderBy("bar_date").collect()]
    assert (got["entry_date"], got["exit_date"], got["exit_price"], got["days_held"]) == (dates[1], dates[4], 102.0, 2)


def test_names_of_documents_are_known(spark):
    for name, own in rules.ALIASES.items():
        assert own in rules.CATALOG and rules._side({"kind": "indicator", "indicator": name}).indicator == own
    rows = {r["name"]: r for r in rules.catalog(spark).collect()}
    assert len(rows) == 22 and rows["RSI(N)"]["default_n"] == 14 and rows["Vol Regime Label"]["categories"] == ["CHEAP", "MID-RANGE", "EXPENSIVE"]


def test_runs_without_finite_metrics_have_a_row(spark):
    rng = np.random.default_rng(4)
    close = 100 * np.cumprod(1 + 0.02 * rng.standard_normal(40))
    close[5] = np.inf
    runs = sleeve.sweep(bars(spark, close.tolist(), bench=(100 + np.arange(40.0)).tolist()), lengths=(40,), step=20)
    rows = runs.collect()
    assert len(rows) == len(sleeve.PARAMS) and all("not finite" in r["error"] and r["tr_strat"] is None for r in rows)
    assert sleeve.rollup(runs).where("dimension = 'overall'").first()["n"] == 0


def test_every_indicator_compiles(spark):
    rng = np.random.default_rng(3)
    df = bars(spark, rng.uniform(90, 110, 80), bench=rng.uniform(290, 310, 80), volidx=rng.uniform(10, 40, 80)).withColumn("high", views.F.col("close") + 1).withColumn("low", views.F.col("close") - 1)
    sides = [rules.Side(i.name, i.n if i.name != "Period Percentile(N)" else 5, i.n2) for i in rules.CATALOG.values() if i.name != rules.DAYS_HELD]
    out, names = rules.with_indicators(df, sides)
    assert out.count() == 80 and len(names) == 21


def test_categories_know_equality_only(spark):
    df = bars(spark, range(1, 400), bench=range(1, 400), volidx=range(1, 400))
    side = {"kind": "indicator", "indicator": "Surface Signal (Calls)"}
    for op, want in (("=", True), (">", False)):
        s = rules.normalize({"entry": {"conditions": [{"lhs": side, "op": op, "rhs": {"kind": "category", "value": "SELL"}}]}})
        assert any(values(rules.evaluate(df, s.entry), "signal")) is want


def test_accrual_gives_back_the_return(spark):
    b = bars(spark, [100, 110, 121, 100, 90, 99])
    t = trades._trades(trades.numbered(b), trades.numbered(b).where("rn = 0").withColumn("exit_rn", views.F.lit(2)), 0)
    assert np.exp(values(trades.accrued(b, t), "log_equity"))[-1] == pytest.approx(1.21)


def test_rising_call_is_dropped_and_outlier_found(spark):
    rows = [("c", 30, float(k), k / 100, 10.0 - i if k != 110 else 50.0, 0.3 if k != 105 else 1.0) for i, k in enumerate(range(95, 125, 5))]
    df = spark.createDataFrame(rows, "kind string, dte int, strike double, mny double, mid double, iv double")
    assert 110.0 not in {r["strike"] for r in surface.no_arbitrage(df).collect()}
    assert {r["strike"] for r in surface.local_outliers(df, k=5).where("outlier").collect()} == {105.0}


def test_spline_goes_through_its_points():
    x, y = np.array([0.0, 1.0, 2.5, 3.0, 4.0]), np.array([1.0, 3.0, 2.0, 2.5, 0.0])
    assert surface.natural_spline(x, y, x) == pytest.approx(y)
    assert np.isnan(surface.natural_spline(x, y, np.array([-1.0, 9.0]))).all()
    assert surface.natural_spline(x, 2 * x + 1, np.array([0.3, 2.7])) == pytest.approx([1.6, 6.4])


def test_short_series_is_one_window(spark):
    got = sleeve.plan(spark.createDataFrame([("x", 300), ("y", 50)], "symbol string, n long")).collect()
    assert {(r["symbol"], r["window_len"], r["start"]) for r in got} == {("x", 126, 0), ("x", 126, 126), ("x", 126, 174), ("x", 252, 0), ("x", 252, 48), ("x", 300, 0), ("y", 50, 0)}


def test_rollup_has_all_regimes(spark):
    rng = np.random.default_rng(5)
    runs = sleeve.sweep(bars(spark, 100 * np.cumprod(1 + 0.02 * rng.standard_normal(140)), bench=300 * np.cumprod(1 + 0.01 * rng.standard_normal(140))), lengths=(126,))
    out = sleeve.rollup(runs)
    assert {r["value"] for r in out.where("dimension = 'regime'").collect()} == {"bull", "bear", "sideways"}
    assert sleeve.sweep_verdict(out).count() == 1


def test_empty_tables(spark):
    none = bars(spark, [])
    pair = bars(spark, [], bench=[])
    for df in (indicators.vol_regime(none), indicators.ema(none, [5]), probability.grid(none, [5], [1.0]), trades.after_falls(none), allocation.panel(pair), sleeve.call_sleeve(pair), sleeve.sweep(pair), dislocation.zcube(dislocation.log_returns(pair))):
        assert df.count() == 0
