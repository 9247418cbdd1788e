import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scattered, surface

POINTS = "g string, p int, x double, y double, v double"


def clouds(rng):
    out = [("dense", k, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for k in range(150)] + [("dense", 1000 + k, rng.uniform(-5, 5), rng.uniform(-5, 5)) for k in range(60)]
    out += [("lattice", k, float(k % 10), 7.0 * (k // 10)) for k in range(80)]
    out += [("one place", k, 1.0, 2.0) for k in range(40)] + [("line", k, float(k), 3.0) for k in range(30)] + [("few", k, float(k), 0.5 * k) for k in range(3)]
    return [(g, p, x, y, float(p)) for g, p, x, y in out]


def brute(points, x, y, g, k, without=None):
    gaps = sorted((round((x - a) ** 2 + (y - b) ** 2, 9), p) for h, p, a, b, _ in points if h == g and p != without)
    return [p for _, p in gaps[:k]]


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_against_all_pairs(spark, k):
    points = clouds(random.Random(k))
    df = spark.createDataFrame([*points, ("few", 9, None, 1.0, 0.0)], POINTS)
    found = scattered.nearest(df, df.withColumnRenamed("p", "q"), k, other=True, digits=9).collect()
    got = {(r["g"], r["q"]): [n["p"] for n in r["near"]] for r in found}
    assert got == {(g, p): brute(points, x, y, g, k, p) for g, p, x, y, _ in points if brute(points, x, y, g, k, p)}


def test_nearest_of_places_outside(spark):
    points = clouds(random.Random(3))
    rng = random.Random(4)
    asked = [(g, k, rng.uniform(-30, 30), rng.uniform(-30, 90)) for k, g in enumerate(("dense", "lattice", "line", "none") * 12)]
    df = spark.createDataFrame(points, POINTS)
    found = scattered.nearest(df, spark.createDataFrame(asked, "g string, q int, x double, y double"), 4, digits=9).collect()
    assert {r["q"]: [n["p"] for n in r["near"]] for r in found} == {q: brute(points, x, y, g, 4) for g, q, x, y in asked if g != "none"}
    assert scattered.nearest(df.limit(0), spark.createDataFrame(asked, "g string, q int, x double, y double"), 4).count() == 0


def test_pairs_grow_with_points(spark, monkeypatch):
    """Cells are searched, not kinds: a set 16 times as large has some 16 times the pairs, not 256 times."""
    made = []
    plain = scattered.cut

    def counted(df):
        out = plain(df)
        if "near" in out.columns:
            cells = out.select("g", "q", "level")
            made[-1] += cells.count()
        return out

    monkeypatch.setattr(scattered, "cut", counted)
    for n in (100, 1600):
        rng = random.Random(n)
        df = spark.createDataFrame([("a", k, rng.random(), rng.random(), 0.0) for k in range(n)], POINTS)
        made.append(0)
        index = scattered.indexed(df)
        scattered.nearest(index, df.withColumnRenamed("p", "q"), 5, other=True).count()
        # at the level looked at first, a query's nine cells hold few points each, whatever n is
        most = index.counts.where("n > 5").groupBy("level").agg(F.max("n").alias("n"), F.count("*").alias("c")).orderBy(F.desc("level")).first()
        assert most["n"] <= 40
    assert made[1] <= 40 * made[0]


def empty_circle_triangle(px, py, x, y):
    """By trying all triples: that with an empty circle which holds the place."""
    for ids in map(list, itertools.combinations(range(len(x)), 3)):
        m = np.array([x[ids], y[ids], np.ones(3)])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        cx, cy, r2 = scattered.circle(x[ids], y[ids])
        part = np.linalg.solve(m, [px, py, 1])
        if part.min() >= -1e-9 and not (np.delete((x - cx) ** 2 + (y - cy) ** 2, ids) < r2 - 1e-9).any():
            return ids, part
    return None


def test_interpolation_against_all_triples(spark, monkeypatch):
    monkeypatch.setattr(scattered, "AROUND", 4)  # so that circles have to call for more points
    monkeypatch.setattr(scattered, "CENTRE", 3)
    rng = np.random.default_rng(8)
    clouds = {"a": rng.random((18, 2)), "b": rng.random((18, 2)) * [1, 40], "c": np.vstack([rng.random((9, 2)) * 0.01, rng.random((8, 2))])}
    values = {g: rng.random(len(c)) for g, c in clouds.items()}
    points = [(g, float(a), float(b), float(v)) for g, c in clouds.items() for (a, b), v in zip(c, values[g], strict=True)]
    asked = [(g, k, float(a), float(b)) for g, c in clouds.items() for k, (a, b) in enumerate(rng.random((25, 2)) * c.max(axis=0) * 1.1)]
    got = {(r["g"], r["q"]): (r["how"], r["v"]) for r in scattered.interpolated(spark.createDataFrame(points, "g string, x double, y double, v double"), spark.createDataFrame(asked, "g string, q int, x double, y double")).collect()}
    assert len(got) == len(asked)
    for g, q, px, py in asked:
        x, y = clouds[g].T
        found = empty_circle_triangle(px, py, x, y)
        want = ("linear", float(found[1] @ values[g][found[0]])) if found else ("nearest", float(values[g][((x - px) ** 2 + (y - py) ** 2).argmin()]))
        assert got[g, q][0] == want[0] and got[g, q][1] == pytest.approx(want[1], abs=1e-6)


def test_interpolation_of_planes_lattices_and_lines(spark):
    lattice = [("lattice", float(i), 7.0 * j, 2.0 * i - 3 * j) for i in range(8) for j in range(6)]
    points = [*lattice, lattice[0], ("line", 0.0, 0.0, 1.0), ("line", 1.0, 0.0, 5.0), ("pair", 0.0, 0.0, 2.0), ("pair", 0.0, 0.0, 4.0), ("null", None, 0.0, 1.0)]
    asked = [("lattice", 1, 2.25, 10.5), ("lattice", 2, 3.0, 14.0), ("lattice", 3, 7.0, 35.0), ("lattice", 4, -5.0, -5.0), ("line", 5, 0.9, 0.0), ("pair", 6, 9.0, 9.0), ("null", 7, 0.0, 0.0)]
    got = {r["q"]: (round(r["v"], 6), r["how"]) for r in scattered.interpolated(spark.createDataFrame(points, "g string, x double, y double, v double"), spark.createDataFrame(asked, "g string, q int, x double, y double")).collect()}
    assert got == {1: (0.0, "linear"), 2: (0.0, "linear"), 3: (-1.0, "linear"), 4: (0.0, "nearest"), 5: (5.0, "nearest"), 6: (3.0, "nearest")}


def dense_spline(x, y, at):
    n, h = len(x), np.diff(x)
    system, right = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(system, right)
    i = int(np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2))
    a, b = x[i + 1] - at, at - x[i]
    return (m[i] * a**3 + m[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * a + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b


@pytest.mark.parametrize("n", [4, 5, 6, 30])
def test_spline_and_what_is_left_out_against_dense_solves(n):
    rng = np.random.default_rng(n)
    x, y = np.sort(rng.random(n) * 3), rng.random(n)
    at = rng.uniform(x[0], x[-1], 20)
    assert surface.natural_spline(x, y, at) == pytest.approx([dense_spline(x, y, a) for a in at])
    got = surface.without_each(x, y)
    assert np.isnan(got[[0, -1]]).all()
    assert got[1:-1] == pytest.approx([dense_spline(np.delete(x, i), np.delete(y, i), x[i]) for i in range(1, n - 1)])


def test_fit_without_strikes_and_signal_places(spark):
    rows = [("c", 30, 80.0 + 5 * k, (80.0 + 5 * k) / 100, 5.0, 0.3 + 0.05 * (k == 3) - 0.04 * (k == 5)) for k in range(9)] + [("p", 30, 90.0, 0.9, 5.0, 0.3)]
    chain = spark.createDataFrame(rows, "kind string, dte int, strike double, mny double, mid double, iv double")
    fit = surface.spline_fit(chain, "loo").collect()
    assert all((r["fitted_iv"] is None) == (r["residual"] is None) for r in fit)
    assert {(r["kind"], r["strike"]) for r in fit if r["fitted_iv"] is None} == {("c", 80.0), ("c", 120.0), ("p", 90.0)}
    assert [r["residual"] for r in fit if r["kind"] == "p"] == [None]
    wide = chain.withColumn("fitted_iv", F.lit(0.3)).withColumn("residual", F.col("iv") / 0.3 - 1).withColumn("mid", F.lit(5.0))
    signals = surface.anomalies(wide.where("strike >= 95")).orderBy("side", "place").collect()
    for side, sign in (("BUY", 1), ("SELL", -1)):
        z = [sign * r["z"] for r in signals if r["side"] == side]
        assert z == sorted(z)


def test_surface_grid_covers_its_axes(spark):
    rows = [(k, d, 60.0 + 5 * i, 0.6 + 0.05 * i, 0.3 + 0.01 * i + 0.001 * d) for k in "cp" for d in (10, 40, 100) for i in range(12 if k == "c" else 3)]
    chain = spark.createDataFrame(rows, "kind string, dte int, strike double, mny double, iv double")
    got = surface.grid(chain).collect()
    assert {r["kind"] for r in got} == {"c"} and sorted({r["dte"] for r in got}) == [10, 40, 70, 100]
    for r in got:  # a plane inside the hull, the nearest contract beyond it
        if r["mny"] <= 1.15:
            assert r["iv"] == pytest.approx(0.3 + 0.2 * (r["mny"] - 0.6) + 0.001 * r["dte"], abs=1e-6)
    assert surface.grid(chain.where("kind = 'p'").limit(5)).count() == 0
