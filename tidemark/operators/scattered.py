"""Scattered points in the plane: nearest neighbours by cells of many sizes, and linear interpolation over their triangulation.

Space is a square per group, halved again and again. A place is looked up in the smallest cell around it that holds
enough points, and in the eight cells about that one; what is found is certain if it lies nearer than the edge of those
cells, else the cells twice as large are searched. No group is brought together anywhere.

The Delaunay triangle around a place is the face above it of the lower hull of the points lifted to a paraboloid, which
pivoting finds among any set of points that surrounds the place. It is the triangle of all points once its circle holds no
other point; the points nearest to the circle's centre say so, or are added to the set.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.lineage import cut

#: Halvings of the square at most; beyond them points are as good as equal.
DEEPEST = 26
#: Points that a first triangle is looked for among, and that a circle's centre is asked for.
AROUND, CENTRE = 24, 16


def _cell(x: Column, low: Column, side: Column, level: Column) -> Column:
    """The cell of a coordinate at a level; places outside belong to the outermost cells."""
    n = F.pow(F.lit(2.0), level)
    return F.least(F.greatest(F.floor((x - low) / side * n), F.lit(0).cast("long")), (n - 1).cast("long"))


@dataclass(frozen=True)
class Index:
    """Points (g, p, x, y, v) with their group's square, and how many points each cell of each size has."""

    box: DataFrame
    placed: DataFrame
    counts: DataFrame


def _cells(df: DataFrame) -> DataFrame:
    return df.withColumn("cx", _cell(F.col("x"), F.col("x0"), F.col("side"), F.col("level"))).withColumn("cy", _cell(F.col("y"), F.col("y0"), F.col("side"), F.col("level")))


def indexed(points: DataFrame) -> Index:
    """Points without coordinates are left out. Cells that hold one point are not counted."""
    placed = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    box = placed.groupBy("g").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-300)).alias("side"), F.count("*").alias("n"))
    box = cut(box)  # one row a group
    placed = cut(placed.join(box, "g").select("g", "p", "x", "y", "v", "x0", "y0", "side"))
    depth = min(DEEPEST, math.ceil(math.log2(box.agg(F.max("n")).first()[0] or 1)) + 2)
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    counts = _cells(placed.select("g", "x", "y", "x0", "y0", "side", level)).groupBy("g", "level", "cx", "cy").agg(F.count("*").alias("n")).where("n > 1")
    return Index(box.drop("n"), placed, cut(counts))


def nearest(points: DataFrame | Index, queries: DataFrame, k: int, other: bool = False, digits: int | None = None) -> DataFrame:
    """(g, q, near): for each query (g, q, x, y) its `k` nearest points (g, p, x, y, v) of the group, as an array of (gap, p, x, y, v).

    Gaps are squared distances, rounded to `digits` if given; equal ones are ordered by p. With `other` a point whose p is
    q does not count. Fewer points than `k` are all returned; a query of a group without points, or without coordinates,
    has no row.
    """
    index = points if isinstance(points, Index) else indexed(points)
    asked = queries.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select("g", "q", "x", "y").join(index.box, "g")
    depth = F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("level")
    enough = index.counts.where(F.col("n") > k)
    first = _cells(asked.select("*", depth)).join(enough, ["g", "level", "cx", "cy"]).groupBy("g", "q").agg(F.max("level").alias("level"))
    active = cut(asked.join(first, ["g", "q"], "left").withColumn("level", F.coalesce("level", F.lit(0))))
    out = None
    while levels := active.agg(F.collect_set("level")).first()[0]:  # DEEPEST + 1 at most
        there = _cells(index.placed.select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))).select("g", "level", "cx", "cy", "p", F.col("x").alias("px"), F.col("y").alias("py"), "v")
        mine = _cells(active)
        step = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
        about = mine.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
        about = about.select("g", "q", "x", "y", "level", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
        gap = F.pow(F.col("x") - F.col("px"), F.lit(2.0)) + F.pow(F.col("y") - F.col("py"), F.lit(2.0))
        gap = F.round(gap, digits) if digits is not None else gap
        met = about.join(there, ["g", "level", "cx", "cy"])
        met = (met.where(F.col("p") != F.col("q")) if other else met).withColumn("gap", gap)
        place = F.row_number().over(Window.partitionBy("g", "q").orderBy("gap", "p"))
        best = met.withColumn("place", place).where(F.col("place") <= k).groupBy("g", "q").agg(F.array_sort(F.collect_list(F.struct("gap", "p", F.col("px").alias("x"), F.col("py").alias("y"), "v"))).alias("near"))
        w = F.col("side") / F.pow(F.lit(2.0), F.col("level"))
        last = F.pow(F.lit(2.0), F.col("level")) - 1
        far = F.lit(math.inf)
        sides = []
        for c, low, at in (("x", "x0", "cx"), ("y", "y0", "cy")):
            sides.append(F.when(F.col(at) <= 1, far).otherwise(F.col(c) - F.col(low) - (F.col(at) - 1) * w))
            sides.append(F.when(F.col(at) + 1 >= last, far).otherwise(F.col(low) + (F.col(at) + 2) * w - F.col(c)))
        reach = F.greatest(F.least(*sides), F.lit(0.0))
        full = F.size("near") == k
        worst = F.element_at("near", -1)["gap"] + (0.0 if digits is None else 10.0**-digits)
        sure = (F.col("level") == 0) | (full & (worst + 1e-9 * w * w < reach * reach))
        # cells as wide as the last neighbour is far are certain to reach it
        wider = F.when(full, F.floor(F.log2(F.col("side") / F.sqrt(worst))).cast("int") - 1)
        seen = cut(mine.join(best, ["g", "q"], "left").withColumn("sure", F.coalesce(sure, F.lit(False))).withColumn("next", F.greatest(F.lit(0), F.least(F.col("level") - 1, wider))))
        found = seen.where("sure and near is not null").select("g", "q", "near")
        out = found if out is None else out.unionByName(found)
        active = seen.where("not sure").select("g", "q", "x", "y", "x0", "y0", "side", F.col("next").alias("level"))
    if out is None:
        return index.placed.limit(0).select("g", F.lit(None).cast(queries.schema["q"].dataType).alias("q"), F.array(F.struct(F.lit(0.0).alias("gap"), "p", "x", "y", "v")).alias("near"))
    return out


def hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Corners of the convex hull, counter-clockwise, without points on its edges."""
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    if len(order) < 3:
        return order

    def half(ids: list[int]) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) >= 2 and (x[out[-1]] - x[out[-2]]) * (y[i] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    low, high = half(order), half(order[::-1])
    return low[:-1] + high[:-1]


def _tilt(x: float, y: float) -> float:
    """A number in [0, 1) that only depends on a point; it decides between triangulations of points on one circle."""
    return zlib.crc32(np.array([x, y]).tobytes()) / 2**32


def triangle(px: float, py: float, x: np.ndarray, y: np.ndarray, tilt: float) -> tuple[list[int], np.ndarray] | None:
    """The Delaunay triangle around a place, and the place's barycentric coordinates; none outside the points' hull.

    `tilt` times a number of each point's own is added to its height, which makes the triangulation unique.
    """
    u, v = x - px, y - py
    height = u * u + v * v + tilt * np.array([_tilt(a, b) for a, b in zip(x, y, strict=True)])
    at = np.nonzero((u == 0) & (v == 0))[0]
    if len(at):
        return [int(at[0])] * 3, np.array([1.0, 0.0, 0.0])
    corners = hull(x, y)
    if len(corners) < 3:
        return None

    def solve(ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        m = np.array([u[ids], v[ids], np.ones(3)])
        return m, np.linalg.solve(m, np.array([0.0, 0.0, 1.0]))

    basis = None
    for i in range(1, len(corners) - 1):
        ids = [corners[0], corners[i], corners[i + 1]]
        m, part = solve(ids)
        if part.min() >= -1e-9:
            basis = ids
            break
    if basis is None:
        return None
    for _ in range(50 * len(x)):
        m, part = solve(basis)
        plane = np.linalg.solve(m.T, height[basis])
        under = height - (plane[0] * u + plane[1] * v + plane[2])
        under[basis] = 0
        new = int(under.argmin())
        if under[new] >= -1e-6 * tilt - 1e-13 * abs(height[basis]).max():
            break
        share = np.linalg.solve(m, np.array([u[new], v[new], 1.0]))
        ratio = np.where(share > 1e-12, np.maximum(part, 0.0) / np.where(share > 1e-12, share, 1.0), np.inf)
        basis[int(ratio.argmin())] = new
    _, part = solve(basis)
    part = np.maximum(part, 0.0)
    return basis, part / part.sum()


def circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Centre and squared radius of the circle through three points."""
    ax, ay, bx, by = x[1] - x[0], y[1] - y[0], x[2] - x[0], y[2] - y[0]
    d = 2 * (ax * by - ay * bx)
    a, b = ax * ax + ay * ay, bx * bx + by * by
    cx, cy = (by * a - ay * b) / d, (ax * b - bx * a) / d
    return x[0] + cx, y[0] + cy, cx * cx + cy * cy


POINT = "struct<x:double,y:double,v:double>"


def interpolated(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(g, q, v, how) of each query (g, q, x, y): linear over the Delaunay triangle of the points (g, x, y, v) around it, outside
    their hull the value of the nearest point (of equally near ones the leftmost, then the lowest).

    Points of one place count as their mean. Where points lie on one circle a number of each point's own decides how it
    is cut. A group of under three points, or of points on one line, has nearest values only. `how` tells which it was.
    """
    points = cut(points.where("x is not null and y is not null and v is not null").groupBy("g", "x", "y").agg(F.avg("v").alias("v")).withColumn("p", F.struct("x", "y")))
    queries = cut(queries.select("g", "q", "x", "y"))
    box = points.groupBy("g").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.nullif(F.max("x") - F.min("x"), F.lit(0.0)).alias("sx"), F.nullif(F.max("y") - F.min("y"), F.lit(0.0)).alias("sy"))
    box = cut(box)
    unit = lambda df: df.join(box, "g").withColumn("x", (F.col("x") - F.col("x0")) / F.coalesce("sx", F.lit(1.0))).withColumn("y", (F.col("y") - F.col("y0")) / F.coalesce("sy", F.lit(1.0)))
    index = indexed(points.withColumn("v", F.struct("x", "y", "v")))
    # nearest in a square of equal sides, so that points of several lines of a lattice are among them
    first = nearest(unit(points.withColumn("v", F.struct("x", "y", "v"))).select("g", "p", "x", "y", "v"), unit(queries), AROUND)

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, f in frame.groupby("g"):
                yield f.iloc[hull(f["x"].to_numpy(), f["y"].to_numpy())]

    kind = dict(points.dtypes)["g"]
    schema = f"g {kind}, x double, y double, v double"
    partial = points.select("g", "x", "y", "v").mapInPandas(corners, schema)
    hulls = cut(partial.groupBy("g").applyInPandas(lambda f: f.iloc[hull(f["x"].to_numpy(), f["y"].to_numpy())], schema).groupBy("g").agg(F.collect_list(F.struct("x", "y", "v")).alias("corners")))
    tilts = box.select("g", (F.lit(1e-10) * F.pow(F.greatest(F.coalesce("sx", F.lit(0.0)), F.coalesce("sy", F.lit(0.0))), F.lit(2.0))).alias("tilt"))
    sets = queries.join(first, ["g", "q"]).join(hulls, "g").join(tilts, "g").select("g", "q", "x", "y", "tilt", F.array_distinct(F.concat(F.transform("near", lambda n: n["v"]), "corners")).alias("around"))

    def located(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for px, py, tilt, around in zip(frame["x"], frame["y"], frame["tilt"], frame["around"], strict=True):
                x, y, v = (np.array([a[k] for a in around], dtype=float) for k in ("x", "y", "v"))
                got = triangle(px, py, x, y, tilt)
                if got is None:
                    out.append((None, None, None, None, "nearest", None))
                    continue
                ids, part = got
                value = float(part @ v[ids])
                if ids[0] == ids[1]:
                    out.append((value, None, None, None, "linear", None))
                else:
                    out.append((value, *circle(x[ids], y[ids]), "open", around))
            yield frame[["g", "q", "x", "y", "tilt"]].assign(**{k: pd.Series([o[i] for o in out], index=frame.index, dtype="float64" if i < 4 else None) for i, k in enumerate(("v", "cx", "cy", "r2", "how"))}, around=[o[5] for o in out])

    state = f"g {kind}, q {dict(queries.dtypes)['q']}, x double, y double, tilt double, v double, cx double, cy double, r2 double, how string, around array<{POINT}>"
    done: list[DataFrame] = []
    live = cut(sets.mapInPandas(located, state))
    outside = live.where("how = 'nearest'").select("g", "q", "x", "y")
    done.append(live.where("how = 'linear'").select("g", "q", "v", "how"))
    live = live.where("how = 'open'")
    while not live.isEmpty():
        near = nearest(index, live.select("g", "q", F.col("cx").alias("x"), F.col("cy").alias("y")), CENTRE)
        inside = F.transform(F.filter("near", lambda n: n["gap"] < F.col("r2") + 4 * F.col("tilt")), lambda n: n["v"])
        judged = cut(live.join(near, ["g", "q"]).withColumn("new", F.array_except(inside, F.col("around"))))
        done.append(judged.where(F.size("new") == 0).select("g", "q", "v", F.lit("linear").alias("how")))
        again = judged.where(F.size("new") > 0).select("g", "q", "x", "y", "tilt", F.concat("around", "new").alias("around"))
        # each round adds a point at least, so it ends when the circle holds none that is not among them
        live = cut(again.mapInPandas(located, state))
        done.append(live.where("how <> 'open'").select("g", "q", "v", "how"))
        live = live.where("how = 'open'")
    filled = nearest(index, outside, 1).select("g", "q", F.col("near")[0]["v"]["v"].alias("v"), F.lit("nearest").alias("how"))
    done.append(filled)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
