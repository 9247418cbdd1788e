"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on random lines. On each line every vector is the centre of a window of fixed width; a pair
collides on a line if one lies in the other's window. A pair at the threshold differs on a line by a normal amount of
known spread, so its number of collisions is binomial, and the count to pass is calibrated for the recall wanted. Pairs
that pass are verified by exact cosine.

So that not all vectors meet, each is put into one cell of every table: a table cuts space at the mean of several lines
of its own, jointly. The cells get smaller as the rows grow, and the number of tables, hence of copies of a vector, grows
with the logarithm of the rows only. In a cell vectors are sorted on a line and meet those in their windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, join_copies, table
from tidemark.llm.simhash import forest

#: Lines on which collisions are counted. The first is the one that a cell is sorted on; it must be one of them.
LINES = 24
#: Half the window's width, in standard deviations of a pair at the threshold; wider on the sorted line.
WIDTH, SORTED_WIDTH = 2.0, 5.0
#: Recall of a pair at the threshold, by the count and by the tables.
RECALL = 1 - 1e-5
#: Vectors that a cell has on average, and that one group compares; fuller cells are dealt out as a grid of groups.
CELL_ROWS, GROUP_ROWS = 4096, 8192
#: Tables at most; where the cuts would part near pairs so often that it takes more, cells are larger instead.
MOST_TABLES = 64
#: Vectors of a length on which the tables are calibrated, the first by hash of id; the index holds all.
SAMPLE = 2048
TILE = 512


def count_to_pass(recall: float = RECALL, lines: int = LINES - 1, width: float = WIDTH) -> int:
    """The largest number of collisions that a pair at the threshold reaches with probability `recall` at least."""
    hit = math.erf(width / math.sqrt(2))
    total = 0.0
    for k in range(lines + 1):  # misses
        total += math.comb(lines, k) * hit ** (lines - k) * (1 - hit) ** k
        if total >= recall:
            return lines - k
    return 0


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """`n` random directions as columns."""
    return np.random.default_rng([20240, dim, seed]).standard_normal((dim, n))


def plan_tables(n: int, apart: np.ndarray, recall: float = RECALL) -> tuple[int, int]:
    """(cuts of a table, tables) for n vectors; `apart` has, for sample vectors, how often a cut parts one from a partner at the threshold."""
    for cuts in range(max(0, math.ceil(math.log2(max(1, n) / CELL_ROWS))), 0, -1):
        missed = 1 - (1 - np.asarray(apart)) ** cuts
        tables = next((t for t in range(1, MOST_TABLES + 1) if (missed**t).mean() <= 1 - recall), None)
        if tables:
            return cuts, tables
    return 0, 1


def parted(sample: np.ndarray, mean: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector of a sample, how often cuts through `mean` part it from a vector at the threshold."""
    rng = np.random.default_rng(5)
    across = rng.standard_normal(sample.shape)
    across -= np.einsum("ij,ij->i", across, sample)[:, None] * sample
    across /= np.maximum(1e-300, np.sqrt(np.einsum("ij,ij->i", across, across)))[:, None]
    lines = directions(sample.shape[1], 256, -1 % 2**32)
    partner = cosine * sample + math.sqrt(max(0.0, 1 - cosine**2)) * across
    return (((sample - mean) @ lines > 0) != ((partner - mean) @ lines > 0)).mean(axis=1)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _scaled(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as doubles, each divided by its largest component, so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.abs(x).max(axis=1)[:, None]


def linked_pairs(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of unit rows of x and y with the cosine wanted, found by counted collisions; each pair once if both are one group."""
    spread, enough = math.sqrt(2 - 2 * cosine), count_to_pass()
    a = directions(x.shape[1], LINES, 0)
    px, py = x @ a, y @ a
    on_x, on_y = np.argsort(px[:, 0], kind="stable"), np.argsort(py[:, 0], kind="stable")
    sx, sy = px[on_x, 0], py[on_y, 0]
    lines_x, lines_y = px[on_x, 1:].T.astype(np.float32), py[on_y, 1:].T.astype(np.float32)
    for i0 in range(0, len(x), TILE):
        i1 = min(len(x), i0 + TILE)
        lo, hi = np.searchsorted(sy, [sx[i0] - SORTED_WIDTH * spread, sx[i1 - 1] + SORTED_WIDTH * spread], side="left")
        for j0 in range(max(lo, i0) if same else lo, hi, TILE):
            j1 = min(hi, j0 + TILE)
            hits = np.zeros((i1 - i0, j1 - j0), np.uint8)
            gap = np.empty(hits.shape, np.float32)
            for p, q in zip(lines_x[:, i0:i1], lines_y[:, j0:j1], strict=True):
                np.subtract(p[:, None], q[None, :], out=gap)
                np.abs(gap, out=gap)
                hits += gap <= WIDTH * spread
            i, j = np.nonzero(hits >= enough)
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            i, j = on_x[i], on_y[j]
            for at in range(0, len(i), 65_536):
                u, v = i[at : at + 65_536], j[at : at + 65_536]
                near = np.einsum("ij,ij->i", x[u], y[v]) >= cosine
                if near.any():
                    yield u[near], v[near]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) per row; rows link if their cosine is `cosine` or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with
    nothing: no links, themselves as component, kept. Vectors of different length do not link. Equal vectors are
    gathered before the search and count for one another; rows that repeat an id are rows of their own with one
    component. Ids must be numbers that fit in a long. An empty table gives no rows. Extra columns are left out.
    """
    element = df.schema[vector_col].dataType.elementType.simpleString()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    ok = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    distinct = table(rows.where(ok).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", F.size("v").alias("dim"), "v"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number and sum of the unit vectors of each length."""
        sums: dict[int, list] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                u = _units(_scaled(batch.column("v").take(pa.array(np.nonzero(dims == dim)[0])), dim))
                s = sums.setdefault(dim, [0, np.zeros(dim)])
                s[0] += len(u)
                s[1] += u.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tolist() for s in sums.values()], pa.list_(pa.float64()))], ["dim", "n", "total"])

    # one row for each task and length of vector: their sum is the mean, which the cuts go through
    totals: dict[int, list] = {}
    for r in distinct.select("dim", "v").mapInArrow(summed, "dim int, n bigint, total array<double>").collect():
        t = totals.setdefault(r["dim"], [0, np.zeros(r["dim"])])
        t[0] += r["n"]
        t[1] += np.array(r["total"])
    plans = {}
    for dim, (n, total) in totals.items():
        mean = total / n
        cuts, tables = 0, 1
        if n > CELL_ROWS:
            sample = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
            cuts, tables = plan_tables(n, parted(_units(_scaled(sample, dim)), mean, cosine))
        plans[dim] = mean, cuts, tables

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 2048) for k in range(0, len(whole), 2048)):
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    mean, cuts, tables = plans[dim]
                    mine = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                    u = _units(_scaled(mine.column("v"), dim))
                    codes = np.zeros((len(u), tables), np.int64)
                    for t in range(tables if cuts else 0):
                        codes[:, t] = ((u - mean) @ directions(dim, cuts, t + 1) > 0) @ (1 << np.arange(cuts, dtype=np.int64))
                    every = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([*mine.columns, every, pa.array(np.full(len(u), t, np.int32)), pa.array(codes[:, t])], [*mine.schema.names, "codes", "t", "cell"])

    fields = f"id bigint, copies bigint, dim int, v array<{element}>"
    each = distinct.mapInArrow(dealt, f"{fields}, codes array<bigint>, t int, cell bigint")
    full = table(each.groupBy("dim", "t", "cell").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("dim", "t", "cell", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("side")))
    # cells of over GROUP_ROWS rows: as few as rows / GROUP_ROWS for each table, far below what a broadcast bears up to 10^11 rows
    if not full.isEmpty():
        side = F.coalesce("side", F.lit(1))
        own = F.pmod(F.xxhash64("id"), side).cast("int")
        grid = F.flatten(F.transform(F.sequence(F.lit(0), side - 1), lambda k: F.array(F.struct(F.least(own, k).alias("g"), F.greatest(own, k).alias("h")))))
        each = each.join(F.broadcast(full), ["dim", "t", "cell"], "left").select(*each.columns, own.alias("own"), F.explode(grid).alias("x")).select(*each.columns, "x.g", "x.h", F.when(F.col("own") == F.col("x.g"), 0).otherwise(1).alias("part"))
    else:
        each = each.select("*", F.lit(0).alias("g"), F.lit(0).alias("h"), F.lit(0).alias("part"))

    def compared(group: pa.Table) -> pa.Table:
        dim, t, part = group["dim"][0].as_py(), group["t"][0].as_py(), group["part"].to_numpy()
        ids, copies, x = group["id"].to_numpy(), group["copies"].to_numpy(), _units(_scaled(group["v"].combine_chunks(), dim))
        codes = group["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        same = group["g"][0].as_py() == group["h"][0].as_py()
        left, right = np.nonzero(part == 0)[0], np.nonzero(part == (0 if same else 1))[0]
        links, kept_a, kept_b = np.zeros(len(ids), dtype=np.int64), [], []
        if len(left) and len(right):
            for i, j in linked_pairs(x[left], x[right], cosine, same):
                i, j = left[i], right[j]
                first = ~(codes[i, :t] == codes[j, :t]).any(axis=1)  # a pair counts in the first table where it meets
                i, j = i[first], j[first]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                if len(i):
                    a, b = forest(ids[i], ids[j])
                    kept_a.append(a), kept_b.append(b)
        found = np.nonzero(links)[0]
        a, b = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (kept_a, kept_b))
        if len(a):
            a, b = forest(a, b)
        nothing = pa.nulls(len(found), pa.int64())
        return pa.table({
            "id": pa.concat_arrays([pa.array(ids[found]), pa.array(a)]), "n": pa.concat_arrays([pa.array(links[found]), pa.array(np.zeros(len(a), np.int64))]),
            "other": pa.concat_arrays([nothing, pa.array(b)]),
        })

    found = table(each.groupBy("dim", "t", "cell", "g", "h").applyInArrow(compared, "id bigint, n bigint, other bigint"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("other is not null"), "id", "other")
    classes = distinct.select("id", "copies", "v").join(counts, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    classes = classes.select("v", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linkable = join_copies(rows.where(ok), classes, "v").select("id", "n_links", "component_id")
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linkable.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
