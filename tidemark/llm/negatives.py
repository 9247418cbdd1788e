"""Hard negatives by a pivot table.

A vector x of integers is augmented by sqrt(M - |x|^2), M the largest squared norm, an anchor q by zero, so that
|q - x|^2 = |q|^2 + M - 2 q.x and large inner products are small distances. For every row the distances to a few
pivots are stored; by the triangle inequality they bracket its distance to any anchor, hence its score. Rows lie in blocks
of one label that are sorted by nearest pivot and distance to it; a block keeps the least and largest distance to each
pivot, which bracket the scores of all its rows.

Anchors first meet the block they are nearest to, which gives a score that the fifth positive, or negative, reaches at
least; then all blocks whose bracket allows more. In a block only rows whose own bracket allows it are multiplied out.
Brackets only ever leave out what cannot count, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, join_copies, table

#: Pivots, and vectors of a length that they are chosen from, the first by hash of the vector; all rows are in the table.
PIVOTS, SAMPLE = 16, 2048
#: Rows of a block, blocks whose brackets one task compares with a pack of anchors, anchors of a pack.
BLOCK_ROWS, TILE_BLOCKS, PACK = 1024, 4096, 256
#: Packs that one task compares with a tile.
SHARE_PACKS = 64
#: Largest sum of products that doubles hold exactly, and that a long holds.
EXACT, LONGEST = 2**53, 2**63 - 1
SCALE = 256


def prepared(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v): rows that take part, each component x as floor(scale * x); components beyond 2^31 are refused."""
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))
    rows = df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("raw"))
    large = F.exists("raw", lambda x: F.abs(x.cast("double") * scale) >= 2**31)
    whole = F.transform("raw", lambda x: F.when(F.abs(x.cast("double") * scale) < 2**31, F.floor(x.cast("double") * scale)).cast("long"))
    return rows.select("id", "label", F.when(large, F.raise_error("a component is beyond 2^31").cast("array<bigint>")).otherwise(whole).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def choose_pivots(sample: np.ndarray, most: float, n: int = PIVOTS) -> np.ndarray:
    """Augmented pivots by farthest-first traversal of a sample, so that every cluster of the sample is near one."""
    full = augmented(sample, most)
    centre = full.mean(axis=0)
    apart = ((full - centre) ** 2).sum(axis=1)
    chosen: list[int] = []
    for _ in range(min(n, len(full))):
        k = int(apart.argmax())
        if chosen and apart[k] <= 0:
            break
        chosen.append(k)
        away = ((full - full[k]) ** 2).sum(axis=1)
        apart = away if len(chosen) == 1 else np.minimum(apart, away)
    return full[chosen]


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)))


def bracket(q: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score of anchors, by rows, with what has distances low..high to the pivots, by columns.

    Distances are widened by what doubles may round away.
    """
    slack = 1e-6 * (1 + math.sqrt(most))
    near, far = np.zeros((len(q), len(low))), np.full((len(q), len(low)), np.inf)
    for p in range(q.shape[1]):
        d = q[:, p, None]
        np.maximum(near, np.maximum(d - high[None, :, p], low[None, :, p] - d), out=near)
        np.minimum(far, d + high[None, :, p], out=far)
    near, far = np.maximum(0.0, near - slack), far + slack
    base = norms[:, None] + most
    room = 1e-9 * (base + 1)
    return (base - far**2) / 2 - room, (base - near**2) / 2 + room


def scores(q: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products; by doubles while they hold every partial sum, else by whole numbers."""
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most <= LONGEST:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    if exact.size and max(abs(int(exact.max())), abs(int(exact.min()))) > LONGEST:
        raise OverflowError("a score is beyond a long")
    return exact.astype(np.int64)


def _blocks(classes: DataFrame, plans: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """Rows packed into blocks of one length and label, nearest pivot and distance by distance."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                most, pivots = plans[dim]
                mine = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                d = distances(augmented(_matrix(mine.column("v"), dim), most), pivots)
                yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], [*mine.schema.names, "cell", "near"])

    order = ["dim", "label", "cell", "near", "first"]
    spread = classes.mapInArrow(placed, "dim int, label bigint, first bigint, ids array<bigint>, v array<bigint>, cell int, near double")
    spread = spread.repartitionByRange(*order).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            dim, label = rows["dim"][0].as_py(), rows["label"][0].as_py()
            most, pivots = plans[dim]
            x = _matrix(rows["v"].combine_chunks(), dim)
            d = distances(augmented(x, most), pivots)
            ids = rows["ids"].combine_chunks()
            return pa.RecordBatch.from_pylist([{
                "dim": dim, "label": label, "n": len(x), "v": x.astype(np.int32).tobytes(), "far": d.tobytes(), "ids": ids.flatten().to_pylist(), "ends": ids.value_lengths().to_pylist(),
                "low": d.min(axis=0).tolist(), "high": d.max(axis=0).tolist(),
            }], BLOCK)

        def settled(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            rows = pa.Table.from_batches(waiting)
            key = np.stack([rows[k].to_numpy().astype(np.int64) for k in ("dim", "label", "cell")])
            cuts = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while b - a >= BLOCK_ROWS or (a < b and (final or b < len(rows))):
                    yield block(rows.slice(a, min(BLOCK_ROWS, b - a)))
                    a += min(BLOCK_ROWS, b - a)
            waiting = rows.slice(a).combine_chunks().to_batches()

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= 4 * BLOCK_ROWS:
                yield from settled(False)
        if sum(map(len, waiting)):
            yield from settled(True)

    made = spread.mapInArrow(packed, "dim int, label bigint, n int, v binary, far binary, ids array<bigint>, ends array<int>, low array<double>, high array<double>")
    return table(made.withColumn("block", F.monotonically_increasing_id()))


BLOCK = pa.schema([("dim", pa.int32()), ("label", pa.int64()), ("n", pa.int32()), ("v", pa.binary()), ("far", pa.binary()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def _parts(rows: DataFrame, of: int, name: str) -> DataFrame:
    """(dim, name): in how many parts of about `of` rows each length of vector is dealt out; one row a length."""
    return cut(rows.groupBy("dim").agg(F.ceil(F.count("*") / of).cast("int").alias(name)))


def _tiles(summaries: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Brackets of blocks in rows of about TILE_BLOCKS, of one length of vector each and repeated for each share of the packs."""
    parts = _parts(summaries, TILE_BLOCKS, "tiles").join(_parts(queries, PACK * SHARE_PACKS, "shares"), "dim")
    parts = cut(parts)
    tile = F.pmod(F.xxhash64("block"), F.col("tiles")).cast("int").alias("tile")
    packed = summaries.join(F.broadcast(parts), "dim").select("dim", tile, "shares", F.struct("block", "label", "low", "high").alias("b")).groupBy("dim", "tile", "shares").agg(F.collect_list("b").alias("blocks"))
    return packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares"), parts


def _meet(asked: DataFrame, tiles: DataFrame, parts: DataFrame, plans: dict, same: bool, nearest: bool) -> DataFrame:
    """(block, dim, query): blocks that a query must see.

    With `nearest` the one with the largest best score, of the query's label if `same`, else of another; without, all
    whose bracket reaches the query's `least`, and for other labels does not lie above its `largest`.
    """
    packs = asked.select("dim", "query", "label", "v", "least", "largest").mapInArrow(lambda batches: _packs(batches, plans), "dim int, queries array<bigint>, labels array<bigint>, q array<double>, norms array<double>, least array<bigint>, largest array<bigint>")
    # the stated queries against brackets of blocks of all rows: every pack meets every tile of its length, in shares
    packs = packs.join(F.broadcast(parts), "dim").withColumn("share", F.pmod(F.xxhash64(F.col("queries")[0]), F.col("shares")).cast("int"))
    met = packs.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles", "shares").join(tiles, ["dim", "tile", "share"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda k: batch.column(k)[row].values  # noqa: B023, E731
                dim = batch.column("dim")[row].as_py()
                most, pivots = plans[dim]
                queries, labels, least, largest = (get(k).to_numpy() for k in ("queries", "labels", "least", "largest"))
                blocks = get("blocks")
                low, high = (blocks.field(k).flatten().to_numpy().reshape(-1, len(pivots)) for k in ("low", "high"))
                down, up = bracket(get("q").to_numpy().reshape(len(queries), -1), get("norms").to_numpy(), low, high, most)
                alike = labels[:, None] == blocks.field("label").to_numpy()[None, :]
                fits = alike if same else ~alike
                if nearest:
                    best = np.where(fits, up, -np.inf)
                    i = np.nonzero(fits.any(axis=1))[0]
                    j = best[i].argmax(axis=1)
                    value = best[i, j]
                else:
                    i, j = np.nonzero(fits & (up >= least[:, None]) & (down <= largest[:, None]))
                    value = up[i, j]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(queries[i]), blocks.field("block").take(pa.array(j)), pa.array(value)], ["dim", "query", "block", "best"])

    pairs = met.mapInArrow(seen, "dim int, query bigint, block bigint, best double")
    if nearest:
        pairs = pairs.groupBy("query").agg(F.max_by(F.struct("dim", "block"), F.struct("best", "block")).alias("x")).select("query", "x.dim", "x.block")
    return pairs.select("dim", "query", "block")


def _packs(batches: Iterator[pa.RecordBatch], plans: dict) -> Iterator[pa.RecordBatch]:
    """Queries of one length with their distances to the pivots, PACK at most in a row."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            _, pivots = plans[dim]
            mine = np.nonzero(dims == dim)[0]
            for k in range(0, len(mine), PACK):
                part = batch.take(pa.array(mine[k : k + PACK]))
                q = np.hstack([_matrix(part.column("v"), dim).astype(np.float64), np.zeros((len(part), 1))])
                lists = [part.column("query").to_pylist(), part.column("label").to_pylist(), distances(q, pivots).ravel().tolist(), (q * q).sum(axis=1).tolist(), part.column("least").to_pylist(), part.column("largest").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.list_(t)) for x, t in zip(lists, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True))], ["dim", "queries", "labels", "q", "norms", "least", "largest"])


def _compared(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, plans: dict, keep: int, levels: bool) -> DataFrame:
    """(query, level, score, id): the first `keep` rows of each block that each of its queries meets.

    Without `levels` the best of all scores from `least` on, at level 0; with them, for each of the query's `levels`, the
    best from four fifths of it up to it. Queries of a block come in packs, so a block that all of them meet is dealt out.
    """
    pairs = table(pairs)
    counts = pairs.groupBy("block").agg(F.ceil(F.count("*") / PACK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part")
    wanted = pairs.join(counts, "block").select("block", "query", part).join(asked.select("query", "v", "least", "levels"), "query")
    packs = wanted.groupBy("block", "part").agg(F.collect_list(F.struct("query", "least", "levels", "v")).alias("asked"))
    met = packs.join(blocks.select("block", "dim", "n", "v", "far", "ids", "ends"), "block")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in range(len(batch)):
                dim, n = batch.column("dim")[row].as_py(), batch.column("n")[row].as_py()
                most, pivots = plans[dim]
                x = np.frombuffer(batch.column("v")[row].as_py(), np.int32).reshape(n, dim).astype(np.int64)
                far = np.frombuffer(batch.column("far")[row].as_py()).reshape(n, -1)
                ids, ends = batch.column("ids")[row].values.to_numpy(), np.cumsum(batch.column("ends")[row].values.to_numpy())
                begins = np.concatenate([[0], ends[:-1]])
                queries = batch.column("asked")[row].values
                q, least = _matrix(queries.field("v"), dim), queries.field("least").to_numpy()
                spans = queries.field("levels").to_pylist()
                full = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
                down, up = bracket(distances(full, pivots), (full * full).sum(axis=1), far, far, most)
                for k, query in enumerate(queries.field("query").to_pylist()):
                    alive = up[k] >= least[k]
                    if levels:
                        alive &= down[k] <= max(spans[k])
                    alive = np.nonzero(alive)[0]
                    if not len(alive):
                        continue
                    s = scores(q[k : k + 1], x[alive], int(most))[0]
                    for level in spans[k] if levels else [None]:
                        fits = np.nonzero((s >= -(-4 * level // 5)) & (s <= level))[0] if levels else np.nonzero(s >= least[k])[0]
                        if not len(fits):
                            continue
                        if len(fits) > keep:  # the best classes, with all that tie with the last of them
                            fits = fits[s[fits] >= np.partition(s[fits], len(fits) - keep)[len(fits) - keep]]
                        one = sorted((-int(s[j]), int(y)) for j in fits for y in ids[begins[alive[j]] : ends[alive[j]]])[:keep]
                        for a, y in one:
                            for into, value in zip(out, (query, level or 0, -a, y), strict=True):
                                into.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["query", "level", "score", "id"])

    rows = met.mapInArrow(found, "query bigint, level bigint, score bigint, id bigint")
    return _best(rows, keep)


def _best(rows: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query", "level").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(df: DataFrame, anchors: str, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows whose `id` meets the SQL condition `anchors`.

    An anchor's positives are its first `positives` other rows of its label; of the rows of other labels with four fifths
    of the positive's score up to all of it the first `negatives` are returned. Order is by integer inner product, highest
    first, then by id. Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows
    that repeat id, label and vector count once; a row of the anchor's id with another label or vector is another row. Vectors of different length do not meet; empty ones score 0. Components beyond 2^31 after scaling, and scores
    beyond a long, raise an error. An empty table gives no rows. Extra columns are left out.

    Equal vectors of a label are one class, which keeps its smallest ids only, one more than asked for; copies thus cost one row.
    """
    rows = table(prepared(df, id_col, label_col, vector_col, scale).dropDuplicates())
    keep = max(positives, negatives) + 1
    order = Window.partitionBy("label", "v").orderBy("id")
    least_ids = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep)
    classes = least_ids.groupBy("label", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = table(classes.select(F.size("v").alias("dim"), "label", F.col("ids")[0].alias("first"), "ids", "v"))
    square = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    plans: dict[int, tuple[int, np.ndarray]] = {}
    for r in classes.groupBy("dim").agg(F.max(square).alias("most")).collect():  # one row a length of vector
        sample = classes.where(F.col("dim") == r["dim"]).select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()["v"].combine_chunks()
        most = float(math.ceil(r["most"] * (1 + 1e-12)))
        plans[r["dim"]] = most, choose_pivots(_matrix(sample, r["dim"]), most)
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not plans:
        return df.sparkSession.createDataFrame([], out)
    blocks = _blocks(classes, plans)
    # anchors with one label and vector are one query
    mine_rows = rows.where(f"({anchors})")
    grouped = table(mine_rows.groupBy("label", "v").agg(F.count("*").alias("copies")).select(F.size("v").alias("dim"), "label", "v", "copies", F.monotonically_increasing_id().alias("query")))
    tiles, parts = _tiles(blocks.select("dim", "block", "label", "low", "high"), grouped)
    tiles = table(tiles)
    floor, none = F.lit(-(2**62)).alias("least"), F.array(F.lit(0).cast("long")).alias("levels")
    top = F.lit(2**62).alias("largest")
    asked = table(grouped.select("dim", "query", "label", "v", floor, top, none))
    more = positives + 1  # one of them may be the anchor itself

    first = _compared(_meet(asked, tiles, parts, plans, True, True), asked, blocks, plans, more, False)
    known = first.where(F.col("rank") == more).select("query", F.col("score").alias("known"))  # the true one is no lower
    asked = table(asked.drop("least").join(known, "query", "left").withColumn("least", F.coalesce("known", F.lit(-(2**62)))).drop("known"))
    best = table(_compared(_meet(asked, tiles, parts, plans, True, False), asked, blocks, plans, more, False))
    # each anchor's own list: the class's best without itself
    members = join_copies(mine_rows.select("id", "label", "v").withColumn("key", F.xxhash64("label", "v")), grouped.select(F.xxhash64("label", "v").alias("key"), F.col("v").alias("w"), F.col("label").alias("l"), "query", "copies"), "key").where("v = w and label = l").select("id", "query", "label", "v")
    members = table(members.withColumn("own", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)))
    heads = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"), F.count("*").alias("c"))
    sizes = members.groupBy("query").agg(F.count("*").alias("copies"))
    listed = join_copies(members, heads.join(sizes, "query").select("query", "best", "copies"), "query")
    others = F.slice(F.filter("best", lambda x: (x["id"] != F.col("id")) | (-x["s"] != F.col("own"))), 1, positives)
    pairs = table(listed.select(F.col("id").alias("anchor_id"), "query", F.explode(others).alias("p")).select("anchor_id", "query", F.col("p.id").alias("positive_id"), (-F.col("p.s")).alias("level")))

    wanted = pairs.where("level >= 0").groupBy("query").agg(F.collect_set("level").alias("levels"))  # at most positives + 1 scores
    fifth = F.expr("array_min(levels) div 5 * 4")
    asked = table(asked.select("dim", "query", "label", "v").join(wanted, "query").select("*", fifth.alias("least"), F.array_max("levels").alias("largest")))
    found = table(_compared(_meet(asked, tiles, parts, plans, False, False), asked, blocks, plans, negatives, True))
    listed = found.groupBy("query", "level").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
    sizes = pairs.groupBy("query", "level").agg(F.count("*").alias("copies"))
    keyed = listed.join(sizes, ["query", "level"]).select(F.struct("query", "level").alias("key"), "found", "copies")
    result = join_copies(pairs.withColumn("key", F.struct("query", "level")), keyed, "key")
    result = result.select("anchor_id", "positive_id", "level", F.explode("found").alias("n"))
    return result.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("level").alias("positive_score"), F.col("n.score").alias("negative_score"))
