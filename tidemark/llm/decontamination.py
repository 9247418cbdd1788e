"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

DataFrame functions only. Documents are cut into segments; a segment without any shingle of the benchmark has nothing in
common with any item and is passed over. In the others every item size has its windows, and their SimHashes slide: the
shingles become running sums of bit counters, ten counters packed in a long, and a window's counters are the difference
of two sums. The index knows the items by blocks of their fingerprints; a window is looked up by its size and its own
blocks, without an item in mind. What it finds within the radius is checked exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints have 60 bits: six longs hold ten counters of six bits each, so a window has 63 shingles at most.
BITS, LANES, LANE_BITS, LONGEST = 60, 10, 6, 63
#: Four blocks of fifteen bits, each matched within three bits: every fingerprint within 15 bits is found.
BLOCKS, BLOCK_RADIUS = 4, 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Windows of a size begin every size / STEPS shingles.
STEPS = 8
#: Shingles that begin in one segment.
SEGMENT = 64
#: Rows of the benchmark's tables that are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of a text's k-word shingles in order; lower-cased, words end at ASCII space; fewer words: none."""
    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        last = F.size(w) - k
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


ONES = sum(1 << LANE_BITS * i for i in range(LANES))
#: Every other counter, with the room of its neighbour above it.
SPARSE = sum(1 << 2 * LANE_BITS * i for i in range(LANES // 2))


def running(hashes: Column, j: int) -> Column:
    """Running sums, from 0 on, of the counters of bits j, j + 6, ... of an array of hashes, modulo 2^60."""
    def step(a: Column, x: Column) -> Column:
        return F.array_append(a, (F.element_at(a, -1) + F.call_function("shiftrightunsigned", x, F.lit(j)).bitwiseAND(_long(ONES))).bitwiseAND(_long((1 << BITS) - 1)))

    return F.aggregate(hashes, F.array(_long(0)), step)


def fingerprint(sums: list[Column], n: Column) -> Column:
    """60-bit SimHash from a window's six counter longs and its number of shingles: a bit is 1 if set in over half."""
    wide = _long((1 << LANE_BITS) - 1) * _long(SPARSE)
    bias = (F.lit((1 << LANE_BITS) - 1) - F.floor(n / 2)).cast("long") * _long(SPARSE)
    out = _long(0)
    for j, s in enumerate(sums):
        for half in (0, LANE_BITS):
            over = F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", s, F.lit(half)).bitwiseAND(wide) + bias, F.lit(LANE_BITS)).bitwiseAND(_long(SPARSE))
            out = out.bitwiseOR(F.call_function("shiftleft", over, F.lit(j + half)))
    return out


def simhash(hashes: Column) -> Column:
    """60-bit SimHash of an array of at most 63 hashes, repeats as weight."""
    def total(h: Column, j: int) -> Column:
        return F.aggregate(h, _long(0), lambda a, x: a + F.call_function("shiftrightunsigned", x, F.lit(j)).bitwiseAND(_long(ONES)))

    return let(hashes, lambda h: fingerprint([total(h, j) for j in range(LANE_BITS)], F.size(h)))


def block_keys(fp: Column, size: Column) -> Column:
    """The (size, block, value) of a fingerprint, each as one long."""
    width = BITS // BLOCKS
    of = [F.call_function("shiftrightunsigned", fp, F.lit(b * width)).bitwiseAND(_long((1 << width) - 1)) for b in range(BLOCKS)]
    return F.array(*[(size.cast("long") * BLOCKS + b) * (1 << width) + v for b, v in enumerate(of)])


def overlap(a: str, b: str) -> Column:
    """Common shingles of two arrays, each as often as it occurs in both."""
    def count(xs: str, u: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == u))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, u: n + F.least(count(a, u), count(b, u)))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def candidates(rows: DataFrame, pieces: DataFrame, seeds: DataFrame, n_pieces: int, n_seeds: int) -> DataFrame:
    """(row, key, at): places of documents `rows` (row, hs) where an item may begin.

    `pieces` (piece, key, begin, size, own, fp) are items, long ones in pieces of LONGEST shingles at most, `seeds` (h)
    their shingles. A window that ends with the document counts with the shingles it has, if they are three quarters of
    its size.
    """
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # at most LONGEST of them
    windows = [(s, i) for s in sizes for i in range(0, SEGMENT, max(1, s // STEPS))]
    most = max(sizes, default=0)
    hits = rows.select("row", "hs", F.posexplode("hs").alias("at", "h")).join(_small(seeds, n_seeds), "h", "left_semi")
    # a window that holds the shingle begins in its segment or in one that a window reaches back to
    first, last = F.floor(F.greatest(F.col("at") - most + 1, F.lit(0)) / SEGMENT), F.floor(F.col("at") / SEGMENT)
    parts = hits.select("row", "hs", F.explode(F.sequence(first, last)).alias("part"))
    parts = parts.select("row", (F.col("part") * SEGMENT).cast("int").alias("base"), F.slice("hs", (F.col("part") * SEGMENT + 1).cast("int"), SEGMENT + most).alias("g")).groupBy("row", "base").agg(F.first("g").alias("g"))
    segments = table(parts)
    parts = segments.select("row", "base", F.size("g").alias("n"), *[running(F.col("g"), j).alias(f"p{j}") for j in range(LANE_BITS)])

    # in one lambda rather than in exploded rows: as one generated method it grows beyond what the JVM compiles
    def looked_at(w: Column) -> Column:
        def of(end: Column) -> Column:
            def moved(j: int) -> Column:
                return (F.get(f"p{j}", end) - F.get(f"p{j}", w["i"])).bitwiseAND(_long((1 << BITS) - 1))

            fp = let(F.array(*[moved(j) for j in range(LANE_BITS)]), lambda sums: fingerprint([F.get(sums, F.lit(j)) for j in range(LANE_BITS)], end - w["i"]))
            return F.struct(w["size"].alias("size"), w["i"].alias("i"), end.alias("end"), F.coalesce(fp, _long(0)).alias("fp"))

        return let(F.least(w["i"] + w["size"], F.col("n")), of)

    every = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(i).alias("i")) for s, i in windows]).cast("array<struct<size:int,i:int>>")
    whole = F.filter(every, lambda w: (F.least(w["i"] + w["size"], F.col("n")) - w["i"]) * 4 >= w["size"] * 3)
    # windows and what they are looked up by are narrow; a segment's shingles join what was found
    each = parts.select("row", "base", F.explode(F.transform(whole, looked_at)).alias("w")).select("row", "base", "w.*")
    each = each.select("*", F.explode(block_keys(F.col("fp"), F.col("size"))).alias("block"))

    width = BITS // BLOCKS
    near = F.array(*[_long(v) for v in range(1 << width) if v.bit_count() <= BLOCK_RADIUS])
    index = pieces.select("piece", F.col("fp").alias("item_fp"), F.explode(block_keys(F.col("fp"), F.col("size"))).alias("b"))
    index = index.select("piece", "item_fp", F.explode(near).alias("flip"), "b").select("piece", "item_fp", F.col("b").bitwiseXOR(F.col("flip")).alias("block"))
    n_index = n_pieces * BLOCKS * sum(v.bit_count() <= BLOCK_RADIUS for v in range(1 << width))
    met = each.join(_small(index, n_index), "block").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # fingerprints of unrelated texts come that close once in ten thousand: what shares few shingles goes before the shuffle
    met = met.select("row", "base", "i", "end", "piece").join(_small(pieces.select("piece", "key", "begin", "own"), n_pieces), "piece").join(segments, ["row", "base"])
    met = met.withColumn("win", F.slice("g", F.col("i") + 1, F.col("end") - F.col("i")))
    # counted as often as they occur; where the piece repeats none, that is the number of common ones
    common = F.when(F.size(F.array_distinct("own")) < F.size("own"), overlap("win", "own")).otherwise(F.size(F.array_intersect("win", "own")))
    met = met.where(common >= F.size("own") * 0.4)
    return met.select("row", "key", (F.col("base") + F.col("i") - F.col("begin")).alias("at")).distinct()


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, similarity, n_windows, first_word) for each document and benchmark item of which a window reaches `similarity`.

    A window has as many words as the item; its similarity is the weighted Jaccard similarity of 5-word shingles, with
    counts as weights. Candidates are places whose window of about the item's size has a SimHash within RADIUS of the
    item's; every window that begins within a quarter of the item's length of a candidate is checked exactly, and
    n_windows and first_word tell of those that pass. Null texts count as empty; documents and items of fewer than five
    words have no shingle and match nothing. Repeated rows give one result; of rows that share an id but not the text,
    any may match. An empty benchmark or an empty table gives no rows.
    """
    items = cut(benchmark.select(F.col(item_col).alias("item"), shingles(text_or_empty(item_text_col)).alias("own")).where(F.size("own") > 0).distinct())
    items = cut(items.select("item", F.xxhash64("item", "own").alias("key"), "own", F.size("own").alias("m")))
    n_shingles = items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    seeds = items.select(F.explode("own").alias("h")).distinct()
    length = F.ceil(F.col("m") / F.ceil(F.col("m") / LONGEST)).cast("int")
    pieces = items.select("key", "own", length.alias("length"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / length) - 1).cast("int"))).alias("p"))
    pieces = pieces.select("key", (F.col("p") * F.col("length")).alias("begin"), F.slice("own", F.col("p") * F.col("length") + 1, F.col("length")).alias("own"))
    pieces = cut(pieces.select(F.xxhash64("key", "begin").alias("piece"), "key", "begin", "own", F.size("own").alias("size"), simhash(F.col("own")).alias("fp")))

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("row"), text_or_empty(text_col).alias("text"))
    found = table(candidates(rows.select("row", shingles(F.col("text")).alias("hs")), pieces, seeds, pieces.count(), n_shingles))
    found = cut(found.groupBy("row", "key").agg(F.collect_set("at").alias("ats")))
    n_found = found.count()
    pairs = rows.join(_small(found, n_found), "row").select("id", "row", "key", "ats", shingles(F.col("text")).alias("hs"))
    pairs = pairs.join(_small(items.select("key", "item", "own", "m"), n_shingles), "key")
    reach = F.ceil(F.col("m") / 4).cast("int") + 1
    starts = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(F.greatest(a - reach, F.lit(0)), F.greatest(F.least(a + reach, F.size("hs") - 1), F.lit(0))))))
    each = pairs.withColumn("at", F.explode(starts)).select("id", "row", "item", "own", "m", "at", F.slice("hs", F.col("at") + 1, F.col("m")).alias("win"))
    # as many shingles of the item as a window that passes must have, before their counts are compared
    each = each.where(F.size(F.filter("win", lambda x: F.array_contains("own", x))) >= similarity / (1 + similarity) * (F.size("win") + F.col("m")) - 1e-9)
    each = each.withColumn("common", overlap("win", "own")).withColumn("similarity", F.col("common") / (F.size("win") + F.col("m") - F.col("common"))).where(F.col("similarity") >= similarity)
    out = each.groupBy("id", "item").agg(F.max("similarity").alias("similarity"), F.countDistinct("row", "at").alias("n_windows"), F.min("at").cast("long").alias("first_word"))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
