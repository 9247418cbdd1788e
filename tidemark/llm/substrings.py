"""Exact removal of repeated 200-byte strings by merged Burrows-Wheeler transforms.

Every 200-byte window is represented by an anchor inside it, the 32-byte string with the least hash: equal windows have
equal anchors at equal places. A window whose anchor occurs once in the corpus is settled before any transform is made.
The contexts of the other anchors are dealt out so that those of one anchor meet; there they form shards, each shard is
transformed, and the transforms are merged by interleave refinement (see `bwt`), whose blocks after 200 passes are the
repeated windows. All windows of a context hold its anchor, so what repeats in it is one interval. Anchors with very many
contexts are dealt out in chunks, and one window of each block of a chunk meets the other chunks, by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bwt
from tidemark.llm.common import join_copies, table, text_or_empty

LENGTH = 200
GRAM = 32
#: Contexts of one anchor that one group compares; fuller anchors are dealt out in chunks.
CHUNK = 2048
#: Text keys that are broadcast to pick out texts before their shuffle; beyond it the texts are shuffled first.
BROADCAST_KEYS = 500_000
#: Bytes that are hashed at a time.
SEGMENT = 4 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` bytes from each place on, by doubling."""
    out, done = None, 0
    step, n, p = BYTES[data], 1, ODD
    while True:
        if size & n:
            if out is None:
                out, done = step, n
            else:  # what is done, then this power of two
                m = len(data) - done - n + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:m] * p + step[done : done + m]
                done += n
        if done == size:
            break
        if len(step) <= n:
            return np.zeros(0, np.uint64)
        step = step[:-n] * p + step[n:]
        n, p = 2 * n, np.multiply(p, p, dtype=np.uint64)
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ out >> np.uint64(29)) * np.uint64(0xFF51AFD7ED558CCD)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes, the place of the least (of its upper forty bits; the leftmost of equal ones)."""
    m = h & np.uint64(0xFFFFFFFFFF000000) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    if width > n:
        m = np.minimum(m[: n - width], m[width - n :])
    return (m & np.uint64(0xFFFFFF)).astype(np.int64)


def _repeats_inside(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows that occur twice or more in these bytes, starts of the first of each window)."""
    h = grams(data, LENGTH)
    _, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return np.nonzero(counts[inverse] > 1)[0], first


def intervals(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows from sorted starts."""
    if not len(starts):
        return starts, starts
    gap = np.nonzero(np.diff(starts) > LENGTH)[0]
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + LENGTH


def anchors_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: anchors' places and hashes, and the intervals (lo, hi) that repeat inside the text itself.

    Of windows that occur more than once in a text only the first needs an anchor: the others are settled already.
    """
    none = np.zeros(0, np.int64)
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= SEGMENT):
            total += len(texts[upto])
            upto += 1
        if total > 1 << 23:  # a text too long for one segment: overlapping parts
            t = texts[at]
            data = np.frombuffer(t, np.uint8)
            places, hashes = [], []
            for lo in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
                part = data[lo : lo + SEGMENT + LENGTH - 1]
                h = grams(part, GRAM)
                p = np.unique(least_places(h, LENGTH - GRAM + 1))
                places.append(p + lo), hashes.append(h[p])
            p, h = np.concatenate(places), np.concatenate(hashes)
            p, i = np.unique(p, return_index=True)
            repeated, _ = _repeats_inside(data)
            yield p, h[i].view(np.int64), *intervals(repeated)
            at = upto
            continue
        data = np.frombuffer(b"".join(texts[at:upto]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[at:upto]])
        begins = ends - [len(t) for t in texts[at:upto]]
        if len(data) >= LENGTH:
            h = grams(data, GRAM)
            best = least_places(h, LENGTH - GRAM + 1)
        for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
            if hi - lo < LENGTH:
                yield none, none, none, none
                continue
            own = best[lo : hi - LENGTH + 1]
            p = own[np.concatenate([[0], np.nonzero(own[1:] != own[:-1])[0] + 1])]
            repeated = none
            if len(np.unique(h[p])) < len(p):
                repeated, first = _repeats_inside(data[lo:hi])
                if len(repeated):
                    p = np.unique(own[first])
            yield p - lo, h[p].view(np.int64), *intervals(repeated)
        at = upto


def _windows(contexts: list[bytes], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start in it, class) of every window of the contexts."""
    size = np.array([len(c) for c in contexts])
    n = size - depth + 1
    of = np.repeat(np.arange(len(contexts)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return of, inside, bwt.classes(contexts, depth)[np.repeat(np.cumsum(size + 1) - size - 1, n) + inside]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by (anchor, salt) -> intervals that repeat; for chunked anchors also one of each window."""
    names = ["key", "lo", "hi", "anchor", "bucket", "h", "owner", "start", "open"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, anchor, lo = t["key"].combine_chunks(), t["anchor"].to_numpy(), t["lo"].to_numpy()
        context = pa.compute.dictionary_encode(t["context"].combine_chunks())
        # equal contexts of an anchor are one for the search: all of their windows repeat
        both = np.stack([anchor, context.indices.to_numpy(zero_copy_only=False).astype(np.int64)])
        _, rep, like, times = np.unique(both, axis=1, return_index=True, return_inverse=True, return_counts=True)
        like = like.ravel()
        of, inside, same = _windows(context.take(pa.array(rep)).to_pylist())
        text = pa.compute.dictionary_encode(key).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        who = text[rep][of] << 40 | lo[rep][of] + inside
        order = np.lexsort((who, same))
        hs, ws = same[order], who[order]
        head = np.concatenate([[True], hs[1:] != hs[:-1]])
        begin = np.nonzero(head)[0]
        again = ws[begin] != ws[np.append(begin[1:], len(ws)) - 1]
        again |= np.maximum.reduceat(times[of[order]], begin) > 1
        found = np.zeros(len(of), bool)
        found[order] = again[np.cumsum(head) - 1]
        first, last = np.full(len(rep), np.iinfo(np.int64).max), np.full(len(rep), -1)
        np.minimum.at(first, of[found], inside[found])
        np.maximum.at(last, of[found], inside[found] + LENGTH)
        some = np.nonzero((last[like] >= 0) & (t["copies"].to_numpy() == 1))[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([key.take(pa.array(some)), pa.array(lo[some] + first[like[some]]), pa.array(lo[some] + last[like[some]]), *(pa.nulls(len(some), x) for x in types[3:])], names)
        chunks = t["chunks"].to_numpy()
        for a in np.unique(anchor[chunks > 1]):
            mine = order[anchor[rep[of[order]]] == a]
            mine = mine[np.diff(same[mine], prepend=-1) != 0]  # one of each window
            needed, at = np.unique(of[mine], return_inverse=True)
            h = [grams(np.frombuffer(c, np.uint8), LENGTH) for c in context.take(pa.array(rep[needed])).to_pylist()]
            h = np.array([h[k][i] for k, i in zip(at.tolist(), inside[mine].tolist(), strict=True)], np.uint64).view(np.int64)
            start, owner, is_open = lo[rep[of[mine]]] + inside[mine], key.take(pa.array(rep[of[mine]])), ~found[mine]
            # as many buckets as the anchor has chunks, so that a bucket of all chunks is no larger than a chunk
            bucket = (h.view(np.uint64) % np.uint64(chunks[anchor == a][0])).astype(np.int64)
            order_b = np.argsort(bucket, kind="stable")
            for w in np.split(order_b, np.nonzero(np.diff(bucket[order_b]))[0] + 1):
                row = [[None], [None], [None], [a], [int(bucket[w[0]])], [h[w]], [owner.take(pa.array(w)).to_pylist()], [start[w]], [is_open[w]]]
                yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(row, types, strict=True)], names)

    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) < 2 * CHUNK:
            continue
        t = pa.concat_tables(held)
        anchor, salt = t["anchor"].to_numpy(), t["salt"].to_numpy()
        cut = np.nonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))[0] + 1
        if len(cut):
            begin = 0
            for end in [*(c for i, c in enumerate(cut) if i + 1 == len(cut) or cut[i + 1] - begin > 2 * CHUNK)]:
                if end > begin and (end == cut[-1] or end - begin >= CHUNK):
                    yield from settle(t.slice(begin, end - begin))
                    begin = end
            held = [t.slice(begin)]
    if held and sum(map(len, held)):
        yield from settle(pa.concat_tables(held))


def _across(group: pa.Table) -> pa.Table:
    """Windows of one chunked anchor and bucket -> those left open in one chunk that another chunk has."""
    h = group["h"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    is_open = group["open"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    found = np.nonzero(is_open & (counts[inverse] > 1))[0]
    start = group["start"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[found]
    return pa.table({"key": group["owner"].combine_chunks().flatten().take(pa.array(found)).cast(pa.string()), "lo": pa.array(start), "hi": pa.array(start + LENGTH)})


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row: each byte of a 200-byte string that also starts
    anywhere else, in the same document or another, is removed.

    Null text counts as empty. Texts below 200 bytes keep all; texts that occur twice or more, and have 200 bytes,
    keep nothing. `chunk` is how many contexts of one anchor are compared at once. Repeated rows and ids give repeated
    results. Extra columns are left out. With `with_text`, `kept` has the remaining bytes. Windows of one chunk are
    compared byte by byte; those of different chunks of one anchor by a 64-bit hash, exact up to collisions.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("raw")).withColumn("key", F.sha2("raw", 256))
    base = rows.select("id", "key", F.octet_length("raw").cast("long").alias("n_bytes"))
    copies = table(base.groupBy("key").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(anchors_of(batch.column("raw").to_pylist()))
            cols = [pa.array([g[i] for g in got], pa.list_(pa.int64())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *cols], ["key", "place", "anchor", "lo", "hi"])

    long = rows.where(F.octet_length("raw") >= LENGTH)
    arrays = "place array<bigint>, anchor array<bigint>, lo array<bigint>, hi array<bigint>"
    found = long.select("key", "raw").mapInArrow(find, f"key string, {arrays}")
    found = table(found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("place", "anchor", "lo", "hi")]).join(copies.select("key", "copies"), "key"))
    each = found.select("key", "copies", F.explode(F.arrays_zip("place", "anchor")).alias("x")).select("key", "copies", "x.place", "x.anchor")
    again = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = table(each.join(again, "anchor").groupBy("key", "copies").agg(F.collect_list(F.struct("place", "anchor", "n")).alias("xs")))

    def texts(keys: DataFrame) -> DataFrame:
        """One raw text for each row of `keys`, joined by key."""
        n = keys.count()
        picked = long.select("key", "raw").join(F.broadcast(keys.select("key")) if n <= BROADCAST_KEYS else keys.select("key"), "key", "left_semi")
        return picked.dropDuplicates(["key"]).join(keys, "key")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("anchor", "chunks", "salt", "key", "copies", "lo", "context")}
            for key, raw, copied, xs in zip(*(batch.column(n).to_pylist() for n in ("key", "raw", "copies", "xs")), strict=True):
                mark = int(key[:8], 16)
                for x in xs:
                    lo, hi = max(0, x["place"] - LENGTH + GRAM), min(len(raw), x["place"] + LENGTH)
                    chunks = -(-x["n"] // chunk)
                    for name, v in (("anchor", x["anchor"]), ("chunks", chunks), ("salt", mark % chunks), ("key", key), ("copies", copied), ("lo", lo), ("context", raw[lo:hi])):
                        out[name].append(v)
            t = pa.table(out, schema=pa.schema([("anchor", pa.int64()), ("chunks", pa.int64()), ("salt", pa.int64()), ("key", pa.string()), ("copies", pa.int64()), ("lo", pa.int64()), ("context", pa.binary())]))
            yield from t.to_batches(max_chunksize=4096)

    dealt = texts(wanted).select("key", "raw", "copies", "xs").mapInArrow(contexts, "anchor bigint, chunks bigint, salt bigint, key string, copies bigint, lo bigint, context binary")
    fields = "key string, lo bigint, hi bigint, anchor bigint, bucket bigint, h array<bigint>, owner array<string>, start array<bigint>, open array<boolean>"
    compared = table(dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_compare, fields))
    across = compared.where("anchor is not null").groupBy("anchor", "bucket").applyInArrow(_across, "key string, lo bigint, hi bigint")
    inside = found.where("copies = 1").select("key", F.explode(F.arrays_zip("lo", "hi")).alias("x")).select("key", "x.lo", "x.hi")
    spans = table(compared.where("anchor is null").select("key", "lo", "hi").unionByName(across).unionByName(inside).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("xs")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digests, kept = [], [], [], []
            for raw, xs in zip(batch.column("raw").to_pylist(), batch.column("xs").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in xs):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                at, parts = 0, []
                for lo, hi in merged:
                    parts.append(raw[at:lo])
                    at = hi
                rest = b"".join([*parts, raw[at:]])
                removed.append(len(raw) - len(rest)), runs.append(len(merged)), kept.append(rest if with_text else None)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    stripped = texts(spans).select("key", "raw", "xs").mapInArrow(strip, "key string, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    result = copies.join(stripped, "key", "left").select(
        "key", "copies", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "key")).alias("kept_sha256"), F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    out = join_copies(base, result, "key").select(F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["key", "kept"] if with_text else []))
    if with_text:
        rest = rows.select("key", "raw").dropDuplicates(["key"])
        out = out.join(rest, "key").withColumn("kept", F.coalesce("kept", "raw")).drop("key", "raw")
    return out
