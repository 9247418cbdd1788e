"""Hard negatives, WARC archives and the trie of conversations, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows
from tidemark.llm import common, negatives, trie, warc
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc", "op13_prefix_trie"])
def test_queries_match_sql(spark, sf, name):
    names, rows = spark_rows(QUERIES[name](spark, sf))
    assert (names, rows) == duck_rows(sf, ORACLES[name])


# hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives_=5):
    ok = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in ok:
        if not is_anchor(a[0]):
            continue
        others = [(-sum(p * q for p, q in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in ok if r != a and len(r[2]) == len(a[2])]
        for s, p, _ in sorted(o for o in others if o[2] == a[1])[:positives]:
            found = sorted(o[:2] for o in others if o[2] != a[1] and 80 * -s <= 100 * -o[0] <= 100 * -s)[:negatives_]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n) in enumerate(found)]
    return sorted(out)


def vectors(rng):
    rows = []
    centres = rng.standard_normal((4, 6))
    for i in range(420):
        y = int(rng.integers(0, 4))
        v = centres[int(rng.integers(0, 4))] * 0.3 + rng.standard_normal(6) * 0.1
        rows.append((i, y, [float(x) for x in v]))
    rows += [(1000 + k, 1, rows[5][2]) for k in range(60)]  # copies with one label, more than a class keeps
    rows += [(1100 + k, k % 4, rows[7][2]) for k in range(20)]  # and with all of them
    rows += [(2000, 0, rows[5][2]), (2100, 0, rows[5][2])]  # anchors that are copies
    rows += [(2200, 2, [0.0] * 6), (2300, 2, [-x for x in rows[9][2]]), (2201, 2, [0.001] * 6)]  # scores of zero and below
    rows += [(2400, None, rows[0][2]), (2500, 1, None), (None, 1, rows[0][2]), (2600, 1, [float("nan"), *rows[0][2][1:]]), (2700, 1, [None, *rows[0][2][1:]]), (2800, 1, [math.inf, *rows[0][2][1:]])]
    rows += [(3000 + k, k % 2, [0.5 * k, 0.25]) for k in range(12)] + [(3100, 0, []), (3101, 0, []), (3102, 1, [])]  # other lengths
    rows += [rows[0], rows[100], (100, 3, rows[100][2]), (100, rows[100][1], rows[101][2])]  # repeated rows and ids
    return rows


@pytest.mark.parametrize("blocks", [(1024, 4096, 256, 1000), (16, 8, 4, 3)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "TILE_BLOCKS", "PACK"), blocks, strict=False):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(common, "HOT_COPIES", blocks[3])
    rows = vectors(np.random.default_rng(blocks[0]))
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, query string, rank int")
    got = negatives.mine(df, "id % 100 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 100 == 0)


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], schema), "id % 100 = 0").count() == 0
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.5, 0.5]), (2, 2, [0.45, 0.9]), (100, 3, [1.0, 1.0])]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, schema), "id % 100 = 0").collect())) == brute_negatives(rows, lambda i: i % 100 == 0)
    big = [(0, 1, [3e6, 1.0]), (1, 1, [8e6, 1.0]), (2, 2, [7e6, -5e6]), (3, 2, [6.9e6, 0.0])]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(big, "vec_id long, label int, embedding array<double>"), "id = 0").collect())) == brute_negatives(big, lambda i: i == 0)
    with pytest.raises(Exception, match="beyond"):
        negatives.mine(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>"), "id = 0").collect()


def test_brackets_hold_every_score():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, (400, 8)), rng.integers(-300, 300, (50, 8))
    most = float(max((x * x).sum(axis=1).max(), (q * q).sum(axis=1).max()))
    pivots = negatives.choose_pivots(x[:100], most)
    far = negatives.distances(negatives.augmented(x, most), pivots)
    flat = np.hstack([q, np.zeros((50, 1))])
    down, up = negatives.bracket(negatives.distances(flat, pivots), (q * q).sum(axis=1).astype(float), far, far, most)
    s = negatives.scores(q, x, int(most))
    assert (s == q @ x.T).all() and (down <= s).all() and (s <= up).all()
    assert (up - down < 4 * most).all() and len(pivots) == negatives.PIVOTS


# archives

MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages(rng):
    long = "<p>" + "many words " * 400
    rows = [(i, f"http://x/{i}", rng.choice(["", "short", "<p>ünï — 語</p>" * rng.randrange(1, 90), long + str(i % 7)])) for i in range(60)]
    rows += [(100, "http://a", MAGIC), (101, "http://b", "x" * 1500 + MAGIC * 3), (102, None, MAGIC * 40), (103, "http://c\r\nWARC-Type: evil", "WARC/1.0\r\nContent-Length: 99999\r\n\r\n" + "y" * 999)]
    rows += [(104, "u", "WARC/1."), (105, "u", "a WARC/1.1\r\n b WARC/1.1\r\nContent-Length: -3\r\n\r\n"), (106, "u", "\r\n\r\n" * 300), (107, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")]
    rows += [(108, "u", None), (None, "u", long), (None, "u", long), (109, "u", "z" * 999), (110, "u", "z" * 999), (111, "u", "z" * 1000), (112, "u", "z" * 1000)]
    rows += [(113, "u", "same" * 400)] * 3 + [(90, "u", "same" * 400)] * 2 + [(114, "u", MAGIC * 30), (115, "u", MAGIC * 30)]
    rng.shuffle(rows)
    return rows


def brute_archive(rows):
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 1000:
            groups[raw].append(i)
    out, kept = [], set()
    for i, _, h in rows:
        raw = (h or "").encode()
        last = max(groups[raw]) if i is not None and len(raw) >= 1000 else None
        first = last is None or i == last and raw not in kept
        if first and last is not None:
            kept.add(raw)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first else last))
    return collections.Counter(out)


@pytest.mark.parametrize("block", ["200b", "3000b", "128m"])
def test_archives_come_back(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "CELL", 256 if block == "200b" else 1 << 16)
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", -1 if block == "200b" else 500_000)
    rows = pages(random.Random(5))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, file int, digest string").repartition(3)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert collections.Counter(map(tuple, warc.round_trip(df).collect())) == brute_archive(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def test_archives_of_others_are_read(spark, tmp_path):
    def record(kind, block, version="1.0", more=""):
        return f"WARC/{version}\r\nWARC-Type: {kind}\r\nwarc-record-id: <urn:{len(block)}>\r\n{more}Content-length:   {len(block.encode())} \r\n\r\n{block}\r\n\r\n"

    whole = record("warcinfo", "software: x\r\n") + record("resource", MAGIC * 2, more="WARC-Target-URI: http://r\r\n") + record("response", "HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\ntail", "1.1", "Content-Type: application/http; msgtype=response\r\n")
    (tmp_path / "a.warc").write_bytes(whole.encode())
    (tmp_path / "b.warc").write_bytes((record("resource", "é" * 9) + record("resource", "cut off")[:-9]).encode())  # ends inside a record
    (tmp_path / "c.warc").write_bytes(b"no archive, but WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [(r["type"], bytes(r["payload"]).decode(), r["uri"]) for r in got] == [("warcinfo", "software: x\r\n", None), ("resource", MAGIC * 2, "http://r"), ("response", "body\r\n\r\ntail", None), ("resource", "é" * 9, None)]
    assert [r["offset"] for r in got if r["file"].endswith("a.warc")] == [whole.index(f"WARC/1.{k}\r\nWARC-Type: {t}") for k, t in ((0, "warcinfo"), (0, "resource"))] + [whole.index("WARC/1.1\r\nWARC-Type: response\r\nwarc-record")]
    assert all(r["sha1"] == hashlib.sha1(bytes(r["payload"])).hexdigest() and r["n_bytes"] == len(r["payload"]) for r in got)


def test_archive_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# conversations


def brute_trie(rows, rebuild=True):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], (role, text)))
    turns = {c: [t for *_, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    out = []
    for path, own_members in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        listed = ",".join(map(str, sorted(ends[path]))) if path in ends else ""
        out.append((min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members), len(children), leaves, saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(rng):
    say = [("user", "hello"), ("assistant", "hi there"), ("user", None), (None, "語" * 3), ("", "x"), ("us", "erhello")]
    rows = []
    for c in [*range(0, 40), *range(95, 112), 200, 300, 305, 707]:
        for k in range(rng.randrange(0, 7) if c % 100 else rng.randrange(2, 7)):
            rows.append((c, k, *rng.choice(say[: rng.choice([2, 6])])))
    rows += [(20, None, "user", "before all"), (20, None, "user", "before all"), (21, 3, "user", "a"), (21, 3, "user", "b"), (21, 3, "user", "b")]  # null turns, ties, repeats
    rows += [(800, 0, "user", "hello"), (801, 0, "user", "own only")]
    rows += [(900 + c, k, "user", f"turn {k}") for c in range(30) for k in range(c)]  # each the next one's beginning
    rows += [(None, 0, "user", "nobody's"), (950, 1, "user", "hello")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("split", [True, False])
def test_trie_against_all_prefixes(spark, monkeypatch, split):
    monkeypatch.setattr(trie, "SEGMENT", 3 if split else 65_536)
    monkeypatch.setattr(trie, "BLOCK", 4 if split else 1024)
    monkeypatch.setattr(common, "HOT_COPIES", 5 if split else 1000)
    rows = talks(random.Random(1))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not split).lower())  # conversations lie across partitions
    try:
        got = trie.shared_trie(df).collect()
        assert sorted(map(tuple, got), key=str) == brute_trie(rows)
        plain = trie.trie(*trie.whole(trie.light(df))).collect()
        assert sorted(map(tuple, plain), key=str) == brute_trie(rows, rebuild=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_one_long_conversation(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("text")).repartition(6)
    df = df.unionByName(df.where("turn < 1500").withColumn("conv_id", F.lit(9).cast("long")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["depth"]: r for r in trie.trie(*trie.whole(trie.light(df))).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3001 and all(r["conv_id"] == 7 and r["n_leaves"] == 1 and r["n_convs"] == (2 if d <= 1500 else 1) for d, r in got.items())
    assert got[0]["saved_tokens"] == 3000 and got[1400]["saved_tokens"] == 202 and got[1501]["saved_tokens"] == 0
    assert got[1500]["ends_sha256"] == hashlib.sha256(b"9").hexdigest()


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.shared_trie(empty).count() == 0
    only = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert trie.shared_trie(only).count() == 0
