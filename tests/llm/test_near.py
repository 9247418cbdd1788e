import collections
import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows
from tidemark.llm import common, embedding, queries, simhash
from tidemark.llm.common import components


def groups(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_copies_are_joined_in_parts(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string")
    classes = df.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    least = {k: min(i for i, x in rows if x == k) for _, k in rows}
    for hot, bound in ((1000, 10), (20, 10), (20, -1)):
        monkeypatch.setattr(common, "HOT_COPIES", hot)
        monkeypatch.setattr(common, "BROADCAST_HOT", bound)
        got = sorted((r["id"], r["rep"]) for r in common.join_copies(df, classes, "key").collect())
        assert got == [(i, least[k]) for i, k in rows]


def test_links_of_vectors_against_sql(spark, sf):
    assert spark_rows(queries.QUERIES["op5_embedding_dedup"](spark, sf)) == duck_rows(sf, queries.ORACLES["op5_embedding_dedup"])


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    noise = [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    links = [*chain, *star, *noise, (5, 5), (5, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = groups({x for link in links for x in link}, links)
    assert got == {i: c for i, c in want.items() if any(i in (a, b) and a != b for a, b in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(1, 400))
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w).title() if rng.random() < 0.2 else " \n".join(w))
    return list(enumerate([*rows, None, "", "  ", "É a b", "é A B", rows[0], rows[0]], start=10))


def test_simhash_groups_against_all_pairs(spark, copies):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in copies], "doc_id long, text string, fp int, rep int")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fp = {i: plain_fingerprint(t) for i, t in copies}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert got == {i: (fp[i], want[i]) for i in fp}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "quite another text than that"), (2, "a b c d e"), (3, "quite another text than that"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).collect() if r["doc_id"]) == [(1, 1), (1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("radius", [4, 5, 6])
def test_anchors_meet_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in rng.choice(64, rng.integers(0, radius + 1), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    row, block, anchor, probe = simhash.anchors(x, radius)
    homes = {(r, b, a) for r, b, a, p in zip(row, block, anchor, probe, strict=True) if not p}
    row, block, anchor, probe = simhash.anchors(y, radius)
    met = {r for r, b, a, p in zip(row, block, anchor, probe, strict=True) if p and (r, b, a) in homes}
    assert met == set(range(len(x)))


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_HOMES", 8)
    rng = np.random.default_rng(7)
    fp = sorted({int(b) for b in (np.int64(1) << rng.integers(0, 20, 90)) ^ (np.int64(1) << rng.integers(0, 20, 90))})
    links = simhash.links_within(spark.createDataFrame(list(enumerate(fp)), "id long, fp long"), 4)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = groups(range(len(fp)), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    assert got == {i: c for i, c in want.items() if collections.Counter(want.values())[c] > 1}


def jaccard(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def test_verified_groups_against_all_pairs(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(df).collect()}
    text = dict(copies)
    near = [(a, b) for a in text for b in text if a < b and ((text[a] or "") == (text[b] or "") or jaccard(text[a], text[b]) >= 0.8)]
    want = groups(text, near)
    apart = {(a, b) for a, b in near if got[a] != got[b]}
    assert len(apart) <= 0.05 * len(near)  # fingerprints further than the radius
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is joined that shingles do not join


def kinds_of_copies(rng, words, vocabulary):
    n = len(words)
    cut_at = round(n * rng.choice([0.82, 0.86, 0.9, 0.95]))
    edited = list(words)
    for _ in range(rng.choice([1, 2, max(2, n // 60)])):
        edited[rng.randrange(n)] = rng.choice(vocabulary)
    more = rng.choices(vocabulary, k=round(n * rng.choice([0.05, 0.1, 0.15, 0.2])))
    return {"cut": words[:cut_at], "appended": words + more, "put before": more + words, "edited": edited}


def test_verified_groups_find_every_kind_of_copy(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(3000)]
    texts, pairs = [], collections.defaultdict(list)
    for _ in range(200):
        words = rng.choices(vocabulary, k=rng.choice([30, 80, 300, 900]))
        base = len(texts)
        texts.append(" ".join(words))
        for kind, copy in kinds_of_copies(rng, words, vocabulary).items():
            if jaccard(texts[base], " ".join(copy)) >= 0.8:
                pairs[kind].append((base, len(texts)))
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = {kind: sum(got[a] != got[b] for a, b in found) for kind, found in pairs.items()}
    assert all(len(found) > 80 for found in pairs.values())
    assert missed == dict.fromkeys(pairs, 0)
    assert len(set(got.values())) >= 200  # and the bases stay apart


def test_a_large_group_just_below_the_similarity(spark, monkeypatch):
    """Texts of which every two have similarity 0.78 or so: candidates all of them, none a link, and some true copies among them."""
    shared = [f"w{k}" for k in range(220)]
    texts = [" ".join([*shared, *(f"x{k}_{m}" for m in range(28))]) for k in range(600)]
    pairs = [(0, 600), (17, 601), (300, 602)]
    texts += [texts[a] + " more" for a, _ in pairs]
    assert 0.75 < jaccard(texts[0], texts[1]) < 0.8
    asked, plain = [], simhash._confirmed

    def counted(found, *rest):
        asked.append(found.count())
        return plain(found, *rest)

    monkeypatch.setattr(simhash, "_confirmed", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.verified_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(600)} | {b: a for a, b in pairs}
    assert sum(asked) <= 30 * len(texts)  # of some 180,000 pairs


def test_similarity_of_blocks_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sides = [[np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(rng.integers(1, 12))] for _ in range(2)]
        got = simhash.similar(*sides, 0.4)
        for i, x in enumerate(map(set, (a.tolist() for a in sides[0]))):
            for j, y in enumerate(map(set, (a.tolist() for a in sides[1]))):
                assert got[i, j] == (bool(x & y) and len(x & y) >= 0.4 * len(x | y))


def test_minwise_bits_differ_by_similarity():
    rng = random.Random(3)
    for size in (5, 40, 600):
        apart = []
        for _ in range(150):
            words = [str(rng.random()) for _ in range(size)]
            other = [str(rng.random()) for _ in range(size // 5)]
            (_, a), (_, b) = simhash.minwise(" ".join(words), 1), simhash.minwise(" ".join(words[: size - size // 5] + other), 1)
            apart.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
        similarity = (size - size // 5) / (size + size // 5)
        assert np.mean(apart) / 192 == pytest.approx((1 - similarity) / 2, rel=0.08)
    assert simhash.minwise(" \n", 5)[0] == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 32))
    rows = [(i, (np.float32(base[i % 30] + rng.standard_normal(32) * rng.choice([0, 0.05, 0.2, 0.32, 0.4])) * (3 if i % 7 == 0 else 1)).tolist()) for i in range(500)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2004, [None] * 32), (2005, [1.0] * 3), (2006, [2.0] * 3), (2007, [float("inf")] + [0.0] * 31)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df).collect()}
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1)).tolist()
    counts, part = collections.Counter(i for pair in near for i in pair), groups(range(500), near)
    assert {i: got[i] for i in range(500)} == {i: (counts[i], part[i], part[i] == i) for i in range(500)}
    assert [got[i] for i, _ in odd] == [*[(0, i, True) for i in range(2000, 2005)], (1, 2005, True), (1, 2005, False), (0, 2007, True)]
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    assert embedding.count_to_pass(0.999) >= embedding.count_to_pass()


@pytest.mark.parametrize("group_rows", [8192, 40])
def test_recall_of_pairs_at_the_threshold(spark, monkeypatch, group_rows):
    monkeypatch.setattr(embedding, "CELL_ROWS", 64)  # many cells and tables
    monkeypatch.setattr(embedding, "GROUP_ROWS", group_rows)  # cells dealt out as grids
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    across = rng.standard_normal((1500, 64))
    across -= (across * x).sum(axis=1)[:, None] * x
    across /= np.linalg.norm(across, axis=1)[:, None]
    cosine = rng.uniform(0.9501, 0.955, 1500)[:, None]
    x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * across])
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding.near_duplicates(df).collect()}
    counts = collections.Counter(near.ravel().tolist())
    assert len(near) >= 1500 and sum(got.values()) >= 0.999 * sum(counts.values())
    assert all(got[i] <= counts[i] for i in got)


def test_copies_of_a_vector_grow_slowly():
    apart = np.full(9, np.sqrt(0.1) / np.pi)
    copies = {n: embedding.plan_tables(n, apart)[1] for n in (10**5, 10**6, 10**7, 10**8)}
    assert copies[10**7] <= 2 * copies[10**6] and copies[10**8] <= embedding.MOST_TABLES
    assert embedding.plan_tables(10**7, np.full(9, 0.95)) == (0, 1)  # cuts that part most pairs: one cell, dealt out as a grid


def test_embeddings_in_one_cone(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CELL_ROWS", 32)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((300, 16)) + 0.3 * rng.standard_normal((300, 16)), rng.standard_normal((100, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    counts = collections.Counter(np.argwhere(np.triu(x @ x.T >= 0.95, 1)).ravel().tolist())
    got = {r["vec_id"]: r["n_links"] for r in embedding.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.999 * sum(counts.values()) and all(got[i] <= counts[i] for i in got)
