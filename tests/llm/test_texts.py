import collections
import hashlib
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bwt, common, decontamination, html_extract, pii, quality, substrings
from tidemark.llm.queries import QUERIES


def brute_repeats(texts):
    seen = collections.Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest(), rest))
    return out


@pytest.mark.parametrize("depth", [1, 2, 7, 20, 60])
@pytest.mark.parametrize("shard", [50, 1 << 18])
def test_merged_transforms_against_substrings(depth, shard):
    rng = random.Random(depth)
    for n in (1, 2, 3, 40):
        texts = [bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(0, 60))) for _ in range(n)] + [b"ab" * 50, b"b" + b"ab" * 40]
        texts += texts[:2]
        found = bwt.classes(texts, depth, shard)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        places = [(t[i : i + depth], int(found[b + i])) for t, b in zip(texts, begin, strict=False) for i in range(len(t) - depth + 1)]
        assert len(set(places)) == len({s for s, _ in places}) == len({c for _, c in places})


def test_merge_leaves_what_stands_in_several_shards():
    texts = [b"abcdefghij" * 3, b"xyz" * 9, b"abcdefghij" * 2, b"pqr" * 9]
    shards = [bwt.transform(bwt.symbols([t]), 9) for t in texts]
    entry, block = bwt.merge(shards, 9)
    place = np.concatenate([s.order + b for s, b in zip(shards, np.cumsum([0] + [len(t) + 1 for t in texts]), strict=False)])[entry]
    whole = bwt.symbols(texts)
    assert len(set(block)) == 10 and {bytes((whole[p : p + 9] - 1).astype(np.uint8)) for p in place} == {(b"abcdefghij" * 2)[i : i + 9] for i in range(10)}


def test_anchors_of_a_text_longer_than_a_segment(monkeypatch):
    """In overlapping parts, or whole: the same repeats, and an anchor for every window that needs one."""
    rng = random.Random(11)
    text = bytes(rng.choices(range(97, 105), k=300_000))
    text += text[:5000] + bytes(rng.choices(range(97, 105), k=9_000_000)) + text[100:700]
    monkeypatch.setattr(substrings, "SEGMENT", 1 << 20)
    (places, hashes, lo, hi), (_, _, none, _) = substrings.anchors_of([text, b"short"])
    # random text repeats nothing by itself: what repeats are the two copies, as far as their surroundings happen to agree
    right = next(k for k in range(100) if text[5000 + k] != text[305_000 + k])
    left = next(k for k in range(100) if text[99 - k] != text[len(text) - 601 - k])
    covered = np.zeros(len(text), bool)
    for at, end in ((0, 5000 + right), (300_000, 305_000 + right), (len(text) - 600 - left, len(text))):
        covered[at:end] = True
    got = np.zeros(len(text), bool)
    for a, b in zip(lo, hi, strict=True):
        got[a:b] = True
    assert (got == covered).all() and not len(none)
    begins = np.arange(0, len(text) - 199, 997)
    gap = np.searchsorted(places, begins)
    assert (places[gap] <= begins + 200 - substrings.GRAM).all() and len(hashes) == len(places) == len(np.unique(places))


@pytest.mark.parametrize(("chunk", "hot"), [(4, 2), (2048, 1000)])
def test_repeats_against_brute_force(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(common, "HOT_COPIES", hot)
    monkeypatch.setattr(substrings, "BROADCAST_KEYS", 500_000 if hot > 2 else -1)
    rng = random.Random(5)
    shared = ["".join(rng.choices("abcde ", k=n)) for n in (150, 180, 199, 200, 201, 230, 400, 900)]
    texts = []
    for _ in range(150):
        t = "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij é", k=rng.randrange(1, 300))) for _ in range(rng.randrange(0, 6)))
        texts.append("Ha " * rng.randrange(1, 300) + t if rng.random() < 0.1 else t)
    texts += [None, "", texts[0], texts[1], texts[1]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in substrings.remove_repeats(df, with_text=True, chunk=chunk).collect()}
    assert got == dict(enumerate(brute_repeats([(t or "").encode() for t in texts])))
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def shingles(t):
    w = [x for x in re.split(r"[ \t-\r]+", (t or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similar_windows(docs, items):
    """Best similarity of each document and item over every window, if it is 0.8 or more."""
    want = {}
    for i, t, *_ in docs:
        hs = shingles(t)
        for k, item in items:
            own = collections.Counter(shingles(item))
            m = sum(own.values())
            for s in range(len(hs) if m else 0):
                win = collections.Counter(hs[s : s + m])
                common = sum((win & own).values())
                if common / (sum(win.values()) + m - common) >= 0.8:
                    want[i, k] = max(want.get((i, k), 0), common / (sum(win.values()) + m - common))
    return want


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 8)))
    items = [(i, " ".join(word() for _ in range(rng.choice([rng.randrange(5, 60), rng.randrange(130, 400) if i % 5 == 0 else 30])))) for i in range(20)]
    items += [(50, None), (51, "too few words"), (52, "la la la la la la la la la")]
    docs = []
    for i in range(160):
        words = [word() for _ in range(rng.randrange(0, 150))]
        if rng.random() < 0.7:
            leak = rng.choice(items[:20])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = word()
            if rng.random() < 0.3:
                leak = leak[: rng.randrange(1, len(leak) + 1)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak * rng.choice([1, 1, 2])
        docs.append((i, " \n".join(words).upper() if i % 3 else " ".join(words), 1))
    docs += [(500, None, 1), (501, "", 1), (502, "LA la la la la la la la la la la la", 1), docs[0]]
    return docs, items


def test_contamination_against_every_window(spark, leaks):
    docs, items = leaks
    d, b = spark.createDataFrame(docs, "doc_id long, text string, key int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(d, b).collect()}
    want = similar_windows(docs, items)
    missed = set(want) - set(got)
    assert len(want) > 40 and len(missed) <= 0.05 * len(want)  # fingerprints further apart than the radius
    assert got == pytest.approx({pair: j for pair, j in want.items() if pair not in missed})
    assert decontamination.contaminated(d.limit(0), b).count() == 0 == decontamination.contaminated(d, b.limit(0)).count()
    assert decontamination.contaminated(d, b.limit(0)).columns == decontamination.contaminated(d, b).columns


def test_contamination_by_items_that_repeat_words(spark):
    """Similarity counts shingles as often as they occur; so must what goes before it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items, docs = [], []
    for i, (same, other) in enumerate(((40, 3), (30, 2), (58, 6), (20, 1), (45, 0), (36, 3))):
        own = [word()] * same
        items.append((i, " ".join([*own, *(word() for _ in range(other))])))
        docs.append((i, " ".join([*(word() for _ in range(7)), *own, *(word() for _ in range(other + 5))])))
        docs.append((100 + i, " ".join([*(word() for _ in range(60)), *own[: same // 3], *(word() for _ in range(40))])))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(similar_windows(docs, items)) and len(got) == 6


def test_fingerprints_decide_the_candidates(spark, leaks, monkeypatch):
    docs, items = leaks
    d, b = spark.createDataFrame(docs, "doc_id long, text string, key int"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()}
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)  # joins by shuffle
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()} == found
    monkeypatch.setattr(decontamination, "simhash", lambda h: decontamination.F.lit(0x0F0F0F0F0F0F0F).cast("long"))
    assert decontamination.contaminated(d, b).count() < 5


def test_sliding_fingerprints_against_loop(spark):
    rng = random.Random(2)
    plain = lambda h: sum(1 << b for b in range(60) if 2 * sum(x >> b & 1 for x in h) > len(h))
    rows = [(i, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(1, 64))]) for i in range(40)] + [(99, [-1] * 63), (98, [-1] * 31 + [0] * 32)]
    df = spark.createDataFrame(rows, "id int, h array<bigint>")
    sums = [decontamination.running(F.col("h"), j) for j in range(6)]
    moved = [(F.element_at(s, -1) - F.get(s, F.lit(1))).bitwiseAND(F.lit((1 << 60) - 1)) for s in sums]
    for r in df.select("h", decontamination.simhash(F.col("h")).alias("fp"), decontamination.fingerprint(moved, F.size("h") - 1).alias("rest")).collect():
        assert (r["fp"], r["rest"]) == (plain(r["h"]), plain(r["h"][1:]))


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    scores = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if scores[i]["held_out"]]
    assert len(held) > 40 and sum(scores[i]["predicted"] == labels[i] for i in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scores.values())


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (None, "x" * 50_000)], "doc_id long, text string")
    model = quality.fit(df, spark.createDataFrame([(1, 1), (9, None)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(df.withColumn("score", quality.F.lit("clash")), model).collect()}
    assert got[2] == got[3] == 0.0 and 0 < got[1] < 1 and len(got) == 4
    assert quality.score(df.limit(0), model).count() == 0


def test_quality_of_very_long_texts(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where(quality.held_out("doc_id")).orderBy("doc_id").select("text", "quality").collect()
    for y in (0, 1):
        joined = "\n".join(r["text"] for r in rows if r["quality"] == y and r["text"])
        for size in (100_000, 700_000, 3_000_000):
            assert int(model.score((joined * (size // len(joined) + 1))[:size]) >= 0.3) == y


def test_quality_is_trained_on_whole_texts(spark):
    """The fit against its own words: dictionaries of the even rows' whole texts, a calibration of the odd ones that is stationary."""
    rng = random.Random(6)
    words = {y: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(150)] for y in (0, 1, "both")}
    text = lambda y, n: " ".join(rng.choices(words[y], k=n))
    rows = [(i, text("both", 2_600) + " " + text(i % 2, 2_600), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    repeated = df.select("doc_id", "text").unionByName(spark.createDataFrame([(3, "~ a text that sorts later"), (None, "no id"), (7, None)], "doc_id long, text string"))
    model = quality.fit(repeated, df.select("doc_id", "quality"))
    used = {y: [(i, t) for i, t, q in rows if q == y and zlib.crc32(str(i).encode()) % 5] for y in (0, 1)}
    assert (model.bad, model.good) == tuple("".join(t for _, t in used[y][::2]).encode() for y in (0, 1))
    odd = [(quality.size_difference(t, model.good, model.bad), y) for y in (0, 1) for _, t in used[y][1::2]]
    x, y = np.array(odd).T
    p = 1 / (1 + np.exp(-(model.bias + model.weight * x)))
    z = (x - x.mean()) / (x.std() + 1e-9)
    ridge = 1e-2 * np.array([model.bias + model.weight * x.mean(), model.weight * (x.std() + 1e-9)])
    assert np.array([(y - p).sum(), ((y - p) * z).sum()]) == pytest.approx(ridge, abs=1e-6)
    right = [int(model.score(text("both", 2_600) + " " + text(i % 2, 2_600)) >= 0.5) == i % 2 for i in range(40)]
    assert sum(right) >= 38
    few = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"), rows_per_class=20)
    chosen = sorted((r["doc_id"] for r in df.where(~quality.held_out("doc_id") & (F.col("quality") == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()))
    assert few.good == "".join(t for i, t, _ in rows if i in chosen[::2]).encode()


def test_quality_scores_against_plain_compression(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    size = lambda raw, d: len(zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw))
    held = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{sf}/documents.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 5 == 0}
    rows = quality.score(docs.select("doc_id", "text", quality.held_out("doc_id").alias("h")), model).collect()
    assert {r["doc_id"] for r in rows if r["h"]} == held
    for r in rows[:60]:
        raw = (r["text"] or "").encode()
        parts = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        x = sum(size(c, model.bad) - size(c, model.good) for c in parts) / max(1, len(raw)) * min(1024, len(raw)) ** 0.5
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.bias + model.weight * x))) if raw else 0.0)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_pages_against_their_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_html"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?:/?p|br|/?h1)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=/>home</a></header><div id="cookie-notice">We use cookies <button>ok</button></div><div class="wrap"><div class="content">
<h1>Title &amp; more</h1><p>First <i>para</i>graph with lots of words that go on and on, and on.</p><ul><li>one item of the list<li>two</ul><div class="share"><a href=x>tweet</a></div>
<p>Second paragraph is here too, again with lots of text &lt;tag&gt;.</p></div><div class="sidebar"><p>Related things that are long enough to look like text, really they are.</p></div></div>
<section id="comments"><article class="comment"><p>I like this article very much, thanks for writing it all down.</p></article></section><form><p>Subscribe to our newsletter for more.</p></form>
<footer>&copy; 2020</footer><script>if (a<b) x="</p>"</script></body>"""


def test_pages_of_other_shapes(spark):
    want = "Title & more First paragraph with lots of words that go on and on, and on. one item of the list two Second paragraph is here too, again with lots of text <tag>."
    assert html_extract.main_text(PAGE)[0] == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<" * 20_000), (6, "u", '<a "' * 5_000), (7, "u", "<div>" * 5_000 + "x"), (1, "u", PAGE)]
    got = html_extract.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 8 and [r["text"] for r in got if r["page_id"] == 1] == [want, want] and all(r["text"] == "" for r in got if r["page_id"] in (2, 3, 4))


def test_pages_of_tag_soup(spark):
    tags = "div p span hr br article nav aside td tr table ul li h1 header footer img a b section main form".split()
    rng = random.Random(1)
    piece = lambda: rng.choice([f"<{rng.choice(tags)}{rng.choice(['', ' class=banner', ' id=comments', ' hidden', ' class="x'])}>", f"</{rng.choice(tags)}>", "some words here. ", "x", "<", "&amp;", "<!-- c", "-->"])
    for _ in range(5000):
        html_extract.main_text("".join(piece() for _ in range(rng.randint(1, 60))))
    for page in ("<div>foo<hr>bar</div>", "a</div>b", "<div>a</p>b</div>", "<td>a</td>b</td>c"):
        assert html_extract.smoothness(html_extract.blocks(page))
    rule = "<article><h1>On the matter at hand</h1><p>" + "The first part of the text. " * 12 + "</p><hr>" + "What goes on after a rule, in no element of its own. " * 6 + "</article>"
    assert html_extract.main_text(rule)[0].endswith("in no element of its own.")


def test_depth_of_named_elements_does_not_matter():
    def page(n):
        inner = "<article><h1>Title of it</h1><p>" + "The main text goes on here. " * 20 + "</p></article><div class=sidebar><p>Side links here and there that are not of interest. More of it, quite long so that it counts as a sentence or two.</p></div>"
        return "<body>" + "<div class='banner'>" * n + inner + "</div>" * n + "</body>"

    assert {html_extract.main_text(page(n))[0] for n in (1, 15, 16, 17, 30, 400)} == {html_extract.main_text(page(2))[0]}
    assert "Side" not in html_extract.main_text(page(30))[0]


def test_the_cut_decides_blocks_of_doubt():
    long = "A sentence of the article that goes on for a while, so that nobody can take it for a menu or a notice of any kind."
    page = f"<body><div><a href=/>home</a><p>Log in</p></div><section><h2>On cuts</h2><p>{long}</p><p>Quite so.</p><p>{long}</p><ul><li>first</ul><p>{long}</p></section><div><p>See all</p><p>Up</p></div></body>"
    found = html_extract.blocks(page)
    alone = {b.text for b, c in zip(found, html_extract.costs(found), strict=True) if c > 0}
    text, _, _, changed = html_extract.main_text(page)
    assert text == f"On cuts {long} Quite so. {long} first {long}" and changed >= 2
    assert not {"Quite so.", "first"} & alone
    shuffled = {e: 0.0 for e in html_extract.smoothness(found)}
    assert {b.text for b, x in zip(found, html_extract.minimum_cut(html_extract.costs(found), shuffled), strict=True) if x} == alone


def test_names_of_regions_are_bounded():
    long = "A sentence of the article that goes on for a while, so that nobody can take it for a menu or a notice of any kind."
    page = f'<body><nav><a href=/>home</a></nav><div class="promo social"><h1>On cuts and their uses</h1><p>{long}</p><p>{long}</p><p>{long}</p><div class="share"><a href=x>tweet</a></div></div><footer><p>{long[:60]}</p></footer></body>'
    assert html_extract.main_text(page)[0] == f"On cuts and their uses {long} {long} {long}"


def test_cut_is_least():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 8)
        cost = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        energy = lambda x: sum(abs(c) for c, y in zip(cost, x, strict=True) if (c > 0) != y) + sum(w for (i, j), w in edges.items() if x[i] != x[j])  # noqa: B023, E731
        best = min(energy([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert energy(html_extract.minimum_cut(cost, edges)) == pytest.approx(best)


def brute_near_copies(rows):
    """Smallest id of each group of texts that are equal or whose sets of five-word shingles reach 0.8."""
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets, by_shingle = {i: of(t) for i, t in rows}, collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].add(i)
    first = {}
    for i, t in rows:
        a, b = root(i), root(first.setdefault(t or "", i))
        parent[max(a, b)] = min(a, b)
    for pair in {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}:
        x, y = (sets[i] for i in pair)
        if len(x & y) >= 0.8 * len(x | y):
            a, b = map(root, pair)
            parent[max(a, b)] = min(a, b)
    return {i for i in parent if root(i) == i}


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = stages["quality"](spark, docs, sf).cache()
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in texts.items() if model.score(t or "") >= 0.3}
    got = {r["doc_id"] for r in stages["near_dedup"](spark, docs, sf).collect()}
    assert got == brute_near_copies(list(texts.items()))
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    hit = {i for i, _ in similar_windows(list(texts.items()), items)}
    assert {r["doc_id"] for r in stages["decontamination"](spark, docs, sf).collect()} == set(texts) - hit
    spans = {r["doc_id"]: [(x["s"], x["e"], x["kind"]) for x in r["pii"]] for r in pii.find(docs).collect()}
    for r in stages["pii"](spark, docs, sf).collect():
        out, at = [], 0
        for s, e, kind in spans[r["doc_id"]]:
            if s >= at:
                out.append(texts[r["doc_id"]][at:s] + f"<{kind}>")
            at = max(at, e)
        assert r["text"] == "".join(out) + texts[r["doc_id"]][at:]
        assert r["n_chars"] == len(r["text"])


def test_pipeline_of_nothing(spark, sf, tmp_path):
    """Empty tables, and documents with a column more: no rows, and only the columns of documents."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    more = spark.read.parquet(f"{sf}/documents.parquet").limit(20).withColumn("score", F.lit("clash")).withColumn("rep", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, more, sf).columns == corpus_pipeline.COLUMNS, name


def test_near_copies_without_ids(spark, sf):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (None, text), (None, "quite another text without an id"), (None, "quite another text without an id"), (2, "b of one id"), (2, "a of one id"), (3, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, sf).collect()), key=str)
    assert got == [(0, "quite another text without an id"), (1, text), (2, "a of one id"), (3, None)]


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, sf).cache()
        after = {r["doc_id"] for r in kept.collect()}
        assert after <= set(before)
        if name != "bpe":
            assert kept.columns == docs.columns
        if name == "near_dedup":
            texts = [before[i] for i in after]
            assert len(texts) == len(set(texts)) == len(set(before.values()) & set(texts)) and set(texts) <= set(before.values())
        if name == "decontamination":
            items = duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()
            assert set(before) - after >= {i for i, t in before.items() if any(x in t for (x,) in items if len(x.split()) > 8)}
    assert kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < kept.count() < len(seen)
    assert corpus_pipeline.run(spark, sf).count() == kept.count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0
