import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import bpe

ALPHABET = "ab cd  \n\t'sretlvm 12,.!é漢字🙂  \u0085\x1c​ßñ"


def text(rng, n):
    pieces = [lambda: rng.choice(ALPHABET), lambda: bpe.SPECIAL, lambda: " ", lambda: chr(rng.randrange(32, 0x3000))]
    return "".join(rng.choices(pieces, [80, 2, 8, 10])[0]() for _ in range(n))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_codec_is_the_tokenizers_library(reference):
    rng, c = random.Random(0), bpe.codec(bpe.default_vocabulary())
    for _ in range(1500):
        t = text(rng, rng.randrange(0, 90))
        ids = reference.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == ids
        assert c.decode(np.array(ids, dtype="u4")) == reference.decode(ids, skip_special_tokens=False) == t


def test_tree_joins_exactly(reference):
    rng, c = random.Random(1), bpe.codec(bpe.default_vocabulary())
    for k in range(150):
        t = "a" * 700 if k == 0 else "漢字" * 300 if k == 1 else text(rng, 900)
        n = rng.randrange(1, 250)
        whole, ids = c.tree([(t[i : i + n], c.encode(t[i : i + n])) for i in range(0, len(t), n)])
        assert whole == t and ids.tolist() == reference.encode(t, add_special_tokens=False).ids


def test_digests_of_every_row(spark, reference):
    rng = random.Random(2)
    texts = [None, "", "one", "one", text(rng, 5000), "x" * 3000, *[text(rng, rng.randrange(200, 900)) for _ in range(12)]]
    texts.append(texts[4])
    df = spark.createDataFrame([(i if i else None, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, key string, ids string")
    got = sorted(bpe.encode_digests(df, leaf_chars=300).collect(), key=lambda r: r["doc_id"] or 0)
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_digests(df.limit(0)).count() == 0


def test_length_table_against_brute_force(spark):
    rng = random.Random(3)
    lengths = [0, 0, *[int(rng.expovariate(1 / 400)) for _ in range(500)]]
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    table = bpe.length_table(bpe.length_histogram(df), block=64).cache()
    rows = table.collect()
    assert {r["length"] for r in rows} == set(lengths)
    for r in rows:
        upto = [x for x in lengths if x <= r["length"]]
        assert (r["docs_upto"], r["docs_over"], r["tokens_upto"]) == (len(upto), len(lengths) - len(upto), sum(upto))
        assert r["truncated_tokens"] == sum(min(x, r["length"]) for x in lengths) and r["total_tokens"] == sum(lengths)
    quantiles = {r["q"]: r["length"] for r in bpe.length_quantiles(table, [0.1, 0.5, 1.0]).collect()}
    ordered = sorted(lengths)
    assert quantiles == {q: ordered[-(-int(q * 1000) * len(ordered) // 1000) - 1] for q in (0.1, 0.5, 1.0)}
    cuts = {r["limit"]: r["tokens"] for r in bpe.truncated_total(table, [0, 7, 512, 10**6]).collect()}
    assert cuts == {n: sum(min(x, n) for x in lengths) for n in (0, 7, 512, 10**6)}
    assert bpe.length_table(bpe.length_histogram(df.limit(0))).count() == 0


def test_counts_and_ids(spark, reference):
    df = spark.createDataFrame([(1, "hello wörld"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(df).collect()} == {1: len(reference.encode("hello wörld").ids), 2: 0}
    assert {r["doc_id"]: list(r["ids"]) for r in bpe.token_ids(df).collect()}[1] == reference.encode("hello wörld").ids


@pytest.mark.parametrize("run", [" ", "\t", "\n", "\r\n", "\u3000", "\xa0 "])
def test_very_long_white_space(reference, run):
    c = bpe.codec(bpe.default_vocabulary())
    n = 5_000_000 // len(run) if run in " \t\n" else 100_000
    for text in (f"word{run * n}word", run * n, f"a{run * 40_000}<|endoftext|>{run * 40_000}<|endoftext|> b\x1c{'\x1c' * 40_000}"):
        assert c.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_white_space_up_the_tree(spark, reference):
    texts = ["begin" + " " * 60_000 + "\n\n" + " " * 60_000 + "end", "\n" * 100_001, "x " * 30_000 + "\t" * 70_000]
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.encode_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(reference.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
