import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, secrets

EDGES = ["1" * 6000 + "x", "a" * 6000, "a." * 3000 + "@", "1." * 3000, "1 " * 3000, "+1" * 3000, "f" * 5000, "token " + " " * 6000, "ab@c.d.e@f.g x_y@z.w", None, "", "\x01 a@b.co \x01"]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def personal(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 14 <= len(d) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 10 <= len(d) <= 15),
    }
    return sorted((m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0])))


def secret(text):
    kinds = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, text or "", re.A) if ok[k](m))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def fuzz(spark):
    rng = random.Random(3)
    parts = list("0123456789") * 3 + list("  --..+@()") + ["ab", "AKIA", "token", "=", '"', ": ", "12", "Z", "é", "🙂", "\x01", "password", "api_key", "a@b.co", "0123456789abcdef" * 2, "4111 1111 1111 1111"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(800)] + EDGES
    return spark.createDataFrame([(i, t, f"s{i % 5}", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, found string").cache()


@pytest.mark.parametrize(("digests", "brute", "kinds"), [(pii.digest, personal, pii.BASE), (secrets.digest, secret, secrets.BASE)])
def test_base_spans_against_regular_expressions(fuzz, digests, brute, kinds):
    texts = {r["doc_id"]: r["text"] for r in fuzz.collect()}
    got = digests(fuzz).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(want), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[2] == k for s in want) for k in kinds]
        assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(r["spans"].split(",")) | set()
    assert digests(fuzz.limit(0)).count() == 0


def test_checksums_context_and_masks(spark):
    texts = ["Account DE89 3704 0044 0532 0130 00.", "Not DE88 3704 0044 0532 0130 00.", "ssn: 123-45-6789", "order 123-45-6789", "card 4111 1111 1111 1111 of a@b.co"]
    df = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kinds = {r["doc_id"]: [(x["kind"], x["v"]) for x in r["pii"]] for r in df.collect()}
    assert kinds[0] == [("iban", "DE89 3704 0044 0532 0130 00")] and kinds[1] == [] and kinds[2] == [("ssn", "123-45-6789")] and kinds[3] == []
    scores = {r["doc_id"]: {x["kind"]: x["score"] for x in r["pii"]} for r in df.collect()}
    assert scores[4] == {"card": 0.98, "email": 0.9}
    assert [r["text"] for r in pii.mask(df).orderBy("doc_id").collect()] == ["Account <iban>.", texts[1], "ssn: <ssn>", texts[3], "card <card> of <email>"]


def test_ibans_among_capitals_digits_and_codes(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"
    texts = [
        "DE89370400440532013000 Please pay", f"{de} BIC COBADEFF", f"{de} 12 EUR", f"to {gb} {de} OR {no} NOW 2024", f"AB12 {de} X", f"AT12 3456 {de}", f"REF DE12 3456 {gb} A1", "é🙂 " * 30 + f"{no} A",
        "XX" + str(98 - int("0123456789012345" + "3333" + "00") % 97).zfill(2) + "0123456789012345 EUR", f"{gb}9 Z", f"x{gb}", "DE88 3704 0044 0532 0130 00 BIC", "AB12 " * 3000, None, f"\x01 {gb} \x01",
    ]
    want = [["DE89370400440532013000"], [de], [de], [gb, de, no], [de], [de], [gb], [no], [texts[8][:20]], [], [], [], None, [], [gb]]
    df = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    for r in df.collect():
        found = [x for x in r["pii"] if x["kind"] == "iban"]
        if want[r["doc_id"]] is not None:
            assert [x["v"] for x in found] == want[r["doc_id"]], r["text"]
        assert all(r["text"][x["s"] : x["e"]] == x["v"] and r["text"][max(0, x["s"] - 40) : x["s"]].replace("\x01", "\x02").endswith(x["c"]) for x in found)
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert masked[0] == "<iban> Please pay" and masked[1] == "<iban> BIC COBADEFF" and masked[3] == "to <iban> <iban> OR <iban> NOW 2024"


def test_context_after_a_span(spark):
    df = pii.find(spark.createDataFrame([(1, "123-45-6789 is my ssn"), (2, "123-45-6789 is my order")], "doc_id long, text string"))
    assert {r["doc_id"]: [x["kind"] for x in r["pii"]] for r in df.collect()} == {1: ["ssn"], 2: []}


def test_texts_with_very_many_spans(spark):
    texts = ["a@b.co é 4111 1111 1111 1111; " * 25_000, "token=abcdefgh " * 50_000, "DE89370400440532013000 " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    assert (got[0]["n_email"], got[0]["n_card"], got[2]["n_other"]) == (25_000, 25_000, 20_000)
    masked = {r["doc_id"]: r["text"] for r in pii.mask(pii.find(df)).collect()}
    assert masked[0] == "<email> é <card>; " * 25_000 and masked[2] == "<iban> " * 20_000
    assert {r["doc_id"]: r["n_assign"] for r in secrets.digest(df.withColumn("source", F.lit("s"))).collect()}[1] == 50_000
    assert time.time() - began < 60


def test_ownership_tells_copies_from_owners(spark):
    rows = [(i, "token=copied99", f"s{i}", f"s{i}") for i in range(4)] + [(10, "token=mine1234 and token=mine1234", "s1", "s1"), (11, None, None, None), (12, "token=copied99", None, None)]
    got = {r["doc_id"]: r for r in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string, source string, own string"), owner="own").collect()}
    assert (got[0]["n_shared"], got[0]["n_owned"], got[0]["owners"]) == (1, 0, "assign:0:14:5")
    assert (got[10]["n_shared"], got[10]["n_owned"]) == (0, 2) and got[11]["spans"] == "" and got[12]["n_shared"] == 1
