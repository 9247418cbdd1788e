"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.spans import CONTEXT, FIELDS, count_of, let, matches, pieces, scan, spans, written

BASE = ("email", "ip", "card", "phone")
# Possessive loops and look-behinds only keep long runs linear; what they match is what the plain patterns match. The one
# for iban matches nothing wide: it captures what may follow a start, and `ibans` looks for the end.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {
    n: codes.split() for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Score of a confirmed span, and of one with a context word close by.
SCORES = {"email": (0.9, 0.95), "ip": (0.6, 0.9), "card": (0.8, 0.98), "phone": (0.7, 0.95), "iban": (0.9, 0.99), "ssn": (0.3, 0.85)}
CONTEXT_WORDS = {
    "email": r"mail|contact|write", "ip": r"\bip\b|address|host|server|client", "card": r"card|visa|master|credit|debit|pay|kart|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|whatsapp", "iban": r"iban|bank|account|konto|compte|cuenta", "ssn": r"ssn|social|security",
}
THRESHOLD = 0.5


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def mod97(v: Column) -> Column:
    """ISO 7064 check of an IBAN: the first four characters go last, letters count 10 to 35, the remainder must be 1."""
    plain = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def ibans(text: Column) -> Column:
    """IBANs of a text as array<struct<s, e, v, c, a>>, like `matches`, every start tried; one that begins inside a
    valid one before it is left out.

    An IBAN ends where a word ends: for a country of the registry at its length, for others at the longest end that
    passes mod-97, so capitals, digits and codes that follow do not hide it.
    """
    none = F.array().cast(f"array<struct<{FIELDS}>>")
    length = F.create_map(*[F.lit(x) for n, codes in IBAN_LENGTHS.items() for code in codes for x in (code, n)])

    def ending(window: Column) -> Column:
        words = F.split(window, " ")
        ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))

        def fits(v: Column) -> Column:
            plain = F.replace(v, F.lit(" "), F.lit(""))
            n = F.length(plain)
            return n.between(15, 34) & (F.upper(plain) == plain) & F.coalesce(F.try_element_at(length, F.left(plain, F.lit(2))) == n, F.lit(True)) & mod97(v)

        return F.coalesce(F.try_element_at(F.filter(ends, fits), F.lit(1)), F.lit(""))

    def found(cut: Column) -> Column:
        # at odd places stands what may follow a start; the text itself goes on at the even ones
        sizes = F.transform(cut, lambda x, i: F.when(i % 2 == 0, F.length(x)).otherwise(F.lit(0)))

        def at(ends: Column) -> Column:
            every = F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), lambda i: let(ending(F.get(cut, i)), lambda v: F.struct(
                F.get(ends, i).alias("s"), (F.get(ends, i) + F.length(v)).alias("e"), v.alias("v"), F.right(F.concat(F.coalesce(F.get(cut, i - 3), F.lit("")), F.get(cut, i - 1)), F.lit(CONTEXT)).alias("c"),
                F.left(F.substring(F.concat(F.get(cut, i + 1), F.coalesce(F.get(cut, i + 3), F.lit(""))), F.length(v) + 1, F.lit(CONTEXT)), F.lit(CONTEXT)).alias("a"),
            )))
            valid = F.filter(every, lambda x: x["e"] > x["s"])

            def apart(xs: Column) -> Column:
                reach = scan(F.transform(xs, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
                return let(reach, lambda r: F.filter(xs, lambda x, i: (i == 0) | (F.get(r, i - 1) <= x["s"])))

            return let(valid, apart)

        return F.when(F.size(cut) > 2, let(scan(sizes, lambda a, b: a + b), at)).otherwise(none)

    return F.coalesce(let(pieces(text, PATTERNS["iban"], "$1"), found), none)


def confirmed(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(v, F.lit(OCTETS))
    if kind == "card":
        return F.length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def score(kind: str, x: Column) -> Column:
    """Higher with a context word close before the span or close after it."""
    plain, backed = SCORES[kind]
    return F.when(F.regexp_like(F.lower(F.concat(x["c"], F.lit("\n"), x["a"])), F.lit(CONTEXT_WORDS[kind])), F.lit(backed)).otherwise(F.lit(plain))


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with pii: array of (s, rank, kind, e, v, c, a, score) over each whole text, sorted by start, then kind.

    Null and empty texts have no spans. Base kinds stay whatever their score; the added ones (iban, ssn) need a score
    of THRESHOLD, which for ssn takes a context word. A column named pii in the input is replaced.
    """
    text = text_or_empty(text_col)

    def kept(k: str):
        return lambda x: confirmed(k, x["v"]) & (F.lit(k in BASE) | (score(k, x) >= THRESHOLD))

    kinds = [(k, F.filter(ibans(text) if k == "iban" else matches(text, p), kept(k))) for k, p in PATTERNS.items()]
    found = F.transform(spans(kinds), lambda x: x.withField("score", F.coalesce(*[F.when(x["kind"] == k, score(k, x)) for k in PATTERNS])))
    return df.drop("pii").withColumn("pii", found)


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` (with pii, from find) with every span of its text replaced by its kind in angle brackets; of overlapping
    spans the one that starts first is replaced, whole, and later ones up to their ends with it."""
    text = text_or_empty(text_col)

    def replaced(chars: Column) -> Column:
        def parts(reach: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
            gap = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
            kept = F.transform("pii", lambda x, i: F.when(x["s"] >= before(i), F.concat(gap(before(i), x["s"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), gap(F.element_at(reach, -1), F.size(chars)))

        return let(scan(F.transform("pii", lambda x: x["e"]), lambda a, b: F.greatest(a, b)), parts)

    masked = let(F.split(text, "(?!$)", -1), replaced)
    return df.withColumn(text_col, F.when(F.size("pii") > 0, masked).otherwise(F.col(text_col)))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other, min_score.

    Null and empty texts have no spans: counts of 0, the hash of nothing, an empty string and a null min_score. Repeated
    rows and ids give repeated results; other columns of the input are left out.
    """
    found = find(df.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "pii")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    count = [count_of("pii", k).alias(f"n_{k}") for k in BASE]
    return found.select(
        id_col, *count, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"),
        (F.size("pii") - F.size(base)).cast("long").alias("n_other"), F.array_min(F.transform("pii", lambda x: x["score"])).alias("min_score"),
    )
