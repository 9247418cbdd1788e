"""Spans of regular expressions as DataFrame expressions, with positions in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before and after a match and is kept for context words, in code points.
CONTEXT = 40
MARK = "\x01"
FIELDS = "s:int,e:int,v:string,c:string,a:string"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running `op` (associative) over an array, by doubling: n log n steps and no growing copies."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    steps = F.when(rounds > 0, F.sequence(F.lit(0), F.greatest(rounds, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))

    def step(a: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(a, lambda x, i: F.when(i >= back, op(F.get(a, i - back), x)).otherwise(x))

    return F.aggregate(steps, values, step)


def pieces(text: Column, pattern: str, replacement: str = "$0") -> Column:
    """The text cut at its matches: what stands between them at even places, the matches at odd ones.

    Matches are set between marks by one replacement and the text is split at the marks; a mark that the text already
    has is first turned into another control character, so patterns must not match control characters.
    """
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\x02")).otherwise(text)
    return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{MARK}{replacement}{MARK}")), MARK, -1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern: array<struct<s, e, v, c, a>> of start, end (exclusive), the
    match and up to CONTEXT code points before and after it, or to the next match. Null text has none."""
    none = F.array().cast(f"array<struct<{FIELDS}>>")

    def found(cut: Column) -> Column:
        def at(ends: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2)), lambda i: F.struct(
                F.get(ends, i - 1).alias("s"), F.get(ends, i).alias("e"), F.get(cut, i).alias("v"), F.right(F.get(cut, i - 1), F.lit(CONTEXT)).alias("c"), F.left(F.get(cut, i + 1), F.lit(CONTEXT)).alias("a"),
            ))

        return F.when(F.size(cut) > 2, let(scan(F.transform(cut, F.length), lambda a, b: a + b), at)).otherwise(none)

    return F.coalesce(let(pieces(text, pattern), found), none)


def spans(kinds: list[tuple[str, Column]]) -> Column:
    """One array of (s, rank, kind, e, v, c, a) in order of start, then of kind as listed."""

    def tagged(i: int, kind: str):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["v"].alias("v"), x["c"].alias("c"), x["a"].alias("a"))

    return F.array_sort(F.concat(*[F.transform(m, tagged(i, k)) for i, (k, m) in enumerate(kinds)]))


def count_of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))
