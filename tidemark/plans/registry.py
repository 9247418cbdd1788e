"""Registration of queries, each with the DuckDB SQL that gives the same rows, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.views import TIE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# views over the base tables, as tidemark.sources.views has them
PRICED = """round(avg(l_extendedprice / l_quantity), 6) AS close, round(max(l_extendedprice / l_quantity), 6) AS high,
 round(min(l_extendedprice / l_quantity), 6) AS low, sum(l_quantity) AS volume"""
BARS = f"bars AS (SELECT l_returnflag || '/' || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS bar_date, {PRICED} FROM lineitem GROUP BY 1, 2)"
ASSET = f"asset AS (SELECT 'asset' AS symbol, CAST(l_shipdate AS DATE) AS bar_date, {PRICED} FROM lineitem GROUP BY 1, 2)"
BENCH = "bench AS (SELECT CAST(o_orderdate AS DATE) AS bar_date, round(avg(o_totalprice), 6) AS bench FROM orders GROUP BY 1)"
VOLIDX = "volidx AS (SELECT CAST(l_shipdate AS DATE) AS bar_date, round(400 * avg(l_discount), 6) AS volidx FROM lineitem GROUP BY 1)"
PAIR = f"{BARS}, {BENCH}, pair AS (SELECT symbol, bar_date, close, bench FROM bars JOIN bench USING (bar_date))"
CHAIN = """k AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'p' ELSE 'c' END AS kind, CAST(7 * (l_suppkey % 20) + 3 AS INT) AS dte, round(100 * (0.4 + 0.05 * (l_partkey % 25)), 2) AS strike,
 count(*) AS n, round(avg(l_discount), 6) AS ad, round(avg(l_tax), 6) AS atx FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, strike / 100.0 AS mny, round(greatest(CASE WHEN kind = 'c' THEN 100 - strike ELSE strike - 100 END, 0) + 40 * sqrt(dte / 365.0) * exp(-4 * abs(strike / 100.0 - 1)) * (0.8 + 4 * ad), 6) AS mid0,
 CASE WHEN n % 11 = 0 THEN 6 ELSE 2 END * atx AS hs FROM k),
chain AS (SELECT kind, dte, strike, mny, CASE WHEN n % 17 = 0 THEN 0 ELSE round(mid0 * (1 - hs), 6) END AS bid, round(mid0 * (1 + hs), 6) AS ask, n % 7 AS volume, 10 + 45 * (n % 5) AS open_interest,
 round(0.3 + 6 * ad + 0.3 * (mny - 1) * (mny - 1), 6) AS iv FROM m)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its DuckDB SQL."""
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql.replace(", 6)", f" + {TIE}, 6)")  # as r6 has it
        return f

    return put


def r6(col: str | Column, name: str | None = None) -> Column:
    """Six decimals, with the slack that keeps exact halves from going either way."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + TIE, 6).alias(name or col)


def roll(fn: str, x: str, n: int, least: int | None = None, key: str = "symbol") -> str:
    """SQL of a gated rolling aggregate; `fn` has {} for its arguments."""
    w = f"OVER (PARTITION BY {key} ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x.split(',')[0]}) {w} >= {least or n} THEN {fn}({x}) {w} END"
