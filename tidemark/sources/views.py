"""Price bars, benchmark, volatility index and option chain, derived from the base tables.

Bars are one long table keyed by (symbol, bar_date), so every window is partitioned by symbol. Only columns that a
view needs are read, and date bounds are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Added before rounding to six decimals: an exact half then goes up whatever its last bit is.
TIE = 1e-9


def _r6(c):
    return F.round(c + TIE, 6)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _priced(lines: DataFrame, *keys) -> DataFrame:
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    return lines.groupBy(*keys, F.to_date("l_shipdate").alias("bar_date")).agg(
        _r6(F.avg(price)).alias("close"), _r6(F.max(price)).alias("high"), _r6(F.min(price)).alias("low"), F.sum("l_quantity").alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six symbols, one for each pair of return flag and line status."""
    symbol = F.concat_ws("/", "l_returnflag", "l_linestatus").alias("symbol")
    return _priced(read(spark, sf_dir, "lineitem"), symbol)


def asset_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all lines together, under the symbol 'asset'."""
    return _priced(read(spark, sf_dir, "lineitem"), F.lit("asset").alias("symbol"))


def bench_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bar_date, bench): daily close of the benchmark."""
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("bar_date")).agg(_r6(F.avg("o_totalprice")).alias("bench"))


def volidx_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bar_date, volidx): daily level of the volatility index."""
    return read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("bar_date")).agg(_r6(400 * F.avg("l_discount")).alias("volidx"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of every symbol on the dates that the benchmark has too. The benchmark is one row a day."""
    return bars(spark, sf_dir).join(bench_bars(spark, sf_dir), "bar_date").select("symbol", "bar_date", "close", "bench")


def _contract():
    kind = F.when(F.col("l_returnflag") == "R", "p").otherwise("c").alias("kind")
    return kind, (7 * (F.col("l_suppkey") % 20) + 3).cast("int").alias("dte"), F.round(100 * (0.4 + 0.05 * (F.col("l_partkey") % 25)), 2).alias("strike")


def option_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, dte, strike, bar_date, close): daily closes of every contract."""
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    return read(spark, sf_dir, "lineitem").groupBy(*_contract(), F.to_date("l_shipdate").alias("bar_date")).agg(_r6(F.avg(price)).alias("close"))


def chain(spark: SparkSession, sf_dir: str, spot: float = 100.0) -> DataFrame:
    """One row per option contract (kind, dte, strike) with moneyness, quotes, volume, open interest and vendor iv."""
    k = read(spark, sf_dir, "lineitem").groupBy(*_contract()).agg(
        F.count("*").alias("n"), _r6(F.avg("l_discount")).alias("ad"), _r6(F.avg("l_tax")).alias("at")
    )
    m = F.col("strike") / spot
    intrinsic = F.greatest(F.when(F.col("kind") == "c", spot - F.col("strike")).otherwise(F.col("strike") - spot), F.lit(0.0))
    k = k.withColumn("mny", m).withColumn("mid0", _r6(intrinsic + 40 * F.sqrt(F.col("dte") / 365.0) * F.exp(-4 * F.abs(m - 1)) * (0.8 + 4 * F.col("ad"))))
    hs = F.when(F.col("n") % 11 == 0, 6).otherwise(2) * F.col("at")
    return k.select(
        "kind", "dte", "strike", "mny", F.when(F.col("n") % 17 == 0, 0.0).otherwise(_r6(F.col("mid0") * (1 - hs))).alias("bid"), _r6(F.col("mid0") * (1 + hs)).alias("ask"),
        (F.col("n") % 7).alias("volume"), (10 + 45 * (F.col("n") % 5)).alias("open_interest"), _r6(0.3 + 6 * F.col("ad") + 0.3 * (m - 1) * (m - 1)).alias("iv"),
    )
