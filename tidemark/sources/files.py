"""Readers of vendor files: bar and option JSON, pipe-delimited text, saved documents, and a paged REST source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BARS = "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adjusted_close DOUBLE, volume DOUBLE"
SNAPSHOT = """details STRUCT<ticker: STRING, contract_type: STRING, strike_price: DOUBLE, expiration_date: STRING>, implied_volatility DOUBLE, greeks STRUCT<delta: DOUBLE>,
 open_interest DOUBLE, day STRUCT<volume: DOUBLE>, last_quote STRUCT<bid: DOUBLE, ask: DOUBLE>"""
AGGREGATES = "t BIGINT, o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, v DOUBLE, vw DOUBLE"


def bars_json(spark: SparkSession, path: str, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily bars of one symbol with ret and log_ret on the adjusted close, within [start, end]; columns that a file
    lacks are null."""
    from tidemark.operators.indicators import with_returns

    df = spark.read.schema(BARS).json(path)
    for bound, op in ((start, ">="), (end, "<=")):
        if bound:
            df = df.where(f"date {op} DATE '{bound}'")
    df = df.select(F.lit(symbol).alias("symbol"), F.col("date").alias("bar_date"), "open", "high", "low", F.col("close").alias("raw_close"), F.col("adjusted_close").alias("close"), "volume").where("bar_date is not null")
    return with_returns(df).withColumnsRenamed({"close": "adj_close", "raw_close": "close"})


def option_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Flat contracts of a nested vendor snapshot."""
    df = spark.read.schema(SNAPSHOT).json(path)
    return df.select(
        "details.ticker", F.col("details.contract_type").alias("kind"), F.col("details.strike_price").alias("strike"), F.to_date("details.expiration_date").alias("exp_date"),
        F.col("implied_volatility").alias("iv"), "greeks.delta", "open_interest", "day.volume", "last_quote.bid", "last_quote.ask",
    )


def option_aggregates(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """Daily bars of one contract, dated from epoch milliseconds in UTC."""
    df = spark.read.schema(AGGREGATES).json(path)
    return df.select(F.lit(ticker).alias("ticker"), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("t") / 86_400_000).cast("int")).alias("date"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"), F.col("vw").alias("vwap"))


def latest_short_volume(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Rows of the last day that has the symbol, from pipe-delimited files with a header."""
    df = spark.read.option("sep", "|").option("header", True).schema("Date STRING, Symbol STRING, ShortVolume DOUBLE, ShortExemptVolume DOUBLE, TotalVolume DOUBLE, Market STRING").csv(path)
    own = df.where(F.col("Symbol") == symbol)
    return own.join(own.agg(F.max("Date").alias("Date")), "Date")


def quote(df: DataFrame) -> DataFrame:
    """Adds price: by market state, before or after hours where that is known, else regular."""
    return df.withColumn("price", F.coalesce(F.when(F.col("state") == "PRE", F.col("pre")), F.when(F.col("state") == "POST", F.col("post")), F.col("regular")))


def saved_documents(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """A JSON object in one text file or in a snapshot, of a version if its number is given, through Spark's readers; empty if it is
    missing or not an object."""
    from pyspark.errors import AnalysisException

    from tidemark.sources import snapshots

    try:
        published = snapshots.read(spark, path, number=number)
        text = (spark.read.text(path, wholetext=True) if published is None else published).first()
        found = json.loads(text["value"]) if text else {}
    except (AnalysisException, json.JSONDecodeError):
        return {}
    return found if isinstance(found, dict) else {}


PLAN = (
    "title STRING, subtitle STRING, date STRING, current_price DOUBLE, portfolio_total DOUBLE, cash_pct DOUBLE, summary STRING, disclaimer STRING, "
    "tranches ARRAY<STRUCT<trigger: STRING, action: STRING, deploy_pct: STRING, deploy_amount: STRING, status: STRING, notes: STRING>>, rules ARRAY<STRUCT<name: STRING, detail: STRING>>, "
    "reserve STRUCT<amount: STRING, pct: STRING, label: STRING, status: STRING, notes: STRING>, probabilities_used ARRAY<STRUCT<scenario: STRING, probability: STRING, source: STRING>>"
)
# The markers around a plan, and what stands for a field that is missing; "" and 0 where none is named
PLAN_MARKS = ("===STRATEGY_START===", "===STRATEGY_END===")
PLAN_DEFAULTS = {"disclaimer": "Not financial advice. Leveraged ETFs can go to zero.", "tranches.status": "WATCH", "reserve.label": "NEVER DEPLOY", "reserve.status": "PERMANENT FLOOR"}


def plans(df: DataFrame, text_col: str = "text", title: str = "ENTRY STRATEGY") -> DataFrame:
    """`df` with plan, the document between the markers of each text, all its fields filled in; null if there is no such document,
    or one without tranches or rules. `title` stands for a missing one; usually it names the asset. Parsing is by a declared schema, field by field; no Python runs."""
    begin, end = map(F.lit, PLAN_MARKS)
    defaults = PLAN_DEFAULTS | {"title": title}
    text = F.col(text_col)
    body = F.when(F.contains(text, begin) & F.contains(text, end), F.split_part(F.split_part(text, begin, F.lit(2)), end, F.lit(1)))
    parsed = F.from_json(body, PLAN)
    kinds = df.sparkSession.createDataFrame([], PLAN).schema

    def filled(value: Column, fields, of: str) -> Column:
        return F.struct(*[F.coalesce(value[f.name], F.lit(defaults.get(f"{of}{f.name}", "" if f.dataType.simpleString() == "string" else 0.0))).alias(f.name) for f in fields])

    def each(value: Column, kind, of: str) -> Column:
        return F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: filled(x, kind.elementType.fields, of))

    columns = []
    for f in kinds.fields:
        value, kind = F.col("_plan")[f.name], f.dataType
        if kind.typeName() == "array":
            columns.append(each(value, kind, f"{f.name}.").alias(f.name))
        elif kind.typeName() == "struct":
            columns.append(filled(value, kind.fields, f"{f.name}.").alias(f.name))
        else:
            columns.append(F.coalesce(value, F.lit(defaults.get(f.name, "" if kind.simpleString() == "string" else 0.0))).alias(f.name))
    whole = (F.size("_plan.tranches") > 0) & (F.size("_plan.rules") > 0)
    return df.withColumn("_plan", parsed).withColumn("plan", F.when(whole, F.struct(*columns))).drop("_plan")


class _Pages(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PagedReader(DataSourceReader):
    """Follows next_url from page to page until there is none. A page that cannot be read fails the job, and so do more
    than `limit` rows: a table is whole or not there."""

    def __init__(self, schema, options: dict):
        self.names = [f.name for f in schema.fields]
        self.urls = [u for u in options.get("path", options.get("url", "")).split(",") if u]
        self.limit = int(options.get("limit", 10_000_000))

    def partitions(self) -> list[InputPartition]:
        return [_Pages(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.request import urlopen

        url, n = partition.url, 0
        while url:
            with urlopen(url, timeout=30) as page:  # noqa: S310 - the caller names the source
                body = json.load(page)
            for row in body.get("results") or []:
                n += 1
                if n > self.limit:
                    raise RuntimeError(f"{partition.url} has more than {self.limit} rows; raise the option limit")
                yield tuple(row.get(k) for k in self.names)
            url = body.get("next_url")


class PagedJson(DataSource):
    """spark.read.format("paged_json").schema(...).load("https://...,https://..."): one task per first page."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "ticker STRING"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
