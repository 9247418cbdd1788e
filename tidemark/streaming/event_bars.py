"""Bars and sessions of an event stream, by the same functions for batch and stream.

A stream is watermarked first; late rows beyond it are dropped by Spark, and state is kept per window or session only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Open, high, low, close, count and volume by event type and window; first and last go by (ts, event_id)."""
    order = F.struct("ts", "event_id")
    out = _late(events, delay).groupBy("event_type", F.window("ts", width).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"), F.sum("value").alias("volume")
    )
    return out.select("event_type", F.col("w.start").alias("day"), "open", "high", "low", "close", "n", "volume")


def sliding(events: DataFrame, width: str = "1 day", slide: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    out = _late(events, delay).groupBy("event_type", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select("event_type", F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, idle: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    out = _late(events, delay).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return out.select("user_id", F.col("first").alias("start"), "last", "n")


class OrderedMean(StatefulProcessor):
    """Exponentially weighted mean of one key's events in event-time order, whatever order they come in.

    Events wait in state until the watermark has passed them, so none that may still come belongs before them; then they
    are taken by (ts, event_id). Rows later than the watermark are dropped. A key whose last event is `idle` seconds
    behind the watermark is forgotten; its next event begins anew.
    """

    def __init__(self, alpha: float, idle: float):
        self.alpha, self.idle = alpha, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "ema double, last bigint")
        self.waiting = handle.getListState("waiting", "ms bigint, event_id bigint, ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802 - names of the interface
        mark = timerValues.getCurrentWatermarkInMs()
        latest = None
        for r in rows:
            ms = int(r["ts"].timestamp() * 1000) if r["ts"] is not None else None
            if ms is None or r["value"] is None or ms < mark:
                continue
            self.waiting.appendValue((ms, r["event_id"], r["ts"], r["value"]))
            latest = ms if latest is None else max(latest, ms)
        if latest is not None:
            self.handle.registerTimer(latest + 1)
            self.handle.registerTimer(latest + self.idle)
        yield from self._settle(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, mark: int) -> Iterator[Row]:
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        ema, last = self.mean.get() if self.mean.exists() else (None, None)
        for ms, _, ts, value in ready:
            if last is not None and ms - last >= self.idle:
                ema = None
            ema, last = value if ema is None else (1 - self.alpha) * ema + self.alpha * value, ms
            yield Row(event_type=key[0], ts=ts, ema=ema)
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            self.mean.update((ema, last))
        if not rest and last is not None and mark - last >= self.idle:
            self.mean.clear()

    def close(self) -> None:
        pass


def running_ema(events: DataFrame, span: int = 20, delay: str = "1 hour", idle: float = 30 * 86400.0) -> DataFrame:
    """Stream of (event_type, ts, ema) in event-time order: each event comes out once the watermark, `delay` behind the newest, has
    passed it. State is one mean and the events that wait; see OrderedMean. It needs the RocksDB state store."""
    out = events.withWatermark("ts", delay).groupBy("event_type")
    return out.transformWithState(OrderedMean(2 / (span + 1), idle), "event_type string, ts timestamp, ema double", "append", "EventTime")


def replay(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run all that is available of a stream into a Parquet sink, exactly once per checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def replay_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run all that is available of a stream, each micro-batch into a folder of its own under `path`.

    A batch that is run again after a failure replaces its folder, so the table has every row once although a batch may be
    written more than once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
