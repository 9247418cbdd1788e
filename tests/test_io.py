import datetime
import json

import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tidemark.sources import files, sinks, views
from tidemark.streaming import event_bars


def test_stream_equals_batch(spark, sf, tmp_path):
    events = views.read(spark, sf, "events")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    for name, make in (("tumbling", event_bars.tumbling), ("sessions", event_bars.sessions)):
        stream = make(event_bars.read_stream(spark, str(tmp_path / "in")), delay="60 days")
        event_bars.replay(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"), "append")
        got = spark.read.schema(make(events).schema).parquet(str(tmp_path / name))
        want = make(events)
        # windows that the watermark has not closed are not out yet; what is out is what the batch has
        assert got.join(want, want.columns[:2], "left_anti").count() == 0


def test_late_rows_do_not_change_closed_windows(spark, tmp_path):
    row = lambda i, d, v: (i, datetime.datetime(2024, 1, d, 12), 1, "a", float(v), "{}")
    for k, rows in enumerate(([row(1, 1, 5), row(2, 1, 7)], [row(3, 9, 1)], [row(4, 1, 100)], [row(5, 20, 1)])):
        spark.createDataFrame(rows, event_bars.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        event_bars.replay(event_bars.tumbling(event_bars.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    first = spark.read.parquet(str(tmp_path / "out")).where("day = '2024-01-01'").collect()
    assert [(r["high"], r["n"]) for r in first] == [(7.0, 2)]


def test_vendor_files(spark, tmp_path):
    (tmp_path / "bars.json").write_text("\n".join(json.dumps({"date": f"2024-01-0{d}", "close": 10 * d, "adjusted_close": 5 * d}) for d in (3, 1, 2)))
    got = files.bars_json(spark, str(tmp_path / "bars.json"), "x", start="2024-01-01").orderBy("bar_date").collect()
    assert [r["adj_close"] for r in got] == [5.0, 10.0, 15.0] and got[1]["ret"] == pytest.approx(1.0) and got[0]["open"] is None
    (tmp_path / "snap.json").write_text(json.dumps({"details": {"ticker": "T", "contract_type": "call", "strike_price": 5, "expiration_date": "2024-02-16"}, "last_quote": {"bid": 1.5}}))
    r = files.option_snapshot(spark, str(tmp_path / "snap.json")).first()
    assert (r["ticker"], r["kind"], r["exp_date"], r["bid"], r["ask"], r["delta"]) == ("T", "call", datetime.date(2024, 2, 16), 1.5, None, None)
    (tmp_path / "agg.json").write_text(json.dumps({"t": 1704153600000, "o": 1, "c": 2, "vw": 1.5}))
    assert files.option_aggregates(spark, str(tmp_path / "agg.json"), "T").first()["date"] == datetime.date(2024, 1, 2)
    (tmp_path / "short").mkdir()
    for d, symbol in (("20240101", "X"), ("20240102", "X"), ("20240103", "Y")):
        (tmp_path / "short" / f"{d}.txt").write_text(f"Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market\n{d}|{symbol}|5|0|9|Q\n")
    assert [r["Date"] for r in files.latest_short_volume(spark, str(tmp_path / "short"), "X").collect()] == ["20240102"]


def test_paged_source(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"results": [{"ticker": "A"}, {"ticker": "B"}], "next_url": f"file://{tmp_path}/p2.json"}))
    (tmp_path / "p2.json").write_text(json.dumps({"results": [{"ticker": "C"}]}))
    files.register(spark)
    got = spark.read.format("paged_json").schema("ticker string").option("url", f"file://{tmp_path}/p1.json,file://{tmp_path}/p2.json").load()
    assert sorted(r["ticker"] for r in got.collect()) == ["A", "B", "C", "C"]
    for wrong in ({"url": f"file://{tmp_path}/none.json"}, {"url": f"file://{tmp_path}/p1.json", "limit": 2}):  # no silent part of a table
        with pytest.raises(Exception, match="none.json|more than 2 rows"):
            spark.read.format("paged_json").schema("ticker string").options(**wrong).load().collect()


def test_aggregates_are_dated_in_utc(spark, tmp_path):
    (tmp_path / "agg.json").write_text(json.dumps({"t": 1704067200000, "o": 1, "c": 2, "vw": 1.5}))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert files.option_aggregates(spark, str(tmp_path / "agg.json"), "T").first()["date"] == datetime.date(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_quote_by_state(spark):
    df = spark.createDataFrame([("PRE", 1.0, 2.0, 3.0), ("POST", 1.0, None, 3.0), ("OPEN", 1.0, 2.0, 3.0)], "state string, pre double, post double, regular double")
    assert [r["price"] for r in files.quote(df).collect()] == [1.0, 3.0, 3.0]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.5, None), ("b", 2.0, "x")], "series string, value double, note string")
    assert sinks.report_csv(df) == "series,value,note\na,1.5,\nb,2.0,x\n"
    assert "a       1.5000" in sinks.report_text(df, "Title", {"k": 1}) and "| a | 1.5 |  |" in sinks.report_markdown(df, "T")
    assert json.loads(sinks.report_json(df, "T"))["rows"][1]["note"] == "x"
    assert sinks.safe_filename("Fall 5% / x!") == "Fall_5____x" and sinks.safe_filename("///") == "backtest"
    with pytest.raises(ValueError):
        sinks.report_csv(spark.range(sinks.REPORT_ROWS + 1))


def test_audit_and_store(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS audit LOCATION '{tmp_path}/audit'")
    spark.sql("USE audit")
    try:
        sinks.create_audit(spark)
        for n in range(3):
            sinks.append_audit(spark, "diagnostic_runs", {"run_at": datetime.datetime(2024, 1, 1 + n), "passed": n, "checks": [{"name": "x"}]})
        assert [r["passed"] for r in sinks.recent_rows(spark, "diagnostic_runs", 2).collect()] == [2, 1]
        with pytest.raises(ValueError):
            sinks.recent_rows(spark, "diagnostic_runs; drop", 2)
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE audit CASCADE")
    path = str(tmp_path / "store")
    assert files.saved_documents(spark, path) == {}
    sinks.save_strategy(spark, path, "a", {"x": 1})
    assert set(sinks.save_strategy(spark, path, "b", {})) == {"a", "b"} and set(sinks.delete_strategy(spark, path, "a")) == {"b"}
    assert set(files.saved_documents(spark, path)) == {"b"}


def test_filters_reach_the_scan(spark, sf):
    plan = views.bars(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_orderkey" not in plan.split("ReadSchema")[-1]
    assert views.read(spark, sf, "orders").where(F.col("o_orderdate") >= "1997-01-01").count() == len(spark_rows(views.read(spark, sf, "orders").where("o_orderdate >= '1997-01-01'").select("o_orderkey"))[1])
