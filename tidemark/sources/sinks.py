"""Sinks: reports of small result tables, audit tables, saved strategies."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import snapshots

AUDIT = {
    "diagnostic_runs": "run_at TIMESTAMP, passed INT, failed INT, skipped INT, checks STRING",
    "review_sessions": "run_at TIMESTAMP, persona STRING, goal STRING, transcript STRING",
    "qc_results": "run_at TIMESTAMP, title STRING, sound BOOLEAN, ai_prob DOUBLE, verdict STRING, evidence STRING",
}
#: A report is a table to read; larger results are written by Spark.
REPORT_ROWS = 10_000


def safe_filename(title: str) -> str:
    return re.sub(r"[^\w-]", "_", title, flags=re.UNICODE).strip("_") or "backtest"


def rows_of(df: DataFrame) -> tuple[list[str], list[list]]:
    """Header and rows of a result of at most REPORT_ROWS rows; more is an error, not a cut."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write the DataFrame instead")
    return df.columns, [["" if v is None else v for v in r] for r in rows]


def report_text(df: DataFrame, title: str, params: dict | None = None, method: str = "") -> str:
    names, rows = rows_of(df)
    cells = [names, *[[f"{v:,.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(names))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip()
    head = [title, "=" * len(title), *(f"{k}: {v}" for k, v in (params or {}).items()), *([method] if method else []), ""]
    return "\n".join([*head, line(cells[0]), "  ".join("-" * w for w in width), *map(line, cells[1:])]) + "\n"


def report_csv(df: DataFrame) -> str:
    names, rows = rows_of(df)
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([names, *rows])
    return out.getvalue()


def report_markdown(df: DataFrame, title: str) -> str:
    names, rows = rows_of(df)
    return "\n".join([f"# {title}", "", f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *[f"| {' | '.join(map(str, r))} |" for r in rows]]) + "\n"


def report_json(df: DataFrame, title: str) -> str:
    names, rows = rows_of(df)
    return json.dumps({"title": title, "run_at": datetime.now(UTC).isoformat(), "rows": [dict(zip(names, r, strict=True)) for r in rows]}, default=str)


def write_parts(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Results of any size, in parts."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def create_audit(spark: SparkSession) -> None:
    for name, columns in AUDIT.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING PARQUET")


def append_audit(spark: SparkSession, table: str, row: dict) -> None:
    """One audit row, with its nested values as JSON; run_at is now unless it is given."""
    if table not in AUDIT:
        raise ValueError(f"{table!r} is not an audit table")
    values = {"run_at": datetime.now(UTC).replace(tzinfo=None)} | {k: json.dumps(v, default=str) if isinstance(v, (dict, list)) else v for k, v in row.items()}
    names = [c.split()[0] for c in AUDIT[table].split(", ")]
    spark.createDataFrame([tuple(values.get(n) for n in names)], AUDIT[table]).write.insertInto(table)


def recent_rows(spark: SparkSession, table: str, limit: int = 10) -> DataFrame:
    if table not in AUDIT:
        raise ValueError(f"{table!r} is not an audit table")
    return spark.table(table).orderBy(F.desc("run_at")).limit(limit)


def save_strategies(spark: SparkSession, path: str, store: dict, after: int | None = None) -> None:
    """The whole store as one JSON text in a new version of its snapshot; a reader has the old one or the new one."""
    snapshots.publish(spark.createDataFrame([(json.dumps(store, default=str),)], "value string").coalesce(1), path, after)


def _change(spark: SparkSession, path: str, change: Callable[[dict], dict], tries: int = 20) -> dict:
    """Apply a change to the store that is current; if another writer is first, to theirs."""
    from tidemark.sources.files import saved_documents

    for _ in range(tries):
        found = snapshots.current(spark, path)
        store = change(saved_documents(spark, path, found.number if found else None))
        try:
            save_strategies(spark, path, store, found.number if found else 0)
        except snapshots.Conflict:
            continue
        return store
    raise snapshots.Conflict(f"{path} changed {tries} times meanwhile")


def save_strategy(spark: SparkSession, path: str, name: str, config: dict, version: int = 1) -> dict:
    entry = {"config": config, "signal_version": version, "saved_at": datetime.now(UTC).isoformat()}
    return _change(spark, path, lambda store: store | {name: entry})


def delete_strategy(spark: SparkSession, path: str, name: str) -> dict:
    return _change(spark, path, lambda store: {k: v for k, v in store.items() if k != name})
