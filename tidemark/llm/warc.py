"""WARC archives: written as text parts, read back in blocks by boundary-chain verification.

Every task cuts its block of a file at each magic; what looks like a record there, inside a payload or not, emits its
offset and, by its Content-Length, its successor's. In a block the offsets are followed to where they leave it, so that
what is left is a chain of at most one entry a block. Pointer jumping from the file's start finds the entries reached;
each block is then walked from its own. Magic that lies in a payload is never reached.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, forget, shared_dir, table

MAGIC, END = "WARC/1.", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored in full.
LEAST_BYTES = 1000
#: Repeated payloads, at 28 bytes each, whose responses are broadcast.
BROADCAST_REPEATS = 500_000
#: Bytes of the cells in which pieces meet the record that covers them.
CELL = 1 << 16


def payload(col: str | Column = "html") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field that is null is left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")), F.lit("")) for k, v in fields))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record): one WARC record per page, without the blank lines that end it.

    Of pages with equal payloads of `least` bytes or more, that with the largest id is a response, the others revisit it;
    of rows that repeat that id and payload one is the response. Smaller payloads and pages without an id are responses.
    Null html is an empty payload; a null url has no target line, line ends in a url are percent-encoded.
    """
    spark = pages.sparkSession
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload(html_col).alias("body")).withColumn("digest", F.unhex(F.sha1("body"))).withColumn("size", F.octet_length("body"))
    light = table(rows.select("id", "url", "digest", "size", F.monotonically_increasing_id().alias("row")))
    able = (F.col("size") >= least) & F.col("id").isNotNull()
    repeats = light.where(able).groupBy("digest").agg(F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("copies")).where("copies > 1")
    repeats = table(repeats.select("digest", F.col("last.id").alias("to"), F.col("last.row").alias("row_kept")))
    few = repeats.count() <= BROADCAST_REPEATS
    repeats = F.broadcast(repeats) if few else repeats
    revisits = light.where(able).join(repeats, "digest").where("row <> row_kept")
    judged = rows.join(repeats.select("digest", "to"), "digest", "left")
    single = judged.where(F.col("to").isNull() | ~F.coalesce(able, F.lit(False))).select("id", "url", "body", "digest")
    kept = judged.where(able & (F.col("id") == F.col("to"))).groupBy("id", "digest").agg(F.min(F.struct("url", "body")).alias("x")).select("id", "x.url", "x.body", "digest")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    digest = F.concat(F.lit("sha1:"), F.lower(F.hex("digest")))
    common = [("WARC-Record-ID", name("id")), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", digest)]
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    whole = F.concat(
        F.lit(f"{MAGIC}1\r\n"), _lines(("WARC-Type", F.lit("response")), *common, kind, ("Content-Length", F.octet_length("body") + len(HTTP))), F.lit("\r\n" + HTTP), F.col("body").cast("string")
    )
    # the payload's length is an extension field, as a revisit has no payload of its own
    again = F.concat(
        F.lit(f"{MAGIC}1\r\n"), _lines(("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", name("to")), ("X-Payload-Length", F.col("size")), kind, ("Content-Length", F.lit(len(HTTP)))),
        F.lit("\r\n" + HTTP),
    )
    return single.unionByName(kept).select(whole.alias("record")).unionByName(revisits.select(again.alias("record")))


def write(pages: DataFrame, path: str, **options: object) -> None:
    """Archive parts under `path`, one a task; a part that a lost task has begun is never committed."""
    records(pages, **options).write.option("lineSep", END).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1)
    return F.when(found != "", found)


def _chunks(spark: SparkSession, paths: list[str], keep_all: bool) -> DataFrame:
    """What lies between one magic and the next in each block, in the order of the file, with the record it would begin.

    `loose` chunks are not whole records by themselves; they keep their bytes, others only with `keep_all`.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", MAGIC).text(paths).select(meta["file_path"].alias("file"), meta["file_size"].alias("file_size"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    raw = raw.withColumn("size", F.octet_length("value").cast("long")).withColumn("head", F.substring_index("value", END, 1)).withColumn("n_head", F.octet_length("head"))
    asked = F.when(F.col("head").rlike("^[01]\r\n") & (F.col("n_head") < F.col("size")), F.regexp_extract("head", r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1))
    raw = raw.withColumn("asked", F.when(asked != "", asked.cast("long"))).withColumn("needs", F.lit(len(MAGIC)) + F.col("n_head") + len(END) + F.col("asked") + len(END))
    loose = F.coalesce(F.col("needs") != F.col("size") + len(MAGIC), F.lit(True))
    body = _body(F.col("value").cast("binary"), F.col("head"), F.col("n_head"), F.col("asked"))
    raw = raw.withColumn("loose", loose).withColumn("body", F.when(~F.col("loose"), body))
    held = F.when(F.lit(True) if keep_all else F.col("loose"), F.col("value"))
    return table(raw.select("file", "file_size", "block", "i", "size", "needs", "loose", F.when(F.col("needs").isNotNull(), F.col("head")).alias("head"), F.octet_length("body").alias("n_body"), F.sha1("body").alias("sha1"), held.alias("value")))


def _body(data: Column, head: Column, n_head: Column, asked: Column) -> Column:
    """The payload in the bytes after a magic: the block, without the HTTP header where there is one."""
    block = F.substring(data, n_head + len(END) + 1, asked.cast("int"))
    http = F.coalesce(F.lower(_field(head, "Content-Type")).startswith("application/http"), F.lit(False))
    text = block.cast("string")
    n_http = F.octet_length(F.substring_index(text, END, 1)) + len(END) + 1
    return F.when(http, F.substring(block, n_http, F.greatest(F.lit(0), F.octet_length(block) - n_http + 1))).otherwise(block)


def _exits(group: pa.Table) -> pa.Table:
    """For each candidate of a block, the first offset outside that its chain leads to."""
    at, nxt = group["at"].to_numpy(), group["next"].to_numpy()
    order = np.argsort(at, kind="stable")
    at, nxt = at[order], nxt[order]
    where = np.searchsorted(at, nxt)
    inside = (where < len(at)) & (at[np.minimum(where, len(at) - 1)] == nxt)
    out = nxt.copy()
    for k in np.nonzero(inside)[0][::-1].tolist():  # successors lie behind, so theirs are known
        out[k] = out[where[k]]
    return pa.table({"file": pa.array([group["file"][0].as_py()] * len(at)), "block": pa.array(np.full(len(at), group["block"][0].as_py(), np.int64)), "at": pa.array(at), "next": pa.array(nxt), "exit": pa.array(out)})


def _walked(group: pa.Table) -> pa.Table:
    """The candidates of a block that its entry leads to."""
    at, nxt, pos = group["at"].to_numpy(), group["next"].to_numpy(), group["entry"][0].as_py()
    follow, kept = dict(zip(at.tolist(), nxt.tolist(), strict=True)), []
    while pos in follow:
        kept.append(pos)
        pos = follow[pos]
    return pa.table({"file": pa.array([group["file"][0].as_py()] * len(kept), pa.string()), "at": pa.array(kept, pa.int64())})


def _reached(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(file, at) of the candidates that lie on the chain from the file's start."""
    edges = table(candidates.select("file", "block", "at", "next").groupBy("file", "block").applyInArrow(_exits, "file string, block bigint, at bigint, next bigint, exit bigint"))
    entries = edges.select("file", F.col("exit").alias("at")).unionByName(files.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    jump = cut(edges.join(entries, ["file", "at"]).select("file", "at", F.col("exit").alias("to")))
    reached = cut(jump.where("at = 0").select("file", "at"))
    known = reached.count()
    while True:  # twice as many entries each round
        onward = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reached = cut(reached.unionByName(onward).distinct())
        now = reached.count()
        if now == known:
            break
        known = now
        ahead = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = cut(jump.join(ahead, ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")))
    starts = edges.join(reached, ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"))
    return edges.join(starts, ["file", "block"]).select("file", "block", "at", "next", "entry").groupBy("file", "block").applyInArrow(_walked, "file string, at bigint")


def read(spark: SparkSession, path: str | list[str], payloads: bool = True) -> DataFrame:
    """Records of uncompressed WARC files: file, offset, type, record_id, uri, date, declared_digest, refers_to, n_bytes, sha1, full_length,
    and payload where `payloads` asks for it.

    Files are read in blocks, each by any task. A file whose start is no record has no records; the chain ends at the file's
    end or at the first place that is no record, as one that is cut off. Null fields are absent ones. Offsets are bytes. A block's candidates are one group,
    a record's pieces another; both are bounded, by the block's and the record's size.
    """
    paths = [path] if isinstance(path, str) else path
    chunks = _chunks(spark, paths, payloads)
    step = F.col("size") + len(MAGIC)
    blocks = chunks.groupBy("file", "block").agg(F.sum(step).alias("n"), F.max("file_size").alias("file_size"))
    blocks = table(blocks.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(MAGIC)))
    torn = blocks.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("n"), F.max("file_size").alias("file_size")).where("n <> file_size")
    if not torn.isEmpty():
        raise RuntimeError(f"blocks do not add up to their file: {torn.first()}")
    local = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = table(chunks.select("file", "block", "i", "size", "needs", "loose", local.alias("local")).join(blocks.select("file", "block", "start", "file_size"), ["file", "block"]).select("file", "block", "i", "needs", "loose", (F.col("start") + F.col("local")).alias("at"), "file_size"))
    candidates = placed.where("needs is not null and at >= 0 and at + needs <= file_size").withColumn("next", F.col("at") + F.col("needs"))
    valid = table(_reached(candidates, blocks.select("file").distinct()))
    held = placed.join(valid, ["file", "at"], "left_semi")
    inside = placed.where("not loose").join(valid, ["file", "at"], "left_anti")
    if not payloads:
        # a payload that holds whole records: its file is read again with all bytes
        nested = [r["file"] for r in inside.select("file").distinct().collect()]
        if nested:
            rest = [f for f in (r["file"] for r in blocks.select("file").distinct().collect()) if f not in set(nested)]
            again = read(spark, nested, True).drop("payload")
            return again.unionByName(read(spark, rest, False)) if rest else again
    chosen = chunks.join(held.select("file", "block", "i", "at", F.col("needs").alias("whole")), ["file", "block", "i"])
    simple = chosen.where("not loose").select("file", "at", "head", F.col("n_body").alias("n_bytes"), "sha1", *([_body(F.col("value").cast("binary"), F.col("head"), F.octet_length("head"), _length(F.col("head"))).alias("payload")] if payloads else []))
    split = chosen.where("loose").select("file", "at", "head", "whole")
    long = table(split.select("file", F.col("at").alias("of"), (F.col("at") + F.col("whole")).alias("until"), "head"))
    if not long.isEmpty():
        spans = long.select("file", "of", "until", F.explode(F.sequence(F.floor(F.col("of") / CELL), F.floor((F.col("until") - 1) / CELL))).alias("cell"))
        pieces = placed.withColumn("cell", F.floor(F.col("at") / CELL)).join(spans, ["file", "cell"]).where("at >= of and at < until")
        pieces = pieces.select("file", "block", "i", "at", "of").join(chunks.select("file", "block", "i", "value"), ["file", "block", "i"])
        joined = pieces.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x")).select("file", "of", F.array_join(F.transform("x", lambda p: p["value"]), MAGIC).alias("value"))
        joined = joined.join(long, ["file", "of"]).withColumn("payload", _body(F.col("value").cast("binary"), F.col("head"), F.octet_length("head"), _length(F.col("head"))))
        wide = joined.select("file", F.col("of").alias("at"), "head", F.octet_length("payload").alias("n_bytes"), F.sha1("payload").alias("sha1"), *(["payload"] if payloads else []))
        simple = simple.unionByName(wide)
    head = F.col("head")
    return simple.select(
        "file", F.col("at").alias("offset"), _field(head, "WARC-Type").alias("type"), _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Target-URI").alias("uri"), _field(head, "WARC-Date").alias("date"),
        _field(head, "WARC-Payload-Digest").alias("declared_digest"), _field(head, "WARC-Refers-To").alias("refers_to"), "n_bytes", "sha1", _field(head, "X-Payload-Length").cast("long").alias("full_length"), *(["payload"] if payloads else []),
    )


def _length(head: Column) -> Column:
    return F.regexp_extract(head, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from archives written and read back.

    See `records` for nulls, repeats and small payloads; an empty table gives an empty result, extra columns are left out.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    revisit = F.col("type") == "revisit"
    declared = F.substring_index("declared_digest", ":", -1)
    sound = F.when(revisit | (declared == F.col("sha1")), declared).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id"))).cast("string"))
    found = read(spark, path, payloads=False).select(number("record_id").alias("page_id"), F.when(revisit, F.col("full_length")).otherwise(F.col("n_bytes").cast("long")).alias("payload_bytes"), sound.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    found = table(found)
    forget(spark, path)
    return found
