"""BPE encoding and decoding by tree concatenation, and exact token-length histograms.

Short texts are encoded whole. A text longer than `leaf_chars` is cut into leaves at arbitrary characters; the leaves
are dealt over the cluster and encoded in parallel; then neighbours are joined pairwise up a tree. At each join a
window around the seam is encoded again and grown until its first and last tokens agree exactly with the tokens that
the two sides have there. The windows begin and end where a non-space character meets a space: no pre-token can cross
such a place, whatever stands around it, so the joined ids are those of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

SPECIAL = "<|endoftext|>"
SEAM = re.compile(r"(?<=\S)[ \n]")
LEAF_CHARS = 16_384
#: White space that the engine of pre-tokens cannot look ahead over. Characters of Unicode's White_Space.
SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{32768,}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Codec:
    """Byte-level BPE over a rank file; `SPECIAL` in a text is its own token, as the tokenizers library has it."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special_id = max(ranks.values()) + 1
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: self.special_id})
        self.n_bytes = np.zeros(self.special_id + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        self.n_bytes[self.special_id] = len(SPECIAL)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. In a very long run of white space all but its last character are one pre-token, all of it at the
        end of the text or before `SPECIAL`; such runs are cut out and merged as one piece, what is between them as ever."""
        if len(text) >= 32768 and SPACE_RUN.search(text):
            ids: list[np.ndarray] = []
            for k, part in enumerate(text.split(SPECIAL)):
                if k:
                    ids.append(np.array([self.special_id], np.uint32))
                at = 0
                for m in SPACE_RUN.finditer(part):
                    end = m.end() - (m.end() < len(part))
                    ids += [self._plain(part[at : m.start()]), np.array(self.bpe._encode_single_piece(part[m.start() : end]), np.uint32)]
                    at = end
                ids.append(self._plain(part[at:]))
            return np.concatenate(ids)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return self.bpe.encode_to_numpy(text, disallowed_special=())
        return self.bpe.encode_to_numpy(text, allowed_special={SPECIAL}, disallowed_special=())

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], window: int = 64) -> tuple[str, np.ndarray]:
        """The encoding of two neighbouring texts, from each one's own."""
        (lt, li), (rt, ri) = left, right
        ends, starts = np.cumsum(self.n_bytes[li][::-1]), np.cumsum(self.n_bytes[ri])
        while True:
            a = b = None
            if window < len(lt):
                for m in SEAM.finditer(lt, max(0, len(lt) - 2 * window), len(lt) - window):
                    a = m.start()
            if window < len(rt) and (m := SEAM.search(rt, window, min(len(rt), 2 * window))):
                b = m.start()
            whole = window >= len(lt) and window >= len(rt)
            a, b = (0 if window >= len(lt) else a), (len(rt) if window >= len(rt) else b)
            if a is not None and b is not None:
                mid = self.encode(lt[a:] + rt[:b])
                if whole:
                    return lt + rt, mid
                k = int(np.searchsorted(ends, len(lt[a:].encode())))
                n = int(np.searchsorted(starts, len(rt[:b].encode())))
                agree_left = a == 0 or (ends[k] == len(lt[a:].encode()) and len(mid) and mid[0] == li[len(li) - k - 1])
                agree_right = b == len(rt) or (starts[n] == len(rt[:b].encode()) and len(mid) and mid[-1] == ri[n])
                if agree_left and agree_right:
                    return lt + rt, np.concatenate([li[: 0 if a == 0 else len(li) - k - 1], mid, ri[len(ri) if b == len(rt) else n + 1 :]])
            window *= 2

    def tree(self, leaves: list[tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
        """Joins neighbours level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]


@lru_cache(maxsize=4)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def _digest(c: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row's whole text; for callers that want the tokens themselves."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.encode(t).astype(np.int32) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row for each input row: id, n_tokens, ids_sha256, decoded_sha256 of its whole text.

    Null text counts as empty (no tokens). Repeated rows and ids give repeated results; the id may be null. Equal long
    texts are encoded once. Other columns of the input are left out, so their names cannot clash.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = dict(df.dtypes)[id_col]
    short = rows.where(F.length("text") <= leaf_chars)
    long = rows.where(F.length("text") > leaf_chars).select("id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("key"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            n, ids, text = zip(*[_digest(c, c.encode(t)) for t in batch.column(1).to_pylist()], strict=True) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                piece = [text[i : i + leaf_chars] for i in range(0, len(text), leaf_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(piece)), pa.array(range(len(piece)), pa.int32()), pa.array(piece)], ["key", "at", "piece"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids = [c.encode(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["key", "at", "piece", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        c = codec(vocabulary)
        leaves = sorted(zip(group["at"].to_pylist(), group["piece"].to_pylist(), group["ids"].to_pylist(), strict=True))
        _, ids = c.tree([(t, np.frombuffer(i, dtype="<u4")) for _, t, i in leaves])
        n, a, b = _digest(c, ids)
        return pa.table({"key": pa.array([group["key"][0].as_py()], pa.string()), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})

    digests = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    pieces = long.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(cut, "key string, at int, piece string")
    of_long = pieces.repartition("key", "at").mapInArrow(leaf, "key string, at int, piece string, ids binary").groupBy("key").applyInArrow(joined, f"key string, {digests}")
    out = short.mapInArrow(whole, f"id {kind}, {digests}").unionByName(long.select("id", "key").join(of_long, "key").drop("key"))
    return out.withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(id, n_tokens) of every row's whole text, long ones up the tree as in `encode_digests`; null text has none."""
    return encode_digests(df, id_col, text_col, vocabulary, leaf_chars).select(id_col, "n_tokens")


def length_histogram(counts: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(length, n_docs): documents of each encoded length, pre-aggregated before the shuffle."""
    return counts.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def length_table(histogram: DataFrame, block: int = 256) -> DataFrame:
    """What every context limit keeps, from an exact length histogram.

    For each length that occurs, taken as a context limit: docs_upto and tokens_upto (documents no longer than it),
    docs_over (longer ones), truncated_tokens (sum of min(length, limit)), total_docs, total_tokens, and cdf (share of
    documents no longer: the smallest length with cdf >= q is the q-quantile). Suffix sums are taken in two levels, in
    blocks of `block` lengths and over the blocks; one task sees all blocks, of which there are as many as the longest
    text has tokens / `block`. The histogram is read more than once: write it first. An empty one gives an empty table.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / block))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    over = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.select("block", "length", "n_docs", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("d"), F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(inside), F.lit(0)).alias("t"))
    h = h.join(blocks, "block").withColumn("docs_over", F.col("d") + F.col("d_after")).withColumn("tokens_over", F.col("t") + F.col("t_after"))
    docs_upto, tokens_upto = F.col("total_docs") - F.col("docs_over"), F.col("total_tokens") - F.col("tokens_over")
    return h.select("length", "n_docs", docs_upto.alias("docs_upto"), "docs_over", tokens_upto.alias("tokens_upto"), (tokens_upto + F.col("length") * F.col("docs_over")).alias("truncated_tokens"), "total_docs", "total_tokens", (docs_upto / F.col("total_docs")).alias("cdf"))


def length_quantiles(lengths: DataFrame, qs: list[float]) -> DataFrame:
    """(q, length): the smallest length with at least a share q of the documents."""
    q = F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q")
    return lengths.select("length", "cdf", q).where("cdf >= q").groupBy("q").agg(F.min("length").alias("length"))


def truncated_total(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens): tokens left when every document is cut to a context limit, whether or not the length occurs."""
    limit = F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("limit")
    over = F.when(F.col("length") > F.col("limit"), F.col("n_docs"))
    upto = F.when(F.col("length") <= F.col("limit"), F.col("n_docs") * F.col("length"))
    return lengths.select("length", "n_docs", limit).groupBy("limit").agg((F.coalesce(F.sum(upto), F.lit(0)) + F.col("limit") * F.coalesce(F.sum(over), F.lit(0))).alias("tokens"))
