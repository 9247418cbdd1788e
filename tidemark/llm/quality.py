"""Compression classifier: text is scored by how much better a dictionary of good text compresses it than one of bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_or_empty

#: Bound of the fit: labelled rows of each class that are used, whole. Scoring has no bound.
FIT_ROWS_PER_CLASS = 3000
#: Bytes that are compressed at a time.
CHUNK = 1024
LEVEL = 9


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic calibration of the size difference that they give."""

    good: bytes
    bad: bytes
    bias: float
    weight: float

    def score(self, text: str) -> float:
        """Calibrated probability of label 1; 0 for an empty text."""
        if not text:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight * size_difference(text, self.good, self.bad), -30, 30))))


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    if d is not None:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


_at_hand: dict[int, tuple[bytes, zstandard.ZstdCompressor]] = {}


def _ready(dictionary: bytes) -> zstandard.ZstdCompressor:
    """The compressor of a dictionary by its identity; a task's own copy of one is compared with what is known only once."""
    found = _at_hand.get(id(dictionary))
    if found is None or found[0] is not dictionary:
        if len(_at_hand) >= 8:
            _at_hand.clear()
        found = _at_hand[id(dictionary)] = dictionary, _compressor(dictionary)
    return found[1]


def size_difference(text: str, good: bytes, bad: bytes) -> float:
    """How much smaller the dictionary of good text makes a whole text than the one of bad text, normalised.

    The text is compressed in chunks, each against the fresh dictionary, so that a long text is judged like a short one.
    The difference of a byte is multiplied by the root of the size, up to a chunk: that of its noise falls as this grows.
    """
    raw = text.encode("utf-8", "replace")
    g, b = _ready(good), _ready(bad)
    difference = sum(len(b.compress(raw[i : i + CHUNK])) - len(g.compress(raw[i : i + CHUNK])) for i in range(0, len(raw), CHUNK))
    return difference / len(raw) * min(len(raw), CHUNK) ** 0.5


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0 if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = FIT_ROWS_PER_CLASS) -> Model:
    """Train on labelled rows that are not held out.

    At most `rows_per_class` rows of each class, the first by hash of id, are used, their texts whole: in the order of ids, even
    ones are put together as the class's dictionary, odd ones calibrate. To the driver come the texts of the dictionaries,
    whose number is bounded, and one number of each odd row, computed in tasks. Rows with null id, label or
    text are passed over; an id labelled twice takes its lower label. With fewer than eight rows of a class the score is
    the base rate.
    """
    label = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    rows = df.where(~held_out(id_col) & F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = table(rows.select("id").distinct().join(label, "id"))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows_per_class) for y in (0, 1)]
    # two classes of `rows_per_class` ids at most: a window and a broadcast of bounded size
    turn = (F.row_number().over(Window.partitionBy("y").orderBy("id")) - 1) % 2
    picked = first[0].unionByName(first[1]).withColumn("odd", turn == 1)
    # a row that repeats an id with other text: the least text counts
    chosen = table(rows.join(F.broadcast(picked), "id").groupBy("id", "y", "odd").agg(F.min("text").alias("text")))
    sizes = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if min(sizes.get(y, 0) for y in (0, 1)) < 8:
        rate = (sizes.get(1, 0) + 1) / (n + 2)
        return Model(b"", b"", float(np.log(rate / (1 - rate))), 0.0)
    gathered: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(chosen.where("not odd").select("id", "y", "text").collect(), key=lambda r: r["id"]):
        gathered[r["y"]].append(r["text"].encode("utf-8", "replace"))
    dictionaries = {y: b"".join(parts) for y, parts in gathered.items()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [size_difference(t, dictionaries[1], dictionaries[0]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(x, pa.float64())], ["id", "y", "x"])

    y_type = chosen.schema["y"].dataType.simpleString()
    id_type = chosen.schema["id"].dataType.simpleString()
    pairs = sorted(chosen.where("odd").select("id", "y", "text").mapInArrow(measured, f"id {id_type}, y {y_type}, x double").collect(), key=lambda r: (r["y"], r["id"]))
    x = np.array([r["x"] for r in pairs])
    mean, scale = x.mean(), x.std() + 1e-9
    bias, weight = _logistic(np.column_stack([np.ones(len(x)), (x - mean) / scale]), np.array([r["y"] for r in pairs], dtype=float))
    return Model(dictionaries[1], dictionaries[0], float(bias - weight * mean / scale), float(weight / scale))


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`df` with score double and predicted int (1: score >= threshold) of every whole text, all columns kept.

    Null and empty texts score 0. A column named score or predicted in the input is replaced.
    """
    kept = df.drop("score", "predicted")

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(model.score).astype("float64")

    return kept.withColumn("score", scored(text_or_empty(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
