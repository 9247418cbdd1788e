"""The corpus pipeline: documents are judged, deduplicated, decontaminated, masked and encoded, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, pii, quality, simhash
from tidemark.llm.common import forget, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; those without text are rejected."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where("predicted = 1").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Of rows that repeat an id the one with the least text stays, as an id is one document. Rows without an id cannot be
    named a group's document: one of each text stays, if no document with an id has the same text.
    """
    groups = simhash.verified_groups(docs)
    kept = groups.where("doc_id = component_id").select("doc_id")
    rest = [c for c in COLUMNS if c != "doc_id"]
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    named = named.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", "x.*").select(COLUMNS)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    nameless = docs.where("doc_id is null").withColumn("key", key).dropDuplicates(["key"])
    nameless = nameless.join(docs.where("doc_id is not null").select(key.alias("key")), "key", "left_anti").select(COLUMNS)
    return named.unionByName(nameless)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is a near copy of a benchmark item."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows the text."""
    masked = pii.mask(pii.find(docs))
    return masked.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: Compressed sizes, fingerprints and tokens are beyond SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; what a stage has read is
    deleted once its own result is written. Columns beyond those of documents are left out; an empty table gives no rows."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return docs
