"""Lineage cuts through the folder that a cluster shares, for operators that go over their data in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` from a checkpoint in the folder that spark.checkpoint.dir names; a local master may do without the setting."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoints-"))
    return df.checkpoint(eager=True)
