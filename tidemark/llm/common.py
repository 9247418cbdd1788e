"""Helpers shared by the training-data operators: lineage cuts, connected components, canonical words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of one key beyond which they are dealt out in parts before they are joined, and keys of that kind that are broadcast.
HOT_COPIES = 1000
BROADCAST_HOT = 500_000
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is configured a temporary one serves a local master; a cluster must name one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoints-"))
        found = sc.getCheckpointDir()
    return found


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder; without paths all that `table` has written, once nothing reads them any more."""
    for path in paths or list(_written):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _written:
            _written.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Write `df` as a compressed Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def join_copies(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with `classes`, one row a key with its number of rows in `copies`.

    The rows of a key with over HOT_COPIES of them are dealt out in parts of about that size, and its class goes to each.
    """
    hot = cut(classes.where(F.col("copies") > HOT_COPIES).select(key, F.ceil(F.col("copies") / HOT_COPIES).cast("int").alias("parts")))
    n_hot = hot.count()
    if not n_hot:
        return rows.join(classes.drop("copies"), key)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(hot, key, "left").withColumn("part", part).drop("parts")
    classes = classes.drop("copies").join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return rows.join(classes, [key, "part"]).drop("part")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges`, as (node, component): component is the smallest node reachable.

    Each round every node takes its smallest neighbour as parent, parents are followed to their roots by pointer
    jumping, and the edges are rewritten to roots; the number of live roots at least halves, so rounds grow with the
    logarithm of the largest component. Only aggregates by node and equi-joins are used, so a node with very many
    edges is pre-aggregated map-side and a skewed join is split by adaptive execution. Null ends are ignored; an
    empty edge list gives an empty result; only nodes that have an edge are returned.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    live = cut(edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).where("hi <> lo and hi is not null and lo is not null").distinct())
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        both = live.select(F.col("hi").alias("n"), F.col("lo").alias("p")).unionByName(live.select(F.col("lo").alias("n"), F.col("hi").alias("p")))
        parent = cut(both.groupBy("n").agg(F.min("p").alias("p")).select("n", F.least("n", "p").alias("p")))
        while True:
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("q"))
            jumped = cut(parent.join(up, "p").select("n", "p", "q"))
            moved = jumped.where("p <> q").isEmpty()
            parent = jumped.select("n", F.col("q").alias("p"))
            if moved:
                break
        if labels is None:
            labels = parent.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            to = parent.select(F.col("n").alias("component"), F.col("p").alias("root"))
            labels = cut(labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        hi, lo = (parent.select(F.col("n").alias(k), F.col("p").alias(f"{k}_root")) for k in ("hi", "lo"))
        live = live.join(hi, "hi").join(lo, "lo").select(F.greatest("hi_root", "lo_root").alias("hi"), F.least("hi_root", "lo_root").alias("lo"))
        live = cut(live.where("hi <> lo").distinct())
        if live.isEmpty():
            return labels
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
