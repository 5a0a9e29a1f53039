"""Cutting lineage in the folder that all executors share, and values that are computed once."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with the value computed once for a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written to spark.checkpoint.dir. A temporary folder stands in on one machine only, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the machine, where the C library can; workers wait for later tasks with all that they ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, now rather than when the driver next collects garbage.

    What the first round frees refers to what the second one does; files are deleted in the background.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node connected with it.

    Alternating stars: each node sends its larger neighbours, then its smaller ones, to the smallest node
    that it knows. Groups are minima with map-side combination, never lists, and the edges of a round are
    never more than those before it.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star over both directions.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star over the edges to smaller nodes.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        now = linked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(now.where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # Each node now has one edge, to its root; roots have none.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
