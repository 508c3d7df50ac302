"""Connected components in DataFrame joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local session without the setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: a step's results are computed once and survive lost executors.

    Joins with it are merged: its files say nothing of its size, as they may be a hundredth of what the rows take in memory, and so don't let Spark send it whole through the driver."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for the edges a, b. Labels spread to neighbours and to the labels' own labels,
    so the rounds grow with the logarithm of a component's width; each round is a table in the shared folder."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = labels.join(hop, "component").join(near, "node").select("node", F.least("component", "further", "m").alias("component"), F.col("component").alias("was"))
        new = kept(new)
        moved = new.where("component <> was").limit(1).count()
        labels = new.drop("was")
        if not moved:
            return labels
