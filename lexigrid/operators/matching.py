"""Inventory against candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each provision of a document: its candidates, how many were accepted, and whether none covers it."""
    counted = candidates.groupBy("doc", "provision").agg(F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"))
    met = inventory.join(counted, ["doc", "provision"], "left").fillna(0, ["candidates", "accepted"])
    return met.withColumn("uncovered", F.col("candidates") == 0)
