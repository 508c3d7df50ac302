"""Connected components of an edge table by alternating large and small stars, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each node of an edge with the smallest node that it reaches, if that is another one.

    Each round tells every larger neighbour, then every smaller one, of the smallest neighbour; the edges end as
    stars after a number of rounds that grows with the logarithm of the nodes. A hub's edges are only aggregated (partial minimum) and
    joined (a join that Spark may split), so no task must hold a component. Loops and null ends are left out.
    """
    old = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(old)
    while True:
        both = old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        was, mark = mark, _mark(new)
        if mark == was:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        old = new
