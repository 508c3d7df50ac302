"""Staged runs, and resolution in attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_until_stopped(rows: DataFrame, key: str, order: str, stops: str) -> DataFrame:
    """ran: no row before it in its run has stopped the run."""
    before = F.max(F.col(stops).cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("ran", F.coalesce(before, F.lit(0)) == 0)


def resolve(rows: DataFrame, areas: DataFrame, area_key: str, overrides: DataFrame) -> DataFrame:
    """id, used, place, status of addresses: the first attempt that matched names the area; a later attempt needs review; an audited override wins."""
    used = F.try_element_at(F.filter("tried", lambda t: t.isNotNull()), F.lit(1))
    met = rows.withColumn("used", used).join(areas, area_key, "left").join(overrides, "id", "left")
    area = F.when(F.col("used").isNotNull(), F.col("area"))
    status = F.when(F.col("place").isNotNull(), "override").when(F.col("used").isNull(), "unresolved").when(F.col("used") > 1, "review").otherwise("resolved")
    return met.select("id", "used", F.coalesce("place", area).alias("place"), status.alias("status"))
