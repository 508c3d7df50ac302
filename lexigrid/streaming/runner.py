"""A stage of a run as a stream of work items: resumable, each batch published once, stopped in order, failures kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("done", "error", "not_run")


class Published:
    """The results' folder: batch=N holds what batch N published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._path = spark, root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def of(self, number: int) -> str:
        return f"{self.root}/batch={number}"

    def has(self, number: int) -> bool:
        return self._fs.exists(self._path(self.of(number)))

    def batches(self) -> list[int]:
        path = self._path(self.root)
        names = [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and n[6:].isdigit())

    def read(self, schema: str) -> DataFrame:
        """All that was published; an empty table if nothing was."""
        there = self.batches()
        return self.spark.read.schema(schema).parquet(*map(self.of, there)) if there else self.spark.createDataFrame([], schema)

    def publish(self, df: DataFrame, number: int) -> None:
        """Written aside, then renamed in one step: a reader sees a batch whole or not at all, and a batch that is there stays."""
        aside = f"{self.root}/_aside/{number}"
        df.write.mode("overwrite").parquet(aside)
        self._fs.mkdirs(self._path(self.root))
        if not self._fs.rename(self._path(aside), self._path(self.of(number))):
            raise OSError(f"{self.of(number)} can't be published")


def run_stage(items: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Works off all items (a stream with seq, their order) that are there, and returns.

    process gives for each item seq, error (null if it went well) and stops (whether the run must not go on after it), and may add columns. An item after
    the first one that stops, in this batch or an earlier one, isn't run: its state is not_run, and its other columns are null. Errors don't stop anything. If the driver dies, the same
    call goes on where the run was: a batch that was published isn't processed again, one that wasn't is processed as a whole.
    """
    spark = items.sparkSession
    folder = Published(spark, out)

    def step(batch: DataFrame, number: int) -> None:
        if folder.has(number):
            return
        earlier = [n for n in folder.batches() if n < number]
        over = bool(earlier) and bool(spark.read.parquet(*map(folder.of, earlier)).where("stops").limit(1).count())
        done = process(batch)
        first = None if over else done.where("stops").agg(F.min("seq")).first()[0]
        runs = F.lit(not over) & (F.lit(True) if first is None else F.col("seq") <= F.lit(first))
        state = F.when(~runs, "not_run").when(F.col("error").isNotNull(), "error").otherwise("done")
        others = [F.when(runs, F.col(c)).alias(c) for c in done.columns if c not in ("seq", "stops")]
        folder.publish(done.select("seq", state.alias("state"), (runs & F.coalesce("stops", F.lit(False))).alias("stops"), *others), number)

    items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def results(spark: SparkSession, out: str) -> DataFrame:
    """What all published batches hold."""
    folder = Published(spark, out)
    return spark.read.parquet(*map(folder.of, folder.batches()))


def totals_by_version(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Running totals (a stream in complete mode): each batch publishes a version of its own, so the last totals are there even if the next ones die midway."""
    folder = Published(stream.sparkSession, target)

    def step(batch: DataFrame, number: int) -> None:
        if not folder.has(number):
            folder.publish(batch, number)

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    folder = Published(spark, target)
    return spark.read.parquet(folder.of(folder.batches()[-1]))
