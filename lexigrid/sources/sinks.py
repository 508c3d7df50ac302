"""Writers, and the check of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..streaming.runner import Published


def csv_rows(rows: DataFrame, lists: list[str], joiner: str = ";") -> DataFrame:
    """Array columns as joined strings, so that the rows can be written as CSV."""
    return rows.select(*(F.array_join(c, joiner).alias(c) if c in lists else F.col(c) for c in rows.columns))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def lookup_documents(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """A row for each key with its entries as JSON, in order."""
    entry = F.struct(F.col(order).alias("o"), F.struct(*fields).alias("e"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("l")).select(key, F.to_json(F.transform("l", lambda x: x["e"])).alias("entries"))


def dictionary_encode(rows: DataFrame, text: str, order: str) -> DataFrame:
    """text, code: each distinct text with its place by first use, from 0. Distinct texts are sorted by ranges; only the ranges' counts
    are summed in one task, so that no task holds all texts."""
    first = rows.groupBy(text).agg(F.min(order).alias("first"))
    path = shared_folder(rows.sparkSession)
    first.repartitionByRange("first", text).select(text, "first", F.spark_partition_id().alias("part")).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy("first", text)) - 1
    return ranged.withColumn("within", within).join(counts.select("part", before.alias("before")), "part").select(text, (F.col("before") + F.col("within")).cast("long").alias("code"))


def superseding(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, identity, action: new artifacts are written, equal ones kept, and an old one of another identity is never overwritten but renamed to a version."""
    met = old.withColumnRenamed("identity", "was").join(new, "key", "full_outer")
    action = F.when(F.col("was").isNull(), "write").when(F.col("identity").isNull() | (F.col("identity") == F.col("was")), "keep").otherwise("version")
    return met.select("key", F.coalesce("identity", "was").alias("identity"), action.alias("action"))


class Artifacts:
    """A folder of artifacts (key, identity, payload) in which nothing is overwritten: each write publishes a generation with what is new or of another identity.

    A reader takes of each key the last generation's row; earlier rows stay as superseded versions. Without `replace` a key of another identity is refused, and the
    rows say so. Keys are distinct in a write. A generation is written aside and renamed in one step, so a write that dies leaves nothing behind that is read.
    """

    SCHEMA = "key long, identity string, payload string, generation int"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._store = spark, Published(spark, root)

    def all(self) -> DataFrame:
        return self._store.read(self.SCHEMA)

    def current(self) -> DataFrame:
        last = self.all().groupBy("key").agg(F.max(F.struct("generation", "identity", "payload")).alias("x"))
        return last.select("key", "x.identity", "x.payload", "x.generation")

    def write(self, rows: DataFrame, replace: bool = False) -> DataFrame:
        """key, action of each row: write, keep, version (an older one is superseded) or refuse."""
        found = superseding(self.current().select("key", "identity"), rows.select("key", "identity")).join(rows.select("key", "payload"), "key")
        action = F.when((F.col("action") == "version") & F.lit(not replace), "refuse").otherwise(F.col("action"))
        path = shared_folder(self.spark)
        found.withColumn("action", action).write.parquet(path)  # decided once, before anything is published
        decided = self.spark.read.parquet(path)
        number = max(self._store.batches(), default=-1) + 1
        new = decided.where("action IN ('write', 'version')").select("key", "identity", "payload", F.lit(number).alias("generation"))
        self._store.publish(new, number)
        return decided.select("key", "action")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file below a folder: equal digests mean equal bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"))


def leaks(texts: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Rows with the kinds of secrets that they hold."""
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns.items())))
    return texts.withColumn("leaks", found).where(F.size("leaks") > 0)
