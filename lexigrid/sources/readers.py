"""Readers of CSV, JSON and header texts, and the cache of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings as they stand; a missing value is '', never NULL (the reader makes unquoted empties NULL)."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def parse_header(text: Column) -> Column:
    """struct(source_url, retrieved, body, valid) of `SOURCE: ` and `RETRIEVED: ` lines, a blank line and a body."""
    parts = F.split(text, "\n", 4)
    lines = [F.coalesce(F.get(parts, i), F.lit("")) for i in range(4)]
    valid = (F.size(parts) == 4) & F.startswith(lines[0], F.lit("SOURCE: ")) & F.startswith(lines[1], F.lit("RETRIEVED: ")) & (lines[2] == "")
    cut = F.struct(F.regexp_replace(lines[0], "^SOURCE: ", "").alias("source_url"), F.regexp_replace(lines[1], "^RETRIEVED: ", "").alias("retrieved"), lines[3].alias("body"), F.lit(True).alias("valid"))
    none = F.lit(None).cast("string")
    return F.when(valid, cut).otherwise(F.struct(none.alias("source_url"), none.alias("retrieved"), none.alias("body"), F.lit(False).alias("valid")))


def manifest_time(header: Column) -> Column:
    """`2026-10-01 22:44 UTC` as `2026-10-01T22:44Z`."""
    return F.regexp_replace(header, r"^(\S+) (\S+) UTC$", "$1T$2Z")


def availability(text_file: Column, status: Column) -> Column:
    return F.when(text_file != "", F.lit("supplied_text")).when(F.startswith(status, F.lit("manual")), F.lit("capture_failed")).otherwise(F.lit("link_only"))


def unwrap_rules(payload: Column) -> Column:
    """The rules of a JSON list or of an object's `rules`, as an array of JSON texts; NULL for anything else."""
    value = F.try_parse_json(payload)
    kind = F.schema_of_variant(value)
    listed = F.try_variant_get(value, "$", "array<variant>")
    inner = F.try_variant_get(value, "$.rules", "array<variant>")
    found = F.when(F.startswith(kind, F.lit("ARRAY")), listed).otherwise(inner)
    return F.transform(found, lambda v: F.to_json(v))


def cache_key(*fields: Column) -> Column:
    """SHA-256 of the fields as JSON with NULLs kept."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (key) with the cache's response; status is hit, miss or corrupt, if the response no longer has the digest that was stored."""
    met = requests.join(cache, "key", "left")
    status = F.when(F.col("response").isNull(), "miss").when(F.sha2("response", 256) != F.col("digest"), "corrupt").otherwise("hit")
    return met.withColumn("status", status)


def parse_batch(rows: DataFrame, submitted: DataFrame) -> DataFrame:
    """id, match, block, problem: a geocoder's answer lines against the ids that were sent. Each must come back exactly once; Match lines need all parts."""
    fields = F.split("line", ",")
    known = rows.select(F.trim(fields[0]).alias("id"), F.trim(F.get(fields, 1)).alias("match"), *(F.nullif(F.trim(F.get(fields, i)), F.lit("")).alias(f"p{i}") for i in (2, 3, 4)))
    counted = known.groupBy("id").agg(F.count("*").alias("n"), F.first("match").alias("match"), F.first(F.concat("p2", "p3", "p4")).alias("block"))
    met = submitted.join(counted, "id", "full_outer")
    problem = (
        F.when(F.col("sent").isNull(), "not submitted").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
        .when(~F.col("match").isin("Match", "No_Match", "Tie"), "unknown indicator").when((F.col("match") == "Match") & F.col("block").isNull(), "malformed match")
    )
    return met.select("id", "match", "block", problem.alias("problem"))


def prompt(title: Column, sections: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n"), F.array_join(sections, "\n"))
