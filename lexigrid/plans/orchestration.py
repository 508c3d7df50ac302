"""I: pipelines, staged runs, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kleene import built, compare_units
from ..operators import extraction as X
from ..operators import pipelines as L
from ..operators.applicability import outcomes
from ..operators.graph import shared_folder
from ..registry import query, table
from ..streaming.ledger import totals, windowed
from ..streaming.runner import latest, results, run_stage, totals_by_version
from . import responses as R
from .inputs import AS_OF, FACTS_SQL, addresses, rules
from .rule_sql import pair_ctes
from .windows import CHUNKS_SQL

@query("i1_document_extraction", R.VERDICT)
def i1(spark: SparkSession, sf: str) -> DataFrame:
    """One request a document and at most one repair, over stored responses with every kind of fault."""
    return R.verdict(X.extract(*R.single(spark, sf), R.SETTINGS, AS_OF))


LARGE = f"""
WITH c AS (SELECT c.doc_id, c.number, (c.doc_id + c.number) % 11 <> 0 AS stored, substr(substr(d.text, c.raw_start + 1, c.raw_end - c.raw_start), 1, 24) AS q FROM ({CHUNKS_SQL}) c JOIN documents d ON d.doc_id = c.doc_id),
o AS (SELECT *, regexp_matches(q, '\\S') AS ok FROM c),
e AS (SELECT doc_id, coalesce(bool_or(number = 1 AND stored AND ok), false) AS est FROM o GROUP BY 1),
s AS (SELECT o.*, CASE WHEN NOT ok THEN 'rejected' WHEN est THEN 'accepted' ELSE 'held' END AS state FROM o JOIN e USING (doc_id)),
g AS (SELECT doc_id, count(*) AS requests, count_if(stored) AS n_candidates, count_if(stored AND state = 'accepted') AS n_accepted, count_if(stored AND state = 'held') AS n_held, count_if(stored AND NOT ok) AS blank FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN reasons = '' THEN 'complete' ELSE 'review_required' END AS status, * EXCLUDE (doc_id) FROM (
  SELECT doc_id, array_to_string(list_filter([CASE WHEN n_candidates > 0 AND n_candidates < requests THEN 'chunk_not_extracted' END, CASE WHEN n_held > 0 THEN 'held' END, CASE WHEN blank > 0 THEN 'provision_all_rejected' END,
    CASE WHEN n_candidates = 0 THEN 'response_unprocessable' END, CASE WHEN blank > 0 THEN 'scope_not_applied' END], lambda x: x IS NOT NULL), ',') AS reasons,
  requests, n_candidates, CAST(n_accepted AS BIGINT) AS n_accepted, CAST(n_held AS BIGINT) AS n_held FROM g)"""


@query("i2_large_documents", LARGE)
def i2(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each chunk; what the chunks say is merged under ids of their own and judged once."""
    return R.verdict(X.extract(*R.chunked(spark, sf), R.SETTINGS, AS_OF))


@query("i3_stage_runner", "SELECT user_id, event_id, coalesce(max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM events")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return L.run_until_stopped(table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 97 == 0).alias("stops")), "user_id", "event_id", "stops").select("user_id", "event_id", "ran")


@query("i3_streaming_ledger", "SELECT user_id, count(*) AS requests, round(sum(value), 4) AS spent FROM events GROUP BY 1")
def i3_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files, drained with a checkpoint."""
    root = shared_folder(spark)
    table(spark, sf, "events").select("user_id", "value").repartition(4).write.parquet(f"{root}/in")
    totals_by_version(totals(spark, f"{root}/in", "user_id long, value double"), f"{root}/out", f"{root}/checkpoint")
    return latest(spark, f"{root}/out").select("user_id", "requests", F.round("spent", 4).alias("spent"))


@query(
    "i3_resumable_runner",
    "SELECT event_id, CASE WHEN event_id > stop THEN 'not_run' WHEN event_id % 11 = 0 THEN 'error' ELSE 'done' END AS state, CASE WHEN event_id <= stop AND event_id % 11 <> 0 THEN event_type END AS result FROM events, (SELECT coalesce(min(event_id) FILTER (event_id % 397 = 396), 9223372036854775807) AS stop FROM events)",
)
def i3_runner(spark: SparkSession, sf: str) -> DataFrame:
    """The events as work items: one in eleven fails alone, one stops what comes after it."""
    root = shared_folder(spark)
    table(spark, sf, "events").select(F.col("event_id").alias("seq"), "event_type").write.parquet(f"{root}/in")
    items = spark.readStream.schema("seq long, event_type string").parquet(f"{root}/in")
    failed = F.when(F.col("seq") % 11 == 0, F.lit("can't be read"))
    work = lambda b: b.select("seq", failed.alias("error"), (F.col("seq") % 397 == 396).alias("stops"), F.when(failed.isNull(), F.col("event_type")).alias("result"))
    run_stage(items, work, f"{root}/out", f"{root}/checkpoint")
    return results(spark, f"{root}/out").select(F.col("seq").alias("event_id"), "state", "result")


@query("i3_windowed_ledger", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS requests, round(sum(value), 4) AS spent FROM events GROUP BY 1, 2")
def i3_windowed(spark: SparkSession, sf: str) -> DataFrame:
    """Requests and spending by hour of event time."""
    root = shared_folder(spark)
    table(spark, sf, "events").select("ts", "event_type", "value").write.parquet(f"{root}/in")
    totals_by_version(windowed(spark, f"{root}/in", "ts timestamp, event_type string, value double", "1 hour", "10 minutes"), f"{root}/out", f"{root}/checkpoint")
    return latest(spark, f"{root}/out").select(F.col("window.start").alias("hour"), "event_type", "requests", F.round("spent", 4).alias("spent"))


@query("i4_replay", R.REPLAYED)
def i4(spark: SparkSession, sf: str) -> DataFrame:
    """The stored first responses judged again without a second request."""
    return R.verdict(X.extract(*R.single(spark, sf), R.SETTINGS, AS_OF, repair=False))


@query(
    "i5_address_resolution",
    "WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 7 = 0 THEN 3 END AS used, c_nationkey FROM customer) SELECT a.id, a.used, coalesce('P' || s.s_nationkey, n.n_name) AS place, CASE WHEN a.used IS NULL AND s.s_suppkey IS NULL THEN 'unresolved' WHEN s.s_suppkey IS NOT NULL THEN 'override' WHEN a.used > 1 THEN 'review' ELSE 'resolved' END AS status "
    "FROM a LEFT JOIN nation n ON n.n_nationkey = a.c_nationkey AND a.used IS NOT NULL LEFT JOIN supplier s ON s.s_suppkey = a.id",
)
def i5(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    tried = F.array(F.when(F.col("id") % 3 == 0, F.lit(1)), F.when(F.col("id") % 5 == 0, F.lit(2)), F.when(F.col("id") % 7 == 0, F.lit(3)))
    areas = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area"))
    overrides = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("P"), F.col("s_nationkey")).alias("place"))
    return L.resolve(c.withColumn("tried", tried), areas, "c_nationkey", overrides)


@query("i6_what_if", f"WITH {pair_ctes('2028-06-01')} SELECT rule_id, count(*) AS n FROM outcome WHERE result = 'applies' GROUP BY 1")
def i6(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(rules(spark), addresses(spark, sf), "2028-06-01").where("result = 'applies'").groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    "i9_atoms_as_data",
    f"WITH facts AS ({FACTS_SQL}) SELECT address_id, CASE WHEN year_built IS NULL OR year_built = 1990 THEN NULL ELSE year_built < 1990 END AS before_1990, CASE WHEN units_min IS NULL THEN NULL WHEN units_max <= 4 THEN true WHEN units_min > 4 THEN false END AS at_most_4, CASE WHEN units_min >= 3 THEN true WHEN units_max < 3 THEN false END AS at_least_3 FROM facts",
)
def i9(spark: SparkSession, sf: str) -> DataFrame:
    low, high = F.col("units_min"), F.col("units_max")
    return addresses(spark, sf).select(
        "address_id", built(F.lit("before"), F.lit(1990), F.col("year_built")).alias("before_1990"), compare_units("<=", F.lit(4), low, high).alias("at_most_4"), compare_units(">=", F.lit(3), low, high).alias("at_least_3")
    )


