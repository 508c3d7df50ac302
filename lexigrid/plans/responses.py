"""Stored responses about `documents`: what a model might have answered, with one kind of fault for each remainder of doc_id, and the SQL of what must come of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators.graph import kept
from ..operators.ordered import plan_chunks
from ..registry import table

KINDS = 24
SETTINGS = {"provider": "stored", "model": "m1", "prompt_version": "p1", "prompt_sha256": "0" * 64, "response_schema_sha256": "1" * 64, "generation_settings": "{}"}
ABSENT = "#~# not in any text #~#"
CATEGORIES = ("fees", "notices", "deposits", "evictions")
LABELS = ("", "(a)", "(b)", "(c)")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


def _quote(k: int) -> Column:
    return F.substring(F.coalesce("text", F.lit("")), 1 + 12 * k, 24)


def _rule(category: str | Column, quote: Column, citation: Column, links: list[str], status: str | Column = "enacted", evidence: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = [category, quote, citation, F.array(*map(F.lit, links)), status, none if evidence is None else evidence, none, none]
    names = ("category", "quote", "citation", "provision_ids", "enactment_status", "status_evidence", "effective_date", "date_evidence")
    return F.struct(*((p if isinstance(p, Column) else F.lit(p)).alias(n) for p, n in zip(parts, names, strict=True)))


def _struct(**parts) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()))


def single(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, requests, responses for one request a document and its repair: identities and responses come from one pass over the texts, kept as a table."""
    docs = documents(spark, sf)
    m, section = F.pmod("doc", F.lit(KINDS)), F.concat(F.lit("§ "), (F.col("doc") % 90 + 1).cast("string"))
    q = [_quote(k) for k in range(4)]
    cite = [F.concat(section, F.lit(x)) for x in LABELS]

    def item(k: int, ref: Column, scope: Column | str, category: str | None) -> Column:
        return _struct(id=f"p{k}", ref=ref, scope=scope, category=F.lit(category).cast("string"))

    outside = F.when(m.isin(13, 14), "out_of_scope").otherwise("in_scope")
    items = [
        item(1, section, outside, "fees"), item(2, cite[1], F.when(m == 1, "uncertain").otherwise(outside), "notices"),
        item(3, F.concat(section, F.lit("(b)-(c)")), outside, "deposits"), item(4, F.concat(section, F.lit("(d)")), "out_of_scope", None),
    ]
    provisions = F.when(m == 3, F.lit(None)).when(m == 4, F.array().cast("array<struct<id:string,ref:string,scope:string,category:string>>")).when(m == 2, F.array(*items, items[0])).otherwise(F.array(*items))
    second = F.when(m == 8, _rule("notices", F.concat(q[1], F.lit(ABSENT)), cite[1], ["p2"])).when(m == 9, _rule("notices", q[1], cite[1], ["p2"], "pending")).when(m == 18, _rule("notices", q[1], cite[1], ["p9"])).otherwise(_rule("notices", q[1], cite[1], ["p2"]))
    third = F.when(m == 15, _rule("notices", q[1], cite[2], ["p3"])).otherwise(_rule("deposits", q[2], cite[2], ["p3"]))
    every = [_rule("fees", q[0], section, ["p1"]), third, _rule("evictions", q[3], cite[3], ["p3"])]
    no_second = m.isin(5, 6, 7, 16, 17, 20, 21, 22)
    rules = F.when(m.isin(13, 14), F.array().cast(f"array<{X.RULE}>")).when(no_second, F.array(*every)).otherwise(F.array(every[0], second, *every[1:]))
    posture = F.when(m == 10, F.lit(None)).otherwise(_struct(posture=F.when(m == 11, "pending_bill").otherwise("codified_current_law"), evidence=q[0]))
    scope = F.when(m == 19, F.array(_struct(id="c1", statement="This chapter applies to all units", evidence=ABSENT, governed=F.lit(None).cast("array<string>")))).when(
        m == 23, F.array(_struct(id="c1", statement="rental units owned by banks", evidence=q[0], governed=F.array(F.lit("p1"), F.lit("p2"))))
    )
    empty = F.when(m == 13, _struct(reason="a notice only", evidence=q[0]))
    payload = F.when(m == 12, "{oops").otherwise(F.to_json(_struct(document=posture, provisions=provisions, global_scope=scope, rules=rules, no_rules=empty)))
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", X.identity(docs, SETTINGS, "primary"))
    fixed = F.when(m == 5, F.array(_rule("notices", q[1], cite[1], ["p2"]))).when(m == 21, F.array(_rule("notices", q[1], F.concat(section, F.lit("(e)")), ["p1"]))).when(
        m == 22, F.array(_rule("notices", q[1], cite[1], ["p2"]), _rule("fees", q[0], cite[1], ["p2"], "enacted", q[1]))
    ).otherwise(F.array().cast(f"array<{X.RULE}>"))
    said = F.when(m.isin(5, 22), "in_scope").when(m == 6, "uncertain").when(m.isin(16, 17), "out_of_scope")
    resolutions = F.when(said.isNotNull(), F.array(_struct(ref=cite[1], scope=said, reason="because", evidence=F.when(m == 16, q[1]))))
    mapped = F.when(m == 23, F.array(_struct(condition="c1", provision="p1", decision="applies", reason="its subject", evidence=q[0])))
    answer = F.when(m == 20, "{oops").otherwise(F.to_json(_struct(rules=fixed, target_resolutions=resolutions, scope_mappings=mapped)))
    words = q[1].rlike(r"\S")
    pairs = F.when(m == 23, F.filter(F.array(F.lit("c1 p1"), F.when(words, "c1 p2")), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    refs = F.when(m == 23, F.array().cast("array<string>")).otherwise(F.array(cite[1]))
    repair = X.repair_key(F.sha2(F.col("key"), 256), refs, pairs, SETTINGS)
    made = kept(keyed.select("doc", "key", payload.alias("payload"), F.when(m.isin(5, 6, 16, 17, 20, 21, 22, 23), repair).alias("repair"), answer.alias("answer")))
    requests = made.select("doc", F.lit(1).alias("part"), F.lit(None).cast("string").alias("tag"), "key")
    asked = made.where("repair IS NOT NULL").select(F.col("repair").alias("key"), F.col("answer").alias("payload"))
    return docs, requests, made.select("key", "payload").unionByName(asked)


def _verdict(repair: bool) -> str:
    """What must come of single(): states of the candidates by their quotes and the document's kind of fault."""
    ran = "m IN (5, 6, 16, 17, 20, 21, 22)" if repair else "false"
    fails = "m IN (7, 18, 20)" if repair else "m IN (5, 6, 7, 16, 17, 18, 20, 21, 22) OR m = 23 AND ok0"
    mended = "m IN (5, 22) AND ok1 AND est OR m = 16 AND ok1" if repair else "false"
    return f"""
WITH t AS (SELECT doc_id, doc_id % {KINDS} AS m, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, m, regexp_matches(substr(text, 1, 24), '\\S') AS ok0, regexp_matches(substr(text, 13, 24), '\\S') AS ok1, regexp_matches(substr(text, 25, 24), '\\S') AS ok2, regexp_matches(substr(text, 37, 24), '\\S') AS ok3 FROM t),
e AS (SELECT *, ok0 AND m NOT IN (10, 12) AS posed, ok0 AND m NOT IN (10, 11, 12) AS est FROM o),
slots AS (
  SELECT e.*, k, CASE k WHEN 0 THEN ok0 WHEN 1 THEN ok1 WHEN 2 THEN CASE WHEN m = 15 THEN ok1 ELSE ok2 END ELSE ok3 END AS ok FROM e, unnest([0, 1, 2, 3]) u(k) WHERE m NOT IN (12, 13, 14) AND NOT (k = 1 AND m IN (5, 6, 7, 16, 17, 20, 21, 22))),
firsts AS (
  SELECT *, CASE WHEN m IN (3, 4) OR (k = 1 AND m IN (8, 9, 18)) OR NOT ok THEN 'rejected' WHEN NOT est THEN 'held' WHEN k = 2 AND m = 15 THEN 'duplicate' WHEN k = 0 AND m = 22 AND ok1 AND {repair} THEN 'duplicate' ELSE 'accepted' END AS state FROM slots),
seconds AS (
  SELECT doc_id, m, est, 1 AS k, CASE WHEN NOT ok1 THEN 'rejected' WHEN est THEN 'accepted' ELSE 'held' END AS state FROM e WHERE m IN (5, 22) AND {repair}
  UNION ALL SELECT doc_id, m, est, 9, CASE WHEN NOT ok0 OR NOT ok1 THEN 'rejected' WHEN est THEN 'accepted' ELSE 'held' END FROM e WHERE m = 22 AND {repair}
  UNION ALL SELECT doc_id, m, est, 8, 'rejected' FROM e WHERE m = 21 AND {repair}),
candidates AS (SELECT doc_id, m, k, state, true AS first FROM firsts UNION ALL SELECT doc_id, m, k, state, false FROM seconds),
n AS (SELECT doc_id, count(*) AS n_candidates, count_if(state = 'accepted') AS n_accepted, count_if(state = 'held') AS n_held FROM candidates GROUP BY doc_id),
reasons AS (
  SELECT doc_id, 'response_unprocessable' AS code FROM e WHERE m = 12
  UNION SELECT doc_id, 'inventory_invalid' FROM e WHERE m IN (2, 3)
  UNION SELECT doc_id, 'inventory_empty' FROM e WHERE m = 4
  UNION SELECT doc_id, 'unjustified_empty_result' FROM e WHERE m = 14 OR m = 13 AND NOT ok0
  UNION SELECT doc_id, 'inventory_uncertain' FROM e WHERE m = 1
  UNION SELECT doc_id, 'held' FROM candidates WHERE state = 'held'
  UNION SELECT doc_id, 'status_posture_mismatch' FROM e WHERE posed AND m IN (9, 11)
  UNION SELECT doc_id, 'scope_not_applied' FROM e WHERE m = 19 OR m = 23 AND NOT ok0
  UNION SELECT doc_id, 'scope_mapping_unresolved' FROM e WHERE m = 23 AND ok0 AND (ok1 OR NOT {repair})
  UNION SELECT doc_id, 'repair_failed' FROM e WHERE {fails}
  UNION SELECT doc_id, 'repair_target_unresolved' FROM e WHERE m IN (5, 6, 7, 16, 17, 18, 20, 21, 22) AND NOT coalesce({mended}, false)
  UNION SELECT doc_id, 'provision_all_rejected' FROM firsts WHERE state NOT IN ('accepted', 'held') AND m NOT IN (3, 4) AND NOT (k = 1 AND m IN (1, 18)) ),
said AS (SELECT doc_id, string_agg(code, ',' ORDER BY code) AS reasons FROM reasons GROUP BY doc_id)
SELECT e.doc_id, CASE WHEN reasons IS NULL THEN 'complete' ELSE 'review_required' END AS status, coalesce(reasons, '') AS reasons, CAST(1 + CASE WHEN m IN (5, 6, 7, 16, 17, 18, 20, 21, 22) OR m = 23 AND ok0 THEN 1 ELSE 0 END AS BIGINT) AS requests,
  coalesce(n_candidates, 0) AS n_candidates, CAST(coalesce(n_accepted, 0) AS BIGINT) AS n_accepted, CAST(coalesce(n_held, 0) AS BIGINT) AS n_held
FROM e LEFT JOIN said USING (doc_id) LEFT JOIN n USING (doc_id)"""


VERDICT, REPLAYED = _verdict(True), _verdict(False)


def verdict(run: X.Run) -> DataFrame:
    c = {k: F.col(k).cast("long").alias(k) for k in ("requests", "n_candidates", "n_accepted", "n_held")}
    return run.documents.select(F.col("doc").alias("doc_id"), "status", F.array_join("reasons", ",").alias("reasons"), *c.values())


MOST, LEAST = 1000, 500


def chunked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, requests (doc, part, tag, raw_start, raw_end, key), responses for a request for each chunk: each chunk has a provision and a rule that quotes its first
    words; the first one the posture; each a condition for "all" that it sees; one in eleven has no stored response. Chunks are cut once, requests and responses kept as one table."""
    docs = documents(spark, sf)
    cuts = plan_chunks(table(spark, sf, "documents"), MOST, LEAST).select(F.col("doc_id").alias("doc"), F.col("number").alias("part"), "raw_start", "raw_end")
    tag = F.format_string("c%02d", "part")
    piece = docs.withColumn("text", F.coalesce("text", F.lit(""))).join(cuts, "doc").withColumn("text", F.substring(F.col("text"), F.col("raw_start").cast("int") + 1, (F.col("raw_end") - F.col("raw_start")).cast("int")))
    key = X.identity(piece, SETTINGS, "chunk")
    section, q = F.concat(F.lit("§ "), F.col("part").cast("string")), F.substring("text", 1, 24)
    posture = F.when(F.col("part") == 1, _struct(posture="codified_current_law", evidence=q))
    items = F.array(_struct(id="p1", ref=section, scope="in_scope", category="fees"))
    scope = F.array(_struct(id="s1", statement="This chapter applies to all units", evidence=q, governed=F.lit(None).cast("array<string>")))
    payload = F.to_json(_struct(document=posture, provisions=items, global_scope=scope, rules=F.array(_rule("fees", q, section, ["p1"]))))
    answer = F.when((F.col("doc") + F.col("part")) % 11 != 0, payload)
    keyed = kept(piece.select("doc", "part", tag.alias("tag"), "raw_start", "raw_end", F.sha2(F.concat_ws(" ", key, "part"), 256).alias("key"), answer.alias("payload")))
    return docs, keyed.drop("payload"), keyed.where("payload IS NOT NULL").select("key", "payload")
