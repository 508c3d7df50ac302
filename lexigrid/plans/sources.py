"""A and B: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..operators import reviews as RV
from ..registry import both, listed, on_tables, query, table
from ..sources import readers as R
from ..sources import sinks as S
from .inputs import AS_OF
from .rule_sql import pair_ctes

ZIPPED = "SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR(9)), 5, '0') AS zip, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name FROM supplier"


@query("a1_csv_scan", f"SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, zip, name FROM ({ZIPPED})")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    S.write_csv(on_tables(spark, sf, ZIPPED), path)
    return R.read_csv(spark, path, ["s_suppkey", "zip", "name"])


@query("a2_json_scan", "SELECT p_partkey, p_name, p_size FROM part")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    S.write_json(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey long, p_name string, p_size int").json(path)


HEADED = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE concat('SOURCE: https://example.org/', CAST(doc_id AS VARCHAR(20)), chr(10), 'RETRIEVED: 2026-10-01 22:44 UTC', chr(10), chr(10), text) END AS t FROM documents"


@query("a3_header_texts", "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'https://example.org/' || doc_id END AS source_url, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS body_sha256, doc_id % 5 <> 0 AS valid FROM documents")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    h = on_tables(spark, sf, HEADED).select("doc_id", R.parse_header(F.col("t")).alias("h"))
    return h.select("doc_id", "h.source_url", F.sha2("h.body", 256).alias("body_sha256"), "h.valid")


@query("a4_manifest_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%MZ') AS at FROM events")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", R.manifest_time(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" UTC"))).alias("at"))


@query("a5_availability", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'supplied_text' WHEN doc_id % 2 = 0 THEN 'capture_failed' ELSE 'link_only' END AS kind FROM documents")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    file = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("D"), "doc_id")).otherwise("")
    status = F.when(F.col("doc_id") % 2 == 0, "manual: blocked").otherwise("link-only")
    return table(spark, sf, "documents").select("doc_id", R.availability(file, status).alias("kind"))


@query("a6_source_lookup", "SELECT d.doc_id, sha256(d.text) AS body_sha256, l.quality IS NOT NULL AS in_manifest FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("body_sha256"))
    m = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("in_manifest"))
    return d.join(m, "doc_id", "left").fillna(False, ["in_manifest"])


both("a7_supplied_documents", "SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 0 AND lang = 'en'")


@listed("a8_unwrap_rules", "rules", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE [event_type, 'x'] END AS rules FROM events")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    items = F.concat(F.lit('["'), "event_type", F.lit('","x"]'))
    k = F.col("event_id") % 3
    payload = F.when(k == 0, items).when(k == 1, F.concat(F.lit('{"rules":'), items, F.lit("}"))).otherwise(F.lit('{"other":1}'))
    rows = table(spark, sf, "events").select("event_id", R.unwrap_rules(payload).alias("r"))
    return rows.select("event_id", F.transform("r", lambda x: F.replace(x, F.lit('"'), F.lit(""))).alias("rules"))


@query("a9_cached_batch", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'miss' WHEN s_suppkey % 10 = 0 THEN 'corrupt' ELSE 'hit' END AS status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), R.cache_key(F.col("c_custkey").alias("k")).alias("key"))
    s = table(spark, sf, "supplier")
    cache = s.select(R.cache_key(F.col("s_suppkey").alias("k")).alias("key"), F.col("s_name").alias("response"), F.when(F.col("s_suppkey") % 10 == 0, F.lit("damaged")).otherwise(F.sha2("s_name", 256)).alias("digest"))
    return R.cached(requests, cache).select("id", "status")


both("a10_point_lookup", "SELECT c_custkey, n_name AS area FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
#: Into how many cells a nation's customers are dealt, and over how many tasks all cells are; how many suppliers are listed together, on average, and how many stand in a row.
CELLS, CELL_TASKS, LISTED, ROW = 32, 200, 32_768, 256


@query("a11_candidate_listing", "SELECT c_custkey, s_suppkey AS candidate FROM customer JOIN supplier ON s_nationkey = c_nationkey")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of one nation, which are as many as its customers times its suppliers: customers are dealt to cells, suppliers stand in each cell of their nation, so no task has a whole nation.

    Suppliers stand in rows of ROW, and a row meets all customers of its cell before the next one does: the same short run of candidates comes again and again, which a written column holds in
    a tenth of the bytes that a whole nation's run takes, as that is longer than a page."""
    keys = ["nation", "cell"]
    c = table(spark, sf, "customer").where("c_nationkey IS NOT NULL").select(F.col("c_nationkey").alias("nation"), F.pmod(F.xxhash64("c_custkey"), F.lit(CELLS)).cast("int").alias("cell"), "c_custkey")
    s = table(spark, sf, "supplier").where("s_nationkey IS NOT NULL")
    part = F.pmod(F.xxhash64("s_suppkey"), F.lit(1 + s.count() // LISTED))
    ids = F.sort_array(F.collect_list(F.struct("s_suppkey")))["s_suppkey"]  # a list of plain keys would lose a NULL
    together = s.groupBy(F.col("s_nationkey").alias("nation"), part.alias("part")).agg(ids.alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(ROW))
    rows = together.select("nation", F.explode(F.transform(starts, lambda i: F.slice("ids", i, ROW))).alias("ids"))
    s = rows.select("nation", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"), "ids")
    met = s.repartition(CELL_TASKS, *keys).join(c.repartition(CELL_TASKS, *keys).hint("shuffle_hash"), keys)
    return met.select("c_custkey", F.explode("ids").alias("candidate"))


@query(
    "a12_batch_reconciliation",
    "SELECT CAST(coalesce(c.c_custkey, s.k) AS VARCHAR) AS id, CASE WHEN c.c_custkey IS NULL THEN 'not submitted' WHEN s.k IS NULL THEN 'missing' WHEN s.k % 7 = 0 THEN 'unknown indicator' WHEN s.k % 3 = 0 AND s.k % 5 = 0 THEN 'malformed match' END AS problem "
    "FROM customer c FULL JOIN (SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey + 10000000 FROM supplier) s ON s.k = c.c_custkey",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """All customers are submitted; lines came for those with orders, and for suppliers, who weren't."""
    k = F.col("k")
    match = F.when(k % 7 == 0, "Odd").when(k % 3 == 0, "Match").otherwise("No_Match")
    line = F.concat_ws(",", k.cast("string"), match, F.lit("06"), F.when(k % 5 == 0, "").otherwise("075"), F.lit("0101"))
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, sf, "supplier").select((F.col("s_suppkey") + 10000000).alias("k"))).distinct()
    sent = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit(True).alias("sent"))
    return R.parse_batch(ids.select(line.alias("line")), sent).select("id", "problem")


@query("a13_cache_key", "SELECT p_partkey, sha256('{\"a\":\"' || p_brand || '\",\"b\":' || CASE WHEN p_size > 25 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}') AS key FROM part")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", R.cache_key(F.col("p_brand").alias("a"), F.when(F.col("p_size") <= 25, F.col("p_size")).alias("b")).alias("key"))


@query("a16_prompts", "SELECT conv_id, '# ' || conv_id || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt, sha256('# ' || conv_id || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS identity FROM conversations GROUP BY conv_id")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s"))))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(said.alias("l"))
    p = g.select("conv_id", R.prompt(F.col("conv_id").cast("string"), F.transform("l", lambda x: x["s"])).alias("prompt"))
    return p.withColumn("identity", F.sha2("prompt", 256))


@query(
    "a14_retry_policy",
    "SELECT event_id, CASE WHEN status = 200 THEN 'done' WHEN (status IS NULL OR status IN (429, 503)) AND attempt < 3 AND NOT (status IS NOT NULL AND coalesce(hint, 0) > 60) THEN 'retry' ELSE 'fail' END AS action, "
    "CASE WHEN (status IS NULL OR status IN (429, 503)) AND attempt < 3 AND NOT (status IS NOT NULL AND coalesce(hint, 0) > 60) THEN CASE WHEN status IS NOT NULL AND hint IS NOT NULL THEN hint WHEN attempt = 1 THEN 2.0 ELSE 8.0 END END::DOUBLE AS wait_s FROM "
    "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 END AS status, event_id % 3 + 1 AS attempt, CASE event_id % 7 WHEN 0 THEN 5.0 WHEN 1 THEN 90.0 END AS hint FROM events)",
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 5 == 0, 200).when(k % 5 == 1, 429).when(k % 5 == 2, 503).when(k % 5 == 3, 404)
    hint = F.when(k % 7 == 0, 5.0).when(k % 7 == 1, 90.0)
    return table(spark, sf, "events").select("event_id", RV.retry(status, k % 3 + 1, hint).alias("x")).select("event_id", "x.action", "x.wait_s")


IDENTITY_SQL = (
    "'{\"generation_settings\":\"temperature 0\",\"model\":\"m' || conv_id % 3 || '\",\"pass\":\"repair\",\"prompt_sha256\":\"' || sha256('system' || chr(0) || said) || '\",\"prompt_version\":\"p1\",\"provider\":\"stored\",\"response_schema_sha256\":\"' || sha256('{}') || "
    "'\",\"source_doc_id\":' || conv_id || ',\"source_sha256\":\"' || sha256(said) || '\",\"targets\":[' || targets || '],\"view_sha256\":\"' || sha256(lower(said)) || '\"}'"
)


@query("a17_request_identity", f"SELECT conv_id, sha256({IDENTITY_SQL}) AS identity FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS said, string_agg('\"t' || turn || '\"', ',' ORDER BY 't' || turn) AS targets FROM conversations GROUP BY conv_id)")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    """Of a repair request on each conversation, whose turns are its targets."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(lines.alias("said"), F.collect_list(F.concat(F.lit("t"), "turn")).alias("targets"))
    sha = lambda c: F.sha2(c, 256)
    fields = {
        "pass": F.lit("repair"), "source_doc_id": F.col("conv_id"), "source_sha256": sha(F.col("said")), "view_sha256": sha(F.lower("said")), "provider": F.lit("stored"), "model": F.concat(F.lit("m"), F.col("conv_id") % 3),
        "prompt_version": F.lit("p1"), "prompt_sha256": sha(F.concat(F.lit("system\0"), "said")), "response_schema_sha256": sha(F.lit("{}")), "generation_settings": F.lit("temperature 0"),
    }
    return rows.select("conv_id", RV.request_identity(fields, F.col("targets")).alias("identity"))



@query("b1_json_sink", f"WITH {pair_ctes()} SELECT address_id, rule_id, result FROM outcome WHERE result IS NOT NULL")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    from .aggregates import found

    path = shared_folder(spark)
    S.write_json(found(spark, sf, AS_OF).where("result IS NOT NULL").select("address_id", "rule_id", "result"), path)
    return spark.read.schema("address_id long, rule_id string, result string").json(path)


@query("b2_csv_sink", f"WITH {pair_ctes()} SELECT address_id, rule_id, replace(reasons, ',', ';') AS reasons FROM outcome")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    from .aggregates import found

    path = shared_folder(spark)
    S.write_csv(S.csv_rows(found(spark, sf).select("address_id", "rule_id", "reasons"), ["reasons"]), path)
    return R.read_csv(spark, path, ["address_id", "rule_id", "reasons"]).withColumn("address_id", F.col("address_id").cast("long"))


@query("b3_lookup_documents", f"WITH {pair_ctes()} SELECT address_id, '[' || string_agg('{{\"rule_id\":\"' || rule_id || '\",\"result\":\"' || result || '\"}}', ',' ORDER BY rule_id) || ']' AS entries FROM outcome WHERE result IS NOT NULL GROUP BY 1")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    from .aggregates import found

    return S.lookup_documents(found(spark, sf).where("result IS NOT NULL"), "address_id", "rule_id", ["rule_id", "result"])


@query("b4_dictionary_codes", "SELECT props, row_number() OVER (ORDER BY f, props) - 1 AS code FROM (SELECT props, min(event_id) AS f FROM events GROUP BY 1)")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    return S.dictionary_encode(table(spark, sf, "events"), "props", "event_id")


SECRETS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "aws_key": r"AKIA[0-9A-Z]{16}", "address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"}
LEAK = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in SECRETS.items())


@query("b5_submission_check", f"SELECT doc_id, kinds, sha256(text) AS sha256 FROM (SELECT *, concat_ws(',', {LEAK}) AS kinds FROM documents) WHERE kinds <> ''")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    found = S.leaks(table(spark, sf, "documents").select("doc_id", "text"), "text", SECRETS)
    return found.select("doc_id", F.array_join("leaks", ",").alias("kinds"), F.sha2("text", 256).alias("sha256"))


@query(
    "b6_superseding_write",
    "SELECT d.doc_id AS key, CASE WHEN l.doc_id IS NULL THEN 'write' WHEN l.toxic = 1 THEN 'version' ELSE 'keep' END AS action, sha256(coalesce(d.text, '')) AS current, CASE WHEN l.toxic = 1 THEN 2 ELSE 1 END AS versions, CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN 1 ELSE 0 END AS generation "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def b6(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents are written first, toxic ones with another identity; then all documents, which supersedes those and leaves equal ones alone."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("payload"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), "toxic")
    store = S.Artifacts(spark, f"{shared_folder(spark)}/artifacts")
    other = F.concat(F.when(F.col("toxic") == 1, "old ").otherwise(""), F.sha2("payload", 256))
    store.write(docs.join(labels, "key").select("key", other.alias("identity"), "payload"))
    done = store.write(docs.select("key", F.sha2("payload", 256).alias("identity"), "payload"), replace=True)
    versions = store.all().groupBy("key").agg(F.count("*").cast("int").alias("versions"))
    now = store.current().select("key", F.sha2("payload", 256).alias("current"), "generation")
    return done.join(now, "key").join(versions, "key").select("key", "action", "current", "versions", "generation")
