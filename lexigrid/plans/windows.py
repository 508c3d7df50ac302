"""G: ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordered as O
from ..operators import reviews as RV
from .scalars import LEVELS_SQL
from ..registry import both, on_tables, query, table

both("g1_neighbours", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
both(
    "g2_next_start_regions",
    "SELECT doc, s AS region_start, least(coalesce(lead(s) OVER (PARTITION BY doc ORDER BY s), 400), s + 50) AS region_end FROM (SELECT DISTINCT l_orderkey AS doc, l_partkey % 300 AS s FROM lineitem) x",
)


@query("g3_first_wins", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate rather than a window: partial minima are combined before the shuffle."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents"


@query("g4_line_offsets", f"SELECT doc_id, n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts FROM ({LINES})")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return O.line_offsets(table(spark, sf, "documents")).select("doc_id", "n", "starts")


@query(
    "g5_repeated_line_islands",
    f"WITH l AS ({LINES}), k AS (SELECT doc_id, n, count(*) OVER (PARTITION BY doc_id, line) >= 3 AND line <> '' AS again FROM l), g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, again ORDER BY n) AS island FROM k) "
    "SELECT doc_id, min(n) AS first_line, max(n) AS last_line FROM g WHERE again GROUP BY doc_id, island",
)
def g5(spark: SparkSession, sf: str) -> DataFrame:
    lines = O.line_offsets(table(spark, sf, "documents"))
    return O.repeated_islands(lines, 3)


#: Texts in which a header of two lines with a page's number stands before every twelfth line.
PAGED = (
    "SELECT doc_id, array_join(array_sort(collect_list(struct(n, CASE WHEN (n - 1) % 12 = 0 THEN concat('Official Code of the State\\nPage ', CAST((n - 1) / 12 + 1 AS BIGINT), '\\n', line) ELSE line END)), (a, b) -> CAST(a.n - b.n AS INT)).col2, '\\n') AS text "
    "FROM lines GROUP BY doc_id"
)


@query("g5_page_furniture")
def g5_furniture(spark: SparkSession, sf: str) -> DataFrame:
    """Furniture of texts to which a header with a counter is added every 12 lines. No SQL: groups grow run by run. tests/test_ordered.py has a plain version."""
    lines = O.line_offsets(table(spark, sf, "documents"))
    return O.page_furniture(on_tables(spark, sf, PAGED, lines=lines)).select("doc_id", "first_line", "end_line")


@query(
    "g6_view_tiles",
    "SELECT doc_id, length(t) AS chars, 0 AS breaks, sha256(t) AS text_sha256 FROM (SELECT doc_id, concat('Code of the State', chr(10), 'Page 1', chr(10), x, chr(10), 'Code of the State', chr(10), 'Page 2', chr(10), x, chr(10), 'Code of the State', chr(10), 'Page 3', chr(10), x) AS t FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))",
)
def g6_view(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's own text three times, with a page header each: segments and artifacts tile it, and put together are it again. The texts are dealt once, as they stand in the table."""
    head = lambda k: F.lit(f"Code of the State\nPage {k}\n")
    x = F.coalesce("text", F.lit(""))
    thrice = F.concat(head(1), x, F.lit("\n"), head(2), x, F.lit("\n"), head(3), x)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tiles = O.view(docs.select("doc_id", thrice.alias("text")))
    spans = tiles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("raw_start", "raw_end"))).alias("spans"))
    pairs = F.zip_with(F.slice("spans", F.lit(1), F.size("spans") - 1), F.slice("spans", F.lit(2), F.size("spans") - 1), lambda a, b: a["raw_end"] != b["raw_start"])
    pieces = F.transform("spans", lambda p: F.substring(F.col("text"), p["raw_start"].cast("int") + 1, (p["raw_end"] - p["raw_start"]).cast("int")))
    return spans.join(docs, "doc_id").withColumn("text", thrice).select(
        "doc_id", F.aggregate("spans", F.lit(0).cast("long"), lambda n, p: n + p["raw_end"] - p["raw_start"]).alias("chars"), F.size(F.filter(pairs, lambda b: b)).alias("breaks"),
        F.sha2(F.array_join(pieces, ""), 256).alias("text_sha256"),
    )


SPANS = "SELECT DISTINCT l_orderkey AS doc, CAST(l_linenumber * 40 AS INT) AS s, CAST(l_linenumber * 40 + l_quantity % 30 + 1 AS INT) AS e FROM lineitem"


#: Lines of a task, on average.
TASK_LINES = 500_000


@query(
    "g6_complement_segments",
    f"WITH x AS (SELECT doc, s, max(e) AS e FROM ({SPANS}) GROUP BY doc, s), a AS (SELECT doc, e AS s, lead(s) OVER (PARTITION BY doc ORDER BY s) AS e FROM x UNION ALL SELECT doc, 0, min(s) FROM x GROUP BY doc), b AS (SELECT doc, s, coalesce(e, 1000) AS e FROM a) "
    "SELECT doc, s, e, row_number() OVER (PARTITION BY doc ORDER BY s) AS segment FROM b WHERE s < e",
)
def g6(spark: SparkSession, sf: str) -> DataFrame:
    """Lines are dealt by document first, in tasks of a bounded number: partial aggregates before that hold nearly all rows, as few are equal."""
    lines = table(spark, sf, "lineitem")
    tasks = 1 + lines.count() // TASK_LINES
    start = (F.col("l_linenumber") * 40).cast("int")
    x = lines.select(F.col("l_orderkey").alias("doc"), start.alias("s"), (F.col("l_linenumber") * 40 + F.col("l_quantity") % 30 + 1).cast("int").alias("e"))
    return O.complement(x.repartition(tasks, "doc").groupBy("doc", "s").agg(F.max("e").alias("e")), 1000)


@query("g7_budget_gate", "SELECT user_id, event_id, coalesce(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500 AS started FROM events")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.abs("value").alias("cost"))
    return O.budget_gate(e, "user_id", "event_id", "cost", 500.0).select("user_id", "event_id", "started")


CHUNKS_SQL = (
    f"WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, position, level, own, list_position(['hard', 'line', 'sentence', 'paragraph', 'heading'], level) AS rank FROM ({LEVELS_SQL})), d AS (SELECT doc_id, length(text) AS n, text FROM documents WHERE text IS NOT NULL), "
    "cut(doc_id, number, pos, level, n) AS (SELECT doc_id, CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'document_start', n FROM d UNION ALL "
    "SELECT c.doc_id, c.number + 1, coalesce(max_by(b.position, (b.rank, b.position)), c.pos + 1000), coalesce(max_by(b.level, (b.rank, b.position)), 'hard'), c.n FROM cut c LEFT JOIN b ON b.doc_id = c.doc_id AND b.position BETWEEN c.pos + 500 AND c.pos + 1000 "
    "WHERE c.n - c.pos > 1000 GROUP BY c.doc_id, c.number, c.pos, c.n), "
    "e AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY number), n) AS raw_end FROM cut), h AS (SELECT e.doc_id, e.number, max_by(b.own, b.position) AS heading FROM e JOIN b ON b.doc_id = e.doc_id AND b.level = 'heading' AND b.position < e.pos GROUP BY 1, 2) "
    "SELECT e.doc_id, e.number, e.pos AS raw_start, e.raw_end, e.level AS boundary, coalesce(h.heading, CASE WHEN e.pos > 0 AND regexp_matches(d.text, '\\S') THEN trim(string_split(d.text, chr(10))[1], ' ' || chr(9) || chr(13)) END) AS heading "
    "FROM e JOIN d USING (doc_id) LEFT JOIN h ON h.doc_id = e.doc_id AND h.number = e.number"
)


@query("g8_chunk_plan", CHUNKS_SQL)
def g8(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 500 to 1,000 characters at the best line boundary, else a hard cut; they tile each text."""
    return O.plan_chunks(table(spark, sf, "documents"), 1000, 500)


@query(
    "g9_label_runs",
    "WITH x AS (SELECT DISTINCT l_orderkey AS doc, chr(CAST(97 + l_partkey % 9 AS INT)) AS label FROM lineitem), g AS (SELECT doc, label, ascii(label) - row_number() OVER (PARTITION BY doc ORDER BY label) AS island FROM x), r AS (SELECT doc, island, min(label) AS first_label, max(label) AS last_label, count(*) AS n FROM g GROUP BY 1, 2) "
    "SELECT doc, first_label, last_label, n FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first_label) AS k FROM r) WHERE k = 1 AND n >= 2",
)
def g9(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.char((97 + F.col("l_partkey") % 9).cast("int")).alias("label")).distinct()
    w = Window.partitionBy("doc").orderBy("label")
    g = x.withColumn("island", F.ascii("label") - F.row_number().over(w)).groupBy("doc", "island").agg(F.min("label").alias("first_label"), F.max("label").alias("last_label"), F.count("*").alias("n"))
    best = g.groupBy("doc").agg(F.max_by(F.struct("first_label", "last_label", "n"), F.struct("n", (-F.ascii("first_label")).alias("k"))).alias("b"))
    return best.select("doc", "b.*").where("n >= 2")


ATTEMPTS = "SELECT o_custkey AS id, o_orderkey AS ord, o_orderstatus = 'F' AS usable, o_orderpriority AS kind FROM orders"


@query(
    "g10_failed_predecessors",
    f"WITH a AS ({ATTEMPTS}), u AS (SELECT id, min(ord) FILTER (usable) AS used FROM a GROUP BY id) SELECT u.id, u.used, count(a.ord) AS failed_before, coalesce(string_agg(DISTINCT a.kind, ',' ORDER BY a.kind), '') AS kinds FROM u LEFT JOIN a ON a.id = u.id AND (u.used IS NULL OR a.ord < u.used) GROUP BY 1, 2",
)
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return O.failed_before(on_tables(spark, sf, ATTEMPTS))


@query(
    "g11_cascading_attempts",
    "WITH a AS (SELECT c_custkey AS id, c_custkey % 4 <> 0 AS has_city, c_custkey % 5 <> 0 AS has_zip FROM customer), m AS (SELECT id, has_city, has_zip, id % 3 = 0 AND id % 2 = 0 AS a, has_zip AND id % 7 < 4 AS b, has_zip AND has_city AND id % 11 < 9 AS c FROM a) "
    "SELECT id, CASE WHEN a THEN 'A' WHEN b THEN 'B' WHEN c THEN 'C' END AS used, CASE WHEN a THEN 'pA' WHEN b THEN 'pB' WHEN c THEN 'pC' END AS place, "
    "'A' || CASE WHEN NOT a AND has_zip THEN 'B' ELSE '' END || CASE WHEN NOT a AND NOT b AND has_zip AND has_city THEN 'C' ELSE '' END AS tried, "
    "CAST(CASE WHEN NOT a AND NOT has_zip THEN 1 ELSE 0 END + CASE WHEN NOT a AND NOT b AND NOT (has_zip AND has_city) THEN 1 ELSE 0 END AS BIGINT) AS skipped FROM m",
)
def g11(spark: SparkSession, sf: str) -> DataFrame:
    """A match of attempt A in another state isn't usable."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    rows = c.select(k.alias("id"), F.lit("1 Main St").alias("street"), F.when(k % 4 == 0, "").otherwise("Town").alias("city"), F.lit("MA").alias("state"), F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit("02139")).alias("zip"))
    kinds = [("A", k % 3 == 0, F.when(k % 2 == 0, "MA").otherwise("NJ")), ("B", k % 7 < 4, F.lit("MA")), ("C", k % 11 < 9, F.lit("MA"))]
    answers = F.array(*(F.struct(F.lit(a).alias("attempt"), F.when(hit, "Match").otherwise("No_Match").alias("indicator"), state.alias("state"), F.lit(f"p{a}").alias("place")) for a, hit, state in kinds))
    return RV.run_attempts(rows, c.select(k.alias("id"), F.explode(answers).alias("x")).select("id", "x.*"))


@query("g13_tiling", f"WITH x AS (SELECT doc, s, max(e) AS e FROM ({SPANS}) GROUP BY doc, s) SELECT doc, count(*) FILTER (nxt IS NOT NULL AND nxt <> e) AS breaks FROM (SELECT doc, e, lead(s) OVER (PARTITION BY doc ORDER BY s) AS nxt FROM x) GROUP BY doc")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    x = on_tables(spark, sf, SPANS).groupBy("doc", "s").agg(F.max("e").alias("e"))
    nxt = F.lead("s").over(Window.partitionBy("doc").orderBy("s"))
    return x.select("doc", "e", nxt.alias("nxt")).groupBy("doc").agg(F.count_if(F.col("nxt") != F.col("e")).alias("breaks"))
