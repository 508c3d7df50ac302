"""E: joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_words, shingle_hashes
from ..operators import joins as J
from ..operators.applicability import ANYWHERE, candidates
from ..operators import references as R
from ..operators import reviews as RV
from ..registry import both, on_tables, query, table
from .inputs import FACTS_SQL, RULES_SQL, addresses, rules
from .rule_sql import pair_ctes
from .scalars import with_citation


@query("e1_candidate_join", f"SELECT f.address_id, r.rule_id FROM ({FACTS_SQL}) f JOIN ({RULES_SQL}) r ON r.jurisdiction IN (f.state_jurisdiction, f.local_jurisdiction)")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(rules(spark), addresses(spark, sf)).where(F.col("key") != ANYWHERE).select("address_id", "rule_id")


@query("e2_unresolved_to_all", f"SELECT f.address_id, r.rule_id FROM ({FACTS_SQL}) f JOIN ({RULES_SQL}) r ON r.status <> 'failed' WHERE f.state_jurisdiction IS NULL AND f.local_jurisdiction IS NULL")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(rules(spark), addresses(spark, sf)).where(F.col("key") == ANYWHERE).select("address_id", "rule_id")


@query(
    "e3_pair_accounting",
    f"WITH {pair_ctes()} SELECT (SELECT count(*) FROM facts) * (SELECT count(*) FROM rules) AS pairs, count(*) FILTER (result IS NOT NULL) AS shown, count(*) FILTER (omitted = 'coverage_false') AS coverage_false, count(*) FILTER (omitted = 'exempt') AS exempt, "
    "(SELECT count(*) FROM facts) * (SELECT count(*) FROM rules WHERE status = 'failed') AS failed, (SELECT count(*) FROM facts) * (SELECT count(*) FROM rules WHERE status <> 'failed') - count(*) FILTER (now <> 'failed') AS other_jurisdiction FROM outcome",
)
def e3(spark: SparkSession, sf: str) -> DataFrame:
    """Counts only; pairs of other jurisdictions are never made."""
    from .aggregates import found

    n, m = addresses(spark, sf).agg(F.count("*").alias("n")), rules(spark).agg(F.count("*").alias("m"), F.count_if(F.col("status") == "failed").alias("f"))
    o = found(spark, sf).agg(F.count("result").alias("shown"), F.count_if(F.col("omitted") == "coverage_false").alias("coverage_false"), F.count_if(F.col("omitted") == "exempt").alias("exempt"), F.count_if(F.col("status") != "failed").alias("kept"))
    one = n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").join(o.withColumn("k", F.lit(1)), "k")
    return one.select((F.col("n") * F.col("m")).alias("pairs"), "shown", "coverage_false", "exempt", (F.col("n") * F.col("f")).alias("failed"), (F.col("n") * (F.col("m") - F.col("f")) - F.col("kept")).alias("other_jurisdiction"))


both("e4_fact_lookup", "SELECT l_orderkey, l_linenumber, o_orderstatus, p_type, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0")


@query(
    "e5_scope_gaps",
    "SELECT c.conv_id AS rule_id, count(*) AS gaps, string_agg(CAST(m.turn AS VARCHAR), ',' ORDER BY m.turn) AS conditions FROM conversations m JOIN (SELECT conv_id, turn AS cand, unnest([turn, turn + 1]) AS provision FROM conversations WHERE role = 'user') c ON c.conv_id = m.conv_id AND c.provision = m.turn WHERE m.role = 'assistant' GROUP BY 1",
)
def e5(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    cand = c.where("role = 'user'").select(F.col("conv_id").alias("rule_id"), F.explode(F.array("turn", F.col("turn") + 1)).alias("provision"))
    unresolved = c.where("role = 'assistant'").select(F.col("conv_id").alias("rule_id"), F.col("turn").alias("provision"))
    met = cand.join(unresolved, ["rule_id", "provision"])
    return met.groupBy("rule_id").agg(F.count("*").alias("gaps"), F.array_join(F.array_sort(F.collect_list("provision")).cast("array<string>"), ",").alias("conditions"))


CROSSWALK = (("AMERICA", "united states", "United States"), ("EUROPE", "france", "France"), ("EUROPE", "germany", "Germany"), ("ASIA", "japan", "Japan"))


@query(
    "e6_crosswalk",
    "SELECT n.n_nationkey AS geoid, coalesce(x.name, n.n_name) AS jurisdiction, x.name IS NOT NULL AS in_corpus FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN (VALUES "
    + ", ".join(str(x) for x in CROSSWALK)
    + ") AS x(state, key, name) ON x.state = r.r_name AND x.key = lower(trim(n.n_name))",
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    places = on_tables(spark, sf, "SELECT n_nationkey AS geoid, n_name AS name, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey")
    return J.crosswalk(places, spark.createDataFrame(CROSSWALK, "state string, key string, jurisdiction string"))


@query(
    "e7_jurisdiction_dimension",
    "SELECT coalesce(a.k, b.k) AS jurisdiction, coalesce(docs, '') AS docs, coalesce(n, 0) AS rules FROM (SELECT source AS k, string_agg(DISTINCT lang, ',' ORDER BY lang) AS docs FROM documents GROUP BY 1) a FULL JOIN (SELECT CASE WHEN lang = 'fr' THEN 'only ' || source ELSE source END AS k, count(*) AS n FROM documents GROUP BY 1) b ON a.k = b.k",
)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    a = d.groupBy(F.col("source").alias("jurisdiction")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("docs"))
    b = d.groupBy(F.when(F.col("lang") == "fr", F.concat(F.lit("only "), "source")).otherwise(F.col("source")).alias("jurisdiction")).agg(F.count("*").alias("rules"))
    return a.join(b, "jurisdiction", "full_outer").select("jurisdiction", F.coalesce("docs", F.lit("")).alias("docs"), F.coalesce("rules", F.lit(0)).alias("rules"))


SPANS = "SELECT l_orderkey AS doc, l_linenumber AS id, CAST(l_partkey % 100 AS INT) AS s, CAST(l_partkey % 100 + l_quantity AS INT) AS e FROM lineitem"


@query("e8_overlap_join", f"WITH x AS ({SPANS}) SELECT a.doc, a.id AS id, b.id AS other FROM x a JOIN x b ON a.doc = b.doc AND a.id <> b.id AND b.s < a.e AND a.s < b.e")
def e8(spark: SparkSession, sf: str) -> DataFrame:
    x = on_tables(spark, sf, SPANS)
    return J.overlaps(x, x.withColumnRenamed("id", "other")).where("id <> other").select("doc", "id", "other")


@query("e9_containment_join", f"WITH x AS ({SPANS}) SELECT a.doc, a.id, min_by(b.id, (b.s, b.id)) AS inside FROM x a JOIN x b ON a.doc = b.doc AND a.id <> b.id AND b.s <= a.s AND a.e <= b.e GROUP BY 1, 2")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    x = on_tables(spark, sf, SPANS)
    o = x.select("doc", F.col("id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = x.join(o, "doc").where("id <> other AND s2 <= s AND e <= e2")
    return met.groupBy("doc", "id").agg(F.min_by("other", F.struct("s2", "other")).alias("inside"))


both("e10_semi_join", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")


@query("e11_interval_clip", f"WITH x AS ({SPANS}) SELECT a.doc, string_agg(greatest(a.s, 20) || '-' || least(a.e, 60), ';' ORDER BY a.s, a.id, a.e) AS pieces, sum(least(a.e, 60) - greatest(a.s, 20))::BIGINT AS n FROM x a WHERE a.s < 60 AND a.e > 20 GROUP BY 1")
def e11(spark: SparkSession, sf: str) -> DataFrame:
    x = on_tables(spark, sf, SPANS).where("s < 60 AND e > 20")
    low, high = F.greatest("s", F.lit(20)), F.least("e", F.lit(60))
    g = x.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "id", "e", F.concat(low.cast("string"), F.lit("-"), high.cast("string")).alias("p")))).alias("l"), F.sum((high - low).cast("long")).alias("n"))
    return g.select("doc", F.array_join(F.transform("l", lambda p: p["p"]), ";").alias("pieces"), "n")


_S, _L = "CAST(conv_id % 90 + 1 AS VARCHAR)", "chr(CAST(97 + turn % 5 AS INT))"


@query(
    "e12_target_matching",
    f"WITH t AS (SELECT conv_id, turn AS target, turn % 3 AS kind, 'p' || turn % 4 AS prov, {_S} AS s, {_S} || '.' || {_L} AS ref FROM conversations WHERE role = 'user'), "
    f"c AS (SELECT conv_id, turn AS candidate, ['p' || turn % 4, 'p' || (turn + 1) % 4] AS provs, unnest(CASE turn % 4 WHEN 0 THEN ['mun.code.' || {_S} || '.' || {_L} || '.1'] WHEN 1 THEN [{_S}] WHEN 2 THEN [{_S} || '.b', {_S} || '.c'] ELSE [{_S} || '.' || {_L}] END) AS cite FROM conversations WHERE role = 'assistant'), "
    "m AS (SELECT DISTINCT t.conv_id, target, candidate FROM t JOIN c USING (conv_id) WHERE kind = 1 AND contains('.' || cite || '.', '.' || ref || '.') OR list_contains(provs, prov) AND (kind = 2 OR kind = 0 AND (contains('.' || cite || '.', '.' || ref || '.') OR ends_with('.' || cite, '.' || s)))) "
    "SELECT conv_id, target, min(candidate) AS answered_by, count(candidate) AS answers FROM t LEFT JOIN m USING (conv_id, target) GROUP BY 1, 2",
)
def e12(spark: SparkSession, sf: str) -> DataFrame:
    """Targets with the candidates that answer them by reference, citation or link, and those that nothing answers."""
    c = with_citation(on_tables(spark, sf, "SELECT conv_id, turn, role, '§ ' || (conv_id % 90 + 1) || '(' || chr(CAST(97 + turn % 5 AS INT)) || ')' AS ref FROM conversations")).withColumnRenamed("conv_id", "doc")
    link = F.concat(F.lit("p"), (F.col("turn") % 4).cast("string"))
    source = F.when(F.col("turn") % 3 == 0, R.UNCOVERED).when(F.col("turn") % 3 == 1, R.SUBDIVISION).otherwise(R.CHALLENGE)
    targets = c.where("role = 'user'").select("doc", F.col("turn").alias("target"), "ref", source.alias("source"), link.alias("provision"))
    candidates = c.where("role = 'assistant'").select("doc", F.col("turn").alias("candidate"), "citation", F.array(link, F.concat(F.lit("p"), ((F.col("turn") + 1) % 4).cast("string"))).alias("provisions"))
    met = R.answers(targets, candidates)
    open_ones = R.unanswered(targets, met).select("doc", "target", F.lit(None).cast("bigint").alias("candidate"))
    rows = met.select("doc", "target", F.col("candidate").cast("bigint")).unionByName(open_ones)
    return rows.groupBy(F.col("doc").alias("conv_id"), "target").agg(F.min("candidate").alias("answered_by"), F.count("candidate").alias("answers"))


@query(
    "e13_condition_propagation",
    "WITH cond AS (SELECT conv_id, turn AS cond, CASE WHEN turn % 4 = 0 THEN NULL WHEN turn % 4 = 1 THEN [] ELSE [turn - 1, turn + 1] END AS ids FROM conversations WHERE role = 'assistant'), ru AS (SELECT conv_id, turn AS rule, [turn, turn + 2] AS provs FROM conversations WHERE role = 'user') "
    "SELECT r.conv_id, r.rule, c.cond FROM ru r JOIN cond c ON r.conv_id = c.conv_id AND (c.ids IS NULL OR list_has_any(c.ids, r.provs)) WHERE NOT (c.cond % 3 = 0 AND r.rule % 2 = 0)",
)
def e13(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    ids = F.when(F.col("turn") % 4 == 0, F.lit(None).cast("array<bigint>")).when(F.col("turn") % 4 == 1, F.array().cast("array<bigint>")).otherwise(F.array(F.col("turn") - 1, F.col("turn") + 1))
    conditions = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("cond"), ids.alias("ids"))
    rule_rows = c.where("role = 'user'").select("conv_id", F.col("turn").alias("rule"), F.array("turn", F.col("turn") + 2).alias("provs"))
    return J.propagate(rule_rows, conditions, "conv_id").where("NOT (cond % 3 = 0 AND rule % 2 = 0)").select("conv_id", "rule", "cond")


@query(
    "e14_pair_decisions",
    "SELECT e.user_id, e.event_id, coalesce(first(d.event_type ORDER BY d.event_id), 'undecided') AS decision FROM events e LEFT JOIN events d ON d.user_id = e.user_id AND d.event_id // 10 = e.event_id // 10 AND d.event_id > e.event_id GROUP BY 1, 2",
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    d = e.select("user_id", F.floor(F.col("event_id") / 10).alias("b"), F.col("event_id").alias("later"), "event_type")
    met = e.drop("event_type").withColumn("b", F.floor(F.col("event_id") / 10)).join(d, ["user_id", "b"]).where("later > event_id")
    best = met.groupBy("user_id", "event_id").agg(F.min_by("event_type", "later").alias("decision"))
    return e.select("user_id", "event_id").join(best, ["user_id", "event_id"], "left").fillna("undecided", ["decision"])


@query(
    "e15_first_resolution",
    "SELECT t.o_orderkey, CASE WHEN r.n IS NULL THEN 'unanswered' WHEN r.n > 1 THEN 'duplicate' WHEN r.q < 10 THEN 'malformed' ELSE 'resolved' END AS final FROM orders t LEFT JOIN (SELECT l_orderkey, count(*) AS n, min_by(l_quantity, l_linenumber) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.l_orderkey = t.o_orderkey",
)
def e15(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min_by("l_quantity", "l_linenumber").alias("q"))
    t = table(spark, sf, "orders").select("o_orderkey").join(r, "o_orderkey", "left")
    return t.select("o_orderkey", F.when(F.col("n").isNull(), "unanswered").when(F.col("n") > 1, "duplicate").when(F.col("q") < 10, "malformed").otherwise("resolved").alias("final"))


@query("e16_provenance_check", "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'no document' WHEN d.lang <> 'en' THEN 'language differs' WHEN d.n_chars < 100 THEN 'too short' ELSE 'ok' END AS problem FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def e16(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.lit(True).alias("there"))
    m = table(spark, sf, "labels").select("doc_id").join(d, "doc_id", "left")
    return m.select("doc_id", F.when(F.col("there").isNull(), "no document").when(F.col("lang") != "en", "language differs").when(F.col("n_chars") < 100, "too short").otherwise("ok").alias("problem"))


RUNS = (
    "SELECT l_orderkey AS doc_id, l_linenumber AS candidate, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'F' THEN 'held' ELSE 'published' END AS old_state, "
    "CASE WHEN l_quantity < 10 THEN 'published' WHEN l_quantity < 20 THEN 'historical: expired' WHEN l_quantity < 25 THEN 'suppressed_exact_duplicate' WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'F' THEN 'held' ELSE 'published' END AS state, "
    "CASE l_partkey % 3 WHEN 0 THEN 'citation: not found' WHEN 1 THEN 'version annotation is dated 2020' ELSE 'no' END AS why FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) x"
)


@query(
    "e17_baseline_delta",
    f"SELECT old_state AS before, state AS after, CASE WHEN old_state = 'rejected' AND why LIKE '%is dated%' THEN 'recovered: temporal' WHEN old_state <> 'published' AND why LIKE 'citation:%' THEN 'recovered: citation' WHEN state = 'historical: expired' THEN 'removed: expired' "
    f"WHEN state = 'suppressed_exact_duplicate' THEN 'removed: duplicate' ELSE 'other' END AS reason, count(*) AS n FROM ({RUNS}) WHERE old_state <> state AND candidate <= 5 GROUP BY 1, 2, 3",
)
def e17(spark: SparkSession, sf: str) -> DataFrame:
    """The new run has up to five candidates a document only."""
    runs = on_tables(spark, sf, RUNS).withColumn("reasons", F.array("why"))
    old, new = runs.select("doc_id", "candidate", F.col("old_state").alias("state"), "reasons"), runs.where("candidate <= 5").select("doc_id", "candidate", "state")
    return RV.baseline_delta(old, new).groupBy("before", "after", "reason").agg(F.count("*").alias("n"))

@query(
    "e18_reconciliation",
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'only in links' WHEN b.doc_id IS NULL THEN 'only in manifest' WHEN a.lang IS DISTINCT FROM b.lang AND a.source IS DISTINCT FROM b.source THEN 'differs: lang, source' WHEN a.lang IS DISTINCT FROM b.lang THEN 'differs: lang' WHEN a.source IS DISTINCT FROM b.source THEN 'differs: source' ELSE 'same' END AS state "
    "FROM documents a FULL JOIN (SELECT doc_id + 50 AS doc_id, lang, source FROM documents) b ON a.doc_id = b.doc_id",
)
def e18(spark: SparkSession, sf: str) -> DataFrame:
    """The documents against links to the fiftieth document on."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return J.reconcile(d, d.withColumn("doc_id", F.col("doc_id") + 50), "doc_id", ["lang", "source"], ("only in manifest", "only in links"))


BENCH_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))"


def _classes_sql(n: int, block: str, least: float) -> str:
    """Classes of equal shingle sets of a CTE b, pairs of them by joining all shingles, and classes of several rows."""
    return (
        f"s AS (SELECT id, {block} AS block, list_sort({BENCH_SHINGLES.format(n=n)}) AS g FROM b), c AS (SELECT min(id) AS id, block, g, count(*) AS n_rows FROM s WHERE len(g) > 0 GROUP BY block, g), x AS (SELECT id, block, n_rows, unnest(g) AS g, len(g) AS n FROM c) "
        "SELECT p.id AS a, q.id AS b, round(count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS jaccard, any_value(p.n_rows) AS n_a, any_value(q.n_rows) AS n_b FROM x p JOIN x q ON p.block = q.block AND p.g = q.g AND p.id < q.id GROUP BY 1, 2 "
        f"HAVING count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)) >= {least} UNION ALL SELECT id, id, 1.0, n_rows, n_rows FROM c WHERE n_rows > 1"
    )


@query(
    "e19_overlapping_documents",
    "WITH b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark UNION ALL SELECT 1000 + item_id, regexp_extract_all(lower(text || CASE WHEN item_id % 6 = 0 THEN '' ELSE ' and one more clause' END), '[a-z0-9]+') FROM benchmark WHERE item_id % 3 = 0), "
    f"{_classes_sql(8, '0', 0.5)}",
)
def e19(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    more = b.where("item_id % 3 = 0").select((F.col("item_id") + 1000).alias("id"), F.concat("text", F.when(F.col("item_id") % 6 == 0, "").otherwise(" and one more clause")).alias("text"))
    rows = b.select(F.col("item_id").alias("id"), "text").unionByName(more)
    return J.similar_classes(rows.select("id", shingle_hashes(ascii_words(F.col("text")), 8).alias("grams")), 0.5).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "e20_similar_within_blocks",
    f"WITH b AS (SELECT doc_id AS id, source || lang AS block, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), {_classes_sql(5, 'block', 0.8)}",
)
def e20(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("source", "lang").alias("block"), shingle_hashes(ascii_words(F.col("text")), 5).alias("grams"))
    return J.similar_classes(d, 0.8, "block").withColumn("jaccard", F.round("jaccard", 6))


both("e21_conflict_semi_join", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")


@query(
    "e22_stale_overrides",
    "SELECT c.c_custkey, coalesce(o.place, c.c_mktsegment) AS place, o.k IS NOT NULL AND (o.segment IS NOT NULL AND o.segment IS DISTINCT FROM c.c_mktsegment OR o.nation IS NOT NULL AND o.nation IS DISTINCT FROM c.c_nationkey) AS stale FROM customer c "
    "LEFT JOIN (SELECT s_suppkey AS k, 'P' || s_nationkey AS place, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' END AS segment, CASE WHEN s_suppkey % 3 = 1 THEN s_nationkey END AS nation FROM supplier) o ON o.k = c.c_custkey",
)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.concat(F.lit("P"), F.col("s_nationkey")).alias("place"),
        F.struct(F.when(F.col("s_suppkey") % 3 == 0, F.lit("BUILDING")).alias("c_mktsegment"), F.when(F.col("s_suppkey") % 3 == 1, F.col("s_nationkey")).alias("c_nationkey")).alias("evidence"),
    )
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return J.overridden(c, o, "c_custkey", ["c_mktsegment", "c_nationkey"]).select("c_custkey", F.coalesce("place", "c_mktsegment").alias("place"), "stale")


@query("e23_tie_agreement", "SELECT l_orderkey, count(DISTINCT l_returnflag || coalesce(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_linestatus END, '?')) = 1 AS agree FROM lineitem GROUP BY 1")
def e23(spark: SparkSession, sf: str) -> DataFrame:
    key = F.struct("l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, F.lit(None).cast("string")).otherwise(F.col("l_linestatus")).alias("place"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count_distinct(key) == 1).alias("agree"))


@query("e24_cross_page_join", f"WITH x AS ({SPANS}), a AS (SELECT doc, id, s, e, lead(id) OVER w AS next_id, lead(s) OVER w AS next_s FROM x WINDOW w AS (PARTITION BY doc ORDER BY id, s, e)) SELECT doc, id, next_id, next_s - e AS gap FROM a WHERE next_id = id + 1 AND next_s > e")
def e24(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc").orderBy("id", "s", "e")
    x = on_tables(spark, sf, SPANS).withColumn("next_id", F.lead("id").over(w)).withColumn("next_s", F.lead("s").over(w))
    return x.where("next_id = id + 1 AND next_s > e").select("doc", "id", "next_id", (F.col("next_s") - F.col("e")).alias("gap"))


