"""F: aggregations, and the rule outcomes that most of them summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import evaluate_clause
from ..functions.kleene import and3, and3_rows, or3, or3_rows
from ..operators.applicability import outcomes, parsed
from ..operators.extraction import keep_or_replace
from ..operators.graph import components
from ..registry import both, on_tables, query, table
from .inputs import AS_OF, SUPPLIED_SQL, addresses, rules, supplied_rules
from .rule_sql import clause_ctes, pair_ctes

FLAG = "CASE WHEN l_linenumber = 1 THEN l_quantity > 25 WHEN l_linenumber = 2 THEN l_discount < 0.05 WHEN l_linenumber = 3 THEN NULL ELSE l_tax < 0.07 END"


def _flag():
    return F.expr(FLAG)


AND_SQL = f"SELECT l_orderkey AS k, CASE WHEN count(*) FILTER (NOT v) > 0 THEN false WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL ELSE true END AS value FROM (SELECT l_orderkey, {FLAG} AS v FROM lineitem) GROUP BY 1"
OR_SQL = AND_SQL.replace("FILTER (NOT v) > 0 THEN false", "FILTER (v) > 0 THEN true").replace("ELSE true", "ELSE false")


@query("f1_and3_rows", AND_SQL)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(and3_rows(_flag()).alias("value"))


@query("f2_or3_rows", OR_SQL)
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(or3_rows(_flag()).alias("value"))


ARRAY = "array(c_custkey % 2 = 0, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END, c_custkey % 5 > 0)"


@query(
    "f1_and3_arrays",
    "SELECT c_custkey, CASE WHEN NOT (c_custkey % 2 = 0) OR NOT (c_custkey % 5 > 0) OR c_custkey % 3 = 2 THEN false WHEN c_custkey % 3 = 0 THEN NULL ELSE true END AS all_of, "
    "CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 > 0 OR c_custkey % 3 = 1 THEN true WHEN c_custkey % 3 = 0 THEN NULL ELSE false END AS any_of FROM customer",
)
def f1_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", and3(F.expr(ARRAY)).alias("all_of"), or3(F.expr(ARRAY)).alias("any_of"))


@query("d27_classify_clauses", f"WITH {clause_ctes(rules_sql=SUPPLIED_SQL)} SELECT rule_id, role, ord, text, kind, any_of, coalesce((SELECT string_agg(a.kind, ',' ORDER BY a.kind) FROM atoms a WHERE a.rule_id = k.rule_id AND a.role = k.role AND a.ord = k.ord), '') AS atoms FROM kinds k")
def d27(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(supplied_rules(spark, sf), int(AS_OF[:4]))
    rows = [p.select("rule_id", F.lit(r).alias("role"), F.posexplode(r).alias("ord", "c")) for r in ("coverage", "exemption")]
    kinds = F.array_join(F.array_sort(F.transform("c.clause.atoms", lambda a: a["kind"])), ",")
    return rows[0].unionByName(rows[1]).select("rule_id", "role", (F.col("ord") + 1).cast("long").alias("ord"), "c.text", "c.clause.kind", "c.clause.any_of", kinds.alias("atoms"))


@query(
    "f3_evaluate_clauses",
    f"WITH {pair_ctes()} SELECT rule_id, role, ord, address_id, value FROM cv",
)
def f3(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.applicability import candidates

    pairs = candidates(parsed(rules(spark), int(AS_OF[:4])), addresses(spark, sf))
    out = []
    for role in ("coverage", "exemption"):
        one = pairs.select("rule_id", "address_id", "year_built", "units_min", "units_max", "use_class", F.posexplode(role).alias("ord", "c"))
        value = evaluate_clause(F.col("c.clause"), role, F.col("year_built"), F.col("units_min"), F.col("units_max"), F.col("use_class"))["value"]
        out.append(one.select("rule_id", F.lit(role).alias("role"), (F.col("ord") + 1).cast("long").alias("ord"), "address_id", value.alias("value")))
    return out[0].unionByName(out[1])


def found(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    return outcomes(rules(spark), addresses(spark, sf), as_of)


@query("f4_rule_outcomes", f"WITH {pair_ctes()} SELECT address_id, rule_id, result, omitted, clause, reasons, missing_facts FROM outcome")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select("address_id", "rule_id", "result", "omitted", "clause", F.array_join("reasons", ",").alias("reasons"), F.array_join("missing_facts", ",").alias("missing_facts"))


@query("f5_result_counts", f"WITH {pair_ctes()} SELECT jurisdiction, coalesce(result, omitted) AS outcome, count(*) AS n FROM outcome GROUP BY ALL")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).groupBy("jurisdiction", F.coalesce("result", "omitted").alias("outcome")).agg(F.count("*").alias("n"))


STATES = ("applies", "unknown", "superseded", "not_yet_effective", "pending")


@query("f6_status_pivot", f"WITH {pair_ctes()} SELECT address_id, " + ", ".join(f"count(*) FILTER (result = '{s}') AS {s}" for s in STATES) + " FROM outcome GROUP BY address_id")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).groupBy("address_id").pivot("result", list(STATES)).agg(F.count("rule_id")).fillna(0)


both("f7_conditional_sums", "SELECT l_returnflag, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS high, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, count(*) AS n FROM lineitem GROUP BY l_returnflag")


@query("f8_cost_statistics", "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS middle, max(o_totalprice) AS most FROM orders GROUP BY 1")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.median("o_totalprice"), 4).alias("middle"), F.max("o_totalprice").alias("most"))


@query("f9_exact_rate", "SELECT c_nationkey, round(count(*) FILTER (c_acctbal > 0)::DOUBLE / nullif(count(*) FILTER (c_custkey % 3 = 0), 0), 6) AS rate FROM customer GROUP BY 1")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.try_divide(F.count_if(F.col("c_acctbal") > 0).cast("double"), F.count_if(F.col("c_custkey") % 3 == 0))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(ratio, 6).alias("rate"))


@query("f10_missing_fact_ranking", f"WITH {pair_ctes()} SELECT fact, n, row_number() OVER (ORDER BY n DESC, fact) AS place FROM (SELECT unnest(string_split(missing_facts, ',')) AS fact, count(*) AS n FROM outcome WHERE missing_facts <> '' GROUP BY 1)")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    counts = found(spark, sf).select(F.explode("missing_facts").alias("fact")).groupBy("fact").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "fact")).cast("long"))


@query("f11_any_all", f"WITH {pair_ctes()} SELECT address_id, count(*) FILTER (result = 'unknown') > 0 AS any_unknown, count(*) FILTER (result IS NULL OR result <> 'applies') = 0 AS all_apply FROM outcome GROUP BY 1")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    known = F.coalesce("result", F.lit(""))
    return found(spark, sf).groupBy("address_id").agg(F.bool_or(known == "unknown").alias("any_unknown"), F.bool_and(known == "applies").alias("all_apply"))


both("f12_distinct_pairs", "SELECT l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
both("f13_duplicate_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")


@query("f14_ordered_lists", "SELECT c_nationkey, string_agg(c_name, ', ' ORDER BY c_name) AS names, count(*) AS n FROM customer GROUP BY 1")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("names"), F.count("*").alias("n"))


@query("f15_first_and_last", "SELECT user_id, min_by(event_type, event_id) AS first_wins, max_by(event_type, event_id) AS last_wins FROM events GROUP BY 1")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_wins"), F.max_by("event_type", "event_id").alias("last_wins"))


@query("f16_nested_counters", f"WITH {pair_ctes()} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM outcome WHERE reasons <> '') GROUP BY 1")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    return found(spark, sf).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


both("f17_grouping_sets", "SELECT r_name AS state, n_name AS local, c_mktsegment AS status, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY GROUPING SETS ((), (r_name, c_mktsegment), (n_name, c_mktsegment))")


@query("f18_new_usage", "SELECT user_id, coalesce(round(sum(coalesce(value, 0)) FILTER (event_id % 4 <> 0), 4), 0) AS fresh, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1")
def f18(spark: SparkSession, sf: str) -> DataFrame:
    value = F.coalesce("value", F.lit(0.0))
    return table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(F.round(F.sum(F.when(F.col("event_id") % 4 != 0, value)), 4), F.lit(0.0)).alias("fresh"), F.round(F.sum(value), 4).alias("total"))


@query(
    "f19_components",
    "WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 4 + 2 * (s_suppkey % 6) AS b FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "walk(node, reach) AS (SELECT DISTINCT a, a FROM u UNION SELECT w.node, u.b FROM walk w JOIN u ON w.reach = u.a) SELECT node, min(reach) AS component FROM walk GROUP BY node",
)
def f19(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), F.expr("s_suppkey + 4 + 2 * (s_suppkey % 6)").alias("b"))
    return components(e)


DUP = "SELECT l_orderkey AS g, l_linenumber AS ord, l_partkey % 2 AS repair, CAST(l_quantity AS INT) % 3 AS m1, CAST(l_quantity AS INT) % 4 AS m2, l_suppkey % 3 AS m3, l_partkey % 5 AS m4 FROM lineitem"


@query(
    "f20_keep_or_replace",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ord, repair, m1, m2, m3, m4) AS n FROM ({DUP})), f AS (SELECT * FROM r WHERE n = 1), "
    "b AS (SELECT r.g, min(r.n) AS n FROM r JOIN f ON r.g = f.g WHERE f.repair = 0 AND r.repair = 1 AND r.m1 >= f.m1 AND r.m2 >= f.m2 AND r.m3 >= f.m3 AND r.m4 >= f.m4 AND (r.m1 > f.m1 OR r.m2 > f.m2 OR r.m3 > f.m3 OR r.m4 > f.m4) GROUP BY r.g) "
    "SELECT f.g, coalesce(k.ord, f.ord) AS kept, k.ord IS NOT NULL AS replaced FROM f LEFT JOIN b ON b.g = f.g LEFT JOIN r k ON k.g = b.g AND k.n = b.n",
)
def f20(spark: SparkSession, sf: str) -> DataFrame:
    """Of records with one key the first stays, unless it wasn't repaired and a repaired one is at least as good in all four measures and better in one."""
    rows = on_tables(spark, sf, DUP).select("g", F.struct("ord", "repair", "m1", "m2", "m3", "m4").alias("place"), F.col("repair") == 1, F.array("m1", "m2", "m3", "m4")).toDF("g", "place", "repaired", "worth")
    return keep_or_replace(rows, "g").select("g", "place.ord", "replaced").withColumnRenamed("ord", "kept")


@query(
    "f21_inventory_closure",
    "SELECT i.conv_id AS doc, i.turn AS provision, count(c.turn) AS candidates, count(c.turn) FILTER (c.turn % 3 <> 0) AS accepted, count(c.turn) = 0 AS uncovered "
    "FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') i LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') c ON c.conv_id = i.conv_id AND c.turn = i.turn + 1 GROUP BY 1, 2",
)
def f21(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.matching import closure

    c = table(spark, sf, "conversations")
    inventory = c.where("role = 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("provision")).distinct()
    cand = c.where("role = 'assistant'").select(F.col("conv_id").alias("doc"), (F.col("turn") - 1).alias("provision"), (F.col("turn") % 3 != 0).alias("accepted"))
    return closure(inventory, cand)


@query("f22_merge_targets", "SELECT conv_id AS doc, turn // 2 AS ref, string_agg(DISTINCT role, ',' ORDER BY role) AS sources, min(turn) AS first_turn, min_by(text, turn) AS text FROM conversations GROUP BY 1, 2")
def f22(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("ref", F.floor(F.col("turn") / 2))
    return c.groupBy(F.col("conv_id").alias("doc"), "ref").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("sources"), F.min("turn").alias("first_turn"), F.min_by("text", "turn").alias("text"))


@query("f23_window_conflicts", "SELECT l_orderkey AS doc, CASE WHEN count(DISTINCT CAST(l_shipdate AS DATE)) = 1 THEN strftime(min(CAST(l_shipdate AS DATE)), '%Y-%m-%d') END AS end_day, CASE WHEN count(DISTINCT CAST(l_shipdate AS DATE)) > 1 THEN string_agg(DISTINCT strftime(l_shipdate, '%Y-%m-%d'), ',' ORDER BY strftime(l_shipdate, '%Y-%m-%d')) END AS conflict FROM lineitem GROUP BY 1")
def f23(spark: SparkSession, sf: str) -> DataFrame:
    days = F.array_sort(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd")))
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(days.alias("d"))
    return g.select("doc", F.when(F.size("d") == 1, F.col("d")[0]).alias("end_day"), F.when(F.size("d") > 1, F.array_join("d", ",")).alias("conflict"))


@query("f24_clause_inventory", f"WITH {clause_ctes(rules_sql=SUPPLIED_SQL)} SELECT role, kind, count(*) AS clauses, count(DISTINCT rule_id) AS rules FROM kinds GROUP BY ALL")
def f24(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(supplied_rules(spark, sf), None)
    one = [p.select("rule_id", F.lit(r).alias("role"), F.explode(r).alias("c")) for r in ("coverage", "exemption")]
    return one[0].unionByName(one[1]).groupBy("role", F.col("c.clause.kind").alias("kind")).agg(F.count("*").alias("clauses"), F.countDistinct("rule_id").alias("rules"))


both("f25_running_spend", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM events")
