"""Change tests on rule outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .applicability import transitions


def boundary_sets(local_rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """jurisdiction, addresses, shared: the local jurisdictions' address counts, and how many of them lie in another one as well."""
    places = local_rules.select("jurisdiction").distinct()
    met = places.join(addresses.select(F.col("local_jurisdiction").alias("jurisdiction"), "address_id"), "jurisdiction", "left")
    twice = met.where("address_id IS NOT NULL").groupBy("address_id").agg(F.count_distinct("jurisdiction").alias("n")).where("n > 1").select("address_id", F.lit(1).alias("twice"))
    return met.join(twice, "address_id", "left").groupBy("jurisdiction").agg(F.count("address_id").alias("addresses"), F.count("twice").alias("shared"))


def pending_gaps(outcomes: DataFrame, ids: list[str]) -> DataFrame:
    """address_id, missing: of a test's pending rules, those that an address doesn't report as pending. The rules are those of one test, so their list is small."""
    shown = outcomes.groupBy("address_id").agg(F.collect_set(F.when((F.col("result") == "pending") & F.col("rule_id").isin(*ids), F.col("rule_id"))).alias("shown"))
    missing = F.array_sort(F.array_except(F.array(*(F.lit(i) for i in ids)), "shown"))
    return shown.select("address_id", missing.alias("m")).where(F.size("m") > 0).select("address_id", F.array_join("m", ",").alias("missing"))


def negative_violations(outcomes: DataFrame, rules: DataFrame, category: str, endings: list[str]) -> DataFrame:
    """Pairs that show a rule of the category in jurisdictions of which a test says that none may be shown."""
    where = F.lit(False)
    for e in endings:
        where = where | F.endswith(F.col("jurisdiction"), F.lit(e))
    banned = rules.where((F.col("category") == category) & where).select("rule_id")
    return outcomes.where("result IS NOT NULL").join(banned, "rule_id", "left_semi").select("address_id", "rule_id")


def _as_of(test: dict, rules: DataFrame, inside: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rules of the test count as in force from the test's date, unless it takes them as they are stated; affected: what then applies and didn't before."""
    own = rules.where(F.col("rule_id").isin(*test["rule_ids"]))
    if not test.get("as_stated"):
        own = own.withColumn("status", F.lit("in_force")).withColumn("effective_date", F.lit(test.get("effective_date", test["after"])))
    hit = transitions(own, inside, test["before"], test["after"]).where("affected").select("address_id").distinct()
    against = inside.where(F.col("local_jurisdiction").isin(*test.get("conflict_with", []))).select("address_id").join(hit, "address_id", "left_semi")
    return hit.withColumn("role", F.lit("affected")).unionByName(against.withColumn("role", F.lit("conflict")))


def _boundary(test: dict, rules: DataFrame, inside: DataFrame, outcomes: DataFrame) -> DataFrame:
    places = rules.where(F.col("rule_id").isin(*test["rule_ids"])).select(F.col("jurisdiction").alias("local_jurisdiction")).distinct()
    return inside.join(places, "local_jurisdiction", "left_semi").select("address_id", F.lit("affected").alias("role"))


def _pending(test: dict, rules: DataFrame, inside: DataFrame, outcomes: DataFrame) -> DataFrame:
    """affected: shows one of the pending rules; missing: doesn't show all of them; applies: an address, wherever it is, for which one counts as in force."""
    own = outcomes.where(F.col("rule_id").isin(*test["rule_ids"]))
    shown = inside.join(own.where("result = 'pending'").select("address_id", "rule_id"), "address_id", "left").groupBy("address_id").agg(F.count_distinct("rule_id").alias("n"))
    roles = F.array_compact(F.array(F.when(F.col("n") > 0, "affected"), F.when(F.col("n") < len(set(test["rule_ids"])), "missing")))
    wrong = own.where("result = 'applies'").select("address_id", F.lit("applies").alias("role")).distinct()
    return shown.select("address_id", F.explode(roles).alias("role")).unionByName(wrong)


def _negative(test: dict, rules: DataFrame, inside: DataFrame, outcomes: DataFrame) -> DataFrame:
    """surfaced: an address for which a rule of the category is shown, of which the test says that none may be. Nothing is affected."""
    banned = rules.where(F.col("category") == test["category"]).select("rule_id")
    shown = outcomes.where("result IS NOT NULL").join(banned, "rule_id", "left_semi").select("address_id").distinct()
    return inside.select("address_id").join(shown, "address_id", "left_semi").withColumn("role", F.lit("surfaced"))


KINDS = {"as_of": _as_of, "boundary": _boundary, "pending": _pending, "negative": _negative}


def run_tests(tests: list[dict], rules: DataFrame, addresses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """test, kind, role, address_id of each change test: {id, kind, states, rule_ids} and what its kind needs (as_of: before, after, effective_date or
    as_stated, conflict_with; negative: category). Addresses without a state are in no test's set; each test lists them as undetermined. Tests and their rules are few: the
    driver plans one query from them. An unknown kind raises."""
    lost = addresses.where(F.coalesce("state_jurisdiction", F.lit("")) == "").select("address_id")
    parts = []
    for test in tests:
        if test["kind"] not in KINDS:
            raise ValueError(f"unknown kind of change test: {test['kind']}")
        inside = addresses.where(F.col("state_jurisdiction").isin(*test["states"]))
        found = KINDS[test["kind"]](test, rules, inside, outcomes).unionByName(lost.withColumn("role", F.lit("undetermined")))
        parts.append(found.select(F.lit(test["id"]).alias("test"), F.lit(test["kind"]).alias("kind"), "role", "address_id"))
    return reduce(DataFrame.unionByName, parts)


def notes(found: DataFrame, tests: list[dict]) -> DataFrame:
    """test, note: what each test found, in words; also for a test that found nothing."""
    said = {
        "as_of": "%2$s to %3$s: %1$d addresses newly covered; %4$d of them in jurisdictions that conflict.",
        "boundary": "%1$d addresses lie in the rules' own jurisdictions.",
        "pending": "%1$d addresses would be affected if enacted; %5$d lack a pending record.",
        "negative": "The measure failed: affected set empty; %6$d addresses show a rule of its category.",
    }
    spark = found.sparkSession
    rows = spark.createDataFrame([(t["id"], said[t["kind"]], t.get("before"), t.get("after")) for t in tests], "test string, form string, before string, after string")
    roles = ("affected", "conflict", "missing", "surfaced", "undetermined")
    counts = found.groupBy("test").agg(*(F.count_distinct(F.when(F.col("role") == r, F.col("address_id"))).alias(r) for r in roles))
    met = rows.join(counts, "test", "left").fillna(0, list(roles))
    note = F.expr("format_string(form, affected, before, after, conflict, missing, surfaced)")
    open_ = F.when(F.col("undetermined") > 0, F.format_string(" %d addresses without a jurisdiction are in no set.", "undetermined")).otherwise("")
    return met.select("test", F.concat(note, open_).alias("note"))
