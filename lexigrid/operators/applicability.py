"""Which rules apply to which addresses on a day: rules are parsed once, joined by jurisdiction, and evaluated in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import FACT_OF_REASON, classify, evaluate_clause, split_clauses
from ..functions.dates import temporal_status
from ..functions.kleene import and3, or3

#: The key under which addresses without a jurisdiction meet every rule.
ANYWHERE = "*"


def parsed(rules: DataFrame, as_of_year: int | None) -> DataFrame:
    """rules with the arrays coverage and exemption of (text, clause). Done once a rule, never for each pair."""

    def clauses(column: str, role: str) -> Column:
        return F.transform(split_clauses(F.col(column)), lambda c: F.struct(c.alias("text"), classify(c, F.lit(role), as_of_year).alias("clause")))

    return rules.withColumn("coverage", clauses("coverage_conditions", "coverage")).withColumn("exemption", clauses("exemptions", "exemption"))


def candidates(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """Pairs by an equi-join: a rule of the address's state or local jurisdiction; for an address that has neither (null or empty), each rule that hasn't
    failed. No pair of another jurisdiction is made."""
    keys = F.array_distinct(F.filter(F.array("state_jurisdiction", "local_jurisdiction"), lambda j: F.coalesce(j, F.lit("")) != ""))
    places = addresses.withColumn("key", F.explode(F.when(F.size(keys) == 0, F.array(F.lit(ANYWHERE))).otherwise(keys)))
    by_key = rules.withColumn("key", F.explode(F.when(F.col("status") != "failed", F.array("jurisdiction", F.lit(ANYWHERE))).otherwise(F.array("jurisdiction"))))
    return places.join(by_key, "key")


def outcomes(rules: DataFrame, addresses: DataFrame, as_of: str, gaps: DataFrame | None = None) -> DataFrame:
    """address_id, rule_id, result, omitted, clause, reasons, missing_facts, coverage, exempt, status for each candidate pair.

    rules: rule_id, jurisdiction, status, effective_date (may be partial), coverage_conditions, exemptions. addresses: address_id,
    state_jurisdiction, local_jurisdiction, year_built, units_min, units_max, use_class. gaps: rule_id of rules with an unsettled scope.
    result is applies, unknown, pending or not_yet_effective; NULL if the pair is omitted, and omitted says why.
    """
    rules = parsed(rules, int(as_of[:4]))
    rules = rules.withColumn("gap", F.lit(False)) if gaps is None else rules.join(gaps.select("rule_id").distinct().withColumn("gap", F.lit(True)), "rule_id", "left").fillna(False, ["gap"])
    facts = [F.col(c) for c in ("year_built", "units_min", "units_max", "use_class")]

    def evaluated(column: str) -> Column:
        return F.transform(column, lambda c: F.struct(c["text"].alias("text"), evaluate_clause(c["clause"], column, *facts).alias("r")))

    pairs = candidates(rules, addresses).withColumn("cov", evaluated("coverage")).withColumn("exe", evaluated("exemption"))
    covers = and3(F.transform("cov", lambda c: c["r"]["value"]))
    unknown = F.lit(None).cast("boolean")
    pairs = pairs.withColumn("covers", F.when(F.col("gap"), and3(F.array(covers, unknown))).otherwise(covers)).withColumn("exempt", or3(F.transform("exe", lambda c: c["r"]["value"])))
    pairs = pairs.withColumn("now", temporal_status(F.col("status"), F.col("effective_date"), F.lit(as_of).cast("date")))
    why = F.flatten(F.transform(F.filter(F.concat("cov", "exe"), lambda c: c["r"]["value"].isNull()), lambda c: c["r"]["reasons"]))
    why = F.when(F.col("gap"), F.array_append(why, "extraction_scope_condition_unresolved")).otherwise(why)
    lost = F.col("key") == ANYWHERE
    pairs = pairs.withColumn("reasons", F.when(lost, F.array(F.lit("jurisdiction_unresolved"))).otherwise(F.array_sort(F.array_distinct(why))))
    omitted = F.when(F.col("now") == "failed", "status_failed").when(lost, F.lit(None).cast("string")).when(~F.col("covers"), "coverage_false").when(F.col("exempt"), "exempt")

    def first(column: str, value: bool) -> Column:
        return F.substring(F.try_element_at(F.filter(column, lambda c: c["r"]["value"] == value), F.lit(1))["text"], 1, 120)

    pairs = pairs.withColumn("omitted", omitted).withColumn("clause", F.when(F.col("omitted") == "coverage_false", first("cov", False)).when(F.col("omitted") == "exempt", first("exe", True)))
    result = (
        F.when(F.col("omitted").isNotNull(), F.lit(None).cast("string")).when(lost, "unknown").when(F.col("now").isin("pending", "not_yet_effective"), F.col("now"))
        .when(F.col("covers") & ~F.col("exempt"), "applies").otherwise("unknown")
    )
    shown = F.when(F.col("omitted").isNull(), F.col("reasons")).otherwise(F.array().cast("array<string>"))
    table = F.create_map(*(F.lit(x) for pair in FACT_OF_REASON.items() for x in pair))
    missing = F.array_sort(F.array_distinct(F.array_compact(F.transform(shown, lambda r: F.try_element_at(table, r)))))
    return pairs.select("address_id", "rule_id", result.alias("result"), "omitted", "clause", shown.alias("reasons"), missing.alias("missing_facts"), F.col("covers").alias("coverage"), "exempt", F.col("now").alias("status"), "jurisdiction")


def transitions(rules: DataFrame, addresses: DataFrame, before: str, after: str) -> DataFrame:
    """address_id, rule_id, before, after of pairs whose result changes; affected: it then applies."""
    a = outcomes(rules, addresses, before).select("address_id", "rule_id", F.col("result").alias("before"))
    b = outcomes(rules, addresses, after).select("address_id", "rule_id", F.col("result").alias("after"))
    both = a.join(b, ["address_id", "rule_id"]).where(~F.col("before").eqNullSafe(F.col("after")))
    return both.withColumn("affected", F.coalesce(F.col("after") == "applies", F.lit(False)))
