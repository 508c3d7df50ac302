"""Inputs of the queries: rules and clauses as constants, addresses and their facts from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import on_tables

AS_OF = "2026-10-01"

#: rule_id, jurisdiction, level, category, status, effective_date, coverage_conditions, exemptions
RULES = (
    ("r01", "AMERICA", "state", "rent", "in_force", "2020-01-01", "Units built before January 1, 1995", "Housing owned by a natural person; Hotels and motels"),
    ("r02", "ASIA", "state", "rent", "in_force", "2019", None, "Single-family homes; Buildings constructed after February 1, 1990"),
    ("r03", "EUROPE", "state", "notice", "pending", None, "Applies to all residential units", None),
    ("r04", "AFRICA", "state", "notice", "failed", None, None, None),
    ("r05", "FRANCE", "city", "rent", "in_force", "2027-01-01", "Premises of not more than four units", "Owner-occupied duplex"),
    ("r06", "CHINA", "city", "rent", "in_force", "2024-06", "Certificate of occupancy within the previous fifteen years", None),
    ("r07", "BRAZIL", "city", "eviction", "in_force", "2021-05-05", "First built on or before October 1, 1988, and replacement units", "Condominiums; Units separately alienable"),
    ("r08", "MIDDLE EAST", "state", "eviction", "in_force", "2018-01-01", "When a tenant gives notice of repairs; One-family or two-family houses", "Affordable housing under a regulatory restriction"),
    ("r09", "INDIA", "city", "rent", "in_force", "2022-01-01", "Structures of an unusual kind", None),
    ("r10", "KENYA", "city", "rent", "in_force", "2023-03-03", "Operative condition (unresolved; see the ordinance)", None),
    ("r11", "AMERICA", "state", "fees", "in_force", "2015-07-01", "Residential units in the state", "Software products of an appraisal; Units covered by a local ordinance"),
    ("r12", "GERMANY", "city", "fees", "pending", "2028-01-01", "Duplex properties", "Monthly rent charged on or before January 1, 2020"),
    ("r13", "ASIA", "state", "notice", "in_force", "2026-12", "Applies to any landlord", "Property types such as dormitories, single-family houses"),
    ("r14", "CANADA", "city", "rent", "in_force", "2016-02-29", "Units in the RSO program; Tenancies after termination", "Corporations and owners of two rental properties"),
)
RULE_COLUMNS = "rule_id, jurisdiction, level, category, status, effective_date, coverage_conditions, exemptions"


def values(rows: tuple) -> str:
    """VALUES that either engine reads."""

    def lit(v) -> str:
        return "CAST(NULL AS VARCHAR(400))" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


FACTS_SQL = """
SELECT c.c_custkey AS address_id,
  CASE WHEN c.c_custkey % 50 = 0 THEN NULL ELSE r.r_name END AS state_jurisdiction,
  CASE WHEN c.c_custkey % 50 = 0 THEN NULL ELSE n.n_name END AS local_jurisdiction,
  CAST(o.y - 20 + c.c_custkey % 33 AS INT) AS year_built,
  CAST(nullif(o.n % 7, 0) AS INT) AS units_min,
  CAST(CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE nullif(o.n % 7, 0) + CASE WHEN c.c_custkey % 5 = 0 THEN 2 ELSE 0 END END AS INT) AS units_max,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'apartment' WHEN c.c_custkey % 3 = 1 AND c.c_custkey % 4 = 1 THEN 'subsidized_housing' ELSE NULL END AS use_class
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, min(year(o_orderdate)) AS y FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_tables(spark, sf_dir, FACTS_SQL)


def rules(spark: SparkSession) -> DataFrame:
    kinds = ", ".join(f"{c.strip()} string" for c in RULE_COLUMNS.split(","))
    return spark.createDataFrame([tuple(r) for r in RULES], kinds)


RULES_SQL = f"SELECT * FROM ({values(RULES)}) AS t({RULE_COLUMNS})"

#: A rule for each supplier: one of the constants with an id, a jurisdiction and years of its own.
SUPPLIED_SQL = f"""
SELECT r.rule_id || '-' || CAST(s.s_suppkey AS VARCHAR(20)) AS rule_id, n.n_name AS jurisdiction, r.level, r.category, r.status, r.effective_date,
  replace(r.coverage_conditions, '1995', CAST(1960 + s.s_suppkey % 60 AS VARCHAR(4))) AS coverage_conditions, replace(r.exemptions, '1990', CAST(1970 + s.s_suppkey % 50 AS VARCHAR(4))) AS exemptions
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN (SELECT *, CAST(substr(rule_id, 2, 2) AS INT) - 1 AS place FROM ({RULES_SQL}) q) r ON r.place = s.s_suppkey % {len(RULES)}
"""


def supplied_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_tables(spark, sf_dir, SUPPLIED_SQL)
