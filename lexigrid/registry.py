"""All queries of the rule engine's operators, by name, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "f4_rule_outcomes"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("sources", "projections", "scalars", "joins", "aggregates", "windows", "sets", "orchestration")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def listed(name: str, column: str, sql: str) -> Callable[[Query], Query]:
    """A query with a list column, which is compared as text."""
    from pyspark.sql import functions as F

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumn(column, F.array_join(F.col(column).cast("array<string>"), "|"))

        query(name, f"SELECT * REPLACE (array_to_string(CAST({column} AS VARCHAR[]), '|') AS {column}) FROM ({sql})")(run)
        return f

    return add


def both(name: str, sql: str) -> None:
    """A query whose statement is plain SQL that either engine takes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return on_tables(spark, sf_dir, sql)

    query(name, sql)(run)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str):
    """On the driver; executors get the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def on_tables(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL on the tables that it names, passed by name: no view is left behind in the session."""
    import re

    known = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql) and t not in frames} | frames
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in known:
        sql = re.sub(rf"(?<![\w.'])(FROM|JOIN|from|join|,)(\s+){name}\b(?!\s*\()", rf"\1\2{{{name}}}", sql)
    used = {n: f for n, f in known.items() if f"{{{n}}}" in sql}
    return spark.sql(sql, **used)


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"lexigrid.plans.{m}")


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
