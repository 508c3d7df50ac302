"""Checks on rows as columns of messages, and findings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_trusted(rows: DataFrame, trusted: list[str], ignored: list[str]) -> DataFrame:
    """Without fields that only the repository may set, and with a warning for each that was supplied."""
    said = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"trusted field {c} ignored: "), F.col(c))) for c in trusted]
    said += [F.when(F.col(c).isNotNull(), F.lit(f"ignored {c}")) for c in ignored]
    return rows.withColumn("warnings", F.concat_ws("; ", *said)).drop(*trusted, *ignored)


def schema_errors(schema: dict) -> Column:
    """Messages for a row against required, minLength, pattern, minimum, maximum and enum of a JSON schema's properties."""
    checks = []
    required = set(schema.get("required", ()))
    for name, rule in schema["properties"].items():
        c, bad = F.col(name), []
        if "minLength" in rule:
            bad.append((F.length(c) < rule["minLength"], "too short"))
        if "pattern" in rule:
            bad.append((~c.rlike(rule["pattern"]), "pattern"))
        if "minimum" in rule:
            bad.append((c < rule["minimum"], f"under {rule['minimum']}"))
        if "maximum" in rule:
            bad.append((c > rule["maximum"], f"over {rule['maximum']}"))
        if "enum" in rule:
            bad.append((~c.isin(*rule["enum"]), "not allowed"))
        if name in required and not any("minLength" in r for r in [rule]):
            bad.append((c.isNull(), "missing"))
        elif name in required:
            bad = [(test | c.isNull() if message == "too short" else test, message) for test, message in bad]
        checks += [F.when(test, F.lit(f"{name}: {message}")) for test, message in bad]
    return F.array_compact(F.array(*checks))


def strict_verdict(payload: Column, kinds: dict[str, str]) -> Column:
    """ok, or what is wrong with a JSON object that may hold these fields of these types only."""
    value = F.try_parse_json(payload)
    extra = F.size(F.array_except(F.json_object_keys(payload), F.array(*(F.lit(k) for k in kinds)))) > 0
    wrong = F.lit(False)
    for name, kind in kinds.items():
        found = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        wrong = wrong | F.coalesce(found != kind, F.lit(True))
    return F.when(value.isNull(), "not JSON").when(extra, "extra field").when(wrong, "wrong type").otherwise("ok")


def finding(severity: str, name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(severity).alias("severity"), F.lit(name).alias("finding"), F.count("*").alias("n"))


def column_findings(rows: DataFrame, expected: list[str]) -> list[DataFrame]:
    """Two findings: how many of the expected columns are missing, and how many there are besides."""
    missing, extra = len(set(expected) - set(rows.columns)), len(set(rows.columns) - set(expected))
    spark = rows.sparkSession
    return [spark.range(1).select(F.lit(s).alias("severity"), F.lit(n).alias("finding"), F.lit(k).cast("long").alias("n")) for s, n, k in (("ERROR", "missing_column", missing), ("WARNING", "extra_column", extra))]
