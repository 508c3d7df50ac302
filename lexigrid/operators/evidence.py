"""Quotes as evidence: whether the words stand in a source of which page furniture (artifacts) was taken out, and where.

Artifacts are array<struct<s, e>> and segments array<struct<number, s, e>> of a row's source, in order; offsets are in characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _piece(source: Column, s: Column, e: Column) -> Column:
    return source.substr(s.cast("int") + 1, (e - s).cast("int"))


def without_artifacts(source: Column, artifacts: Column) -> Column:
    """The source with a space in each artifact's place."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, a: F.struct(F.concat(acc["text"], _piece(source, acc["at"], a["s"].cast("long")), F.lit(" ")).alias("text"), a["e"].cast("long").alias("at"))
    return F.aggregate(artifacts, start, step, lambda acc: F.concat(acc["text"], _piece(source, acc["at"], F.length(source).cast("long"))))


def _overlap(artifacts: Column, start: Column, end: Column) -> Column:
    return F.filter(artifacts, lambda a: (a["s"] < end) & (start < a["e"]))


def verify_evidence(rows: DataFrame, span: str, source: str, artifacts: str, exact: bool = False) -> DataFrame:
    """rows with status, start, end, occurrences and verdict: verified; contains furniture; marker in quote; joins text across furniture; empty; not found.

    exact: only a quote that stands in the source as it is counts as found there; whether it joins text across furniture is judged on folded words either way."""
    if exact:
        x = F.col("__f")
        found = rows.withColumn("__f", T.verify_exact(F.col(span), F.col(source)))
        found = found.withColumn("__f", F.struct(F.when(x.isNull(), "failed").otherwise("exact_match").alias("status"), x["start"].alias("start"), x["end"].alias("end"), x["occurrences"].alias("occurrences")))
    else:
        found = rows.withColumn("__f", T.verify_span(F.col(span), F.col(source)))
    found = found.withColumn("__x", T.verify_span(F.col(span), F.when(F.col("__f.status") == "failed", without_artifacts(F.col(source), F.col(artifacts)))))
    furniture = F.size(_overlap(F.col(artifacts), F.col("__f.start"), F.col("__f.end"))) > 0
    verdict = (
        F.when(~F.coalesce(F.col(span).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False)), "empty")
        .when((F.col("__f.status") != "failed") & furniture, "contains furniture")
        .when(F.col("__f.status") != "failed", "verified")
        .when(F.col(span).rlike(T.MARKER), "marker in quote")
        .when(F.col("__x.status").isin("exact_match", "normalized_match"), "joins text across furniture")
        .otherwise("not found")
    )
    ok = verdict == "verified"
    return found.select(*rows.columns, verdict.alias("verdict"), F.when(ok, F.col("__f.status")).otherwise("failed").alias("status"), *(F.when(ok, F.col(f"__f.{c}")).alias(c) for c in ("start", "end")), F.when(ok, F.col("__f.occurrences")).otherwise(0).alias("occurrences"))


def verify_quote_parts(rows: DataFrame, parts: str, source: str, segments: str, artifacts: str) -> DataFrame:
    """rows with status, start, end, verdict and warning. parts: array<struct<segment, text>>.

    One part is looked for in the segment that it names, else anywhere, with a warning that says where it is. Two parts must be the end of segment n and the start
    of segment n + 1, across exactly one artifact; what is published then runs from the first part's start through the second one's end. More are rejected.
    """
    p, q = F.get(F.col(parts), F.lit(0)), F.get(F.col(parts), F.lit(1))

    def named(x: Column) -> Column:
        return F.get(F.filter(F.col(segments), lambda s: s["number"] == x["segment"]), F.lit(0))

    n = F.size(parts)
    r = rows.withColumn("__1", named(p)).withColumn("__2", named(q))
    s1, s2 = F.col("__1"), F.col("__2")
    text = F.col(source)
    one, two = _piece(text, s1["s"], s1["e"]), _piece(text, s2["s"], s2["e"])
    r = r.withColumn("__local", T.verify_span(p["text"], F.when(n == 1, one)))
    r = verify_evidence(r.withColumn("__span", F.when(n == 1, p["text"])), "__span", source, artifacts).withColumnsRenamed({c: f"__w_{c}" for c in ("verdict", "status", "start", "end", "occurrences")})
    r = r.withColumn("__a", T.verify_anchored(p["text"], F.when(n == 2, one), True)).withColumn("__b", T.verify_anchored(q["text"], F.when(n == 2, two), False))
    local = F.col("__local.status") != "failed"
    lies = F.get(F.filter(F.col(segments), lambda s: (s["s"] <= F.col("__w_start")) & (F.col("__w_end") <= s["e"])), F.lit(0))["number"]
    crossed = F.size(_overlap(F.col(artifacts), s1["e"], s2["s"]))
    both = F.array_max(F.transform(F.array(F.col("__a.status"), F.col("__b.status")), lambda x: F.when(x == "exact_match", 0).when(x == "normalized_match", 1).otherwise(2)))
    verdict = (
        F.when(n == 1, F.when(local, "verified").otherwise(F.col("__w_verdict")))
        .when(n != 2, "more than two parts")
        .when(s1.isNull() | s2.isNull(), "no such segment")
        .when(s2["number"] != s1["number"] + 1, "segments are not adjacent")
        .when(crossed != 1, "not across one artifact")
        .when(F.col("__a.status") == "failed", "part 1 is not at its segment's end")
        .when(F.col("__b.status") == "failed", "part 2 is not at its segment's start")
        .otherwise("verified")
    )
    ok = verdict == "verified"
    status = F.when(~ok, "failed").when(n == 2, F.element_at(F.array(*(F.lit(x) for x in ("exact_match", "normalized_match", "layout_normalized_match"))), both + 1)).when(local, F.col("__local.status")).otherwise(F.col("__w_status"))
    start = F.when(n == 2, s1["s"] + F.col("__a.start")).when(local, s1["s"] + F.col("__local.start")).otherwise(F.col("__w_start"))
    end = F.when(n == 2, s2["s"] + F.col("__b.end")).when(local, s1["s"] + F.col("__local.end")).otherwise(F.col("__w_end"))
    warning = F.when(ok & (n == 1) & ~local, F.concat(F.lit("in segment "), F.coalesce(lies.cast("string"), F.lit("?"))))
    return r.select(*rows.columns, verdict.alias("verdict"), status.alias("status"), F.when(ok, start).cast("long").alias("start"), F.when(ok, end).cast("long").alias("end"), warning.alias("warning"))
