"""Invariants of a run: what must never be published. All are evaluated in one pass, counted while the findings are written, and any hit stops the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .graph import shared_folder

#: Of documents, then of candidates.
DOCUMENT = ("source_hash", "tiling", "artifact_text", "published_differs", "primary_identity", "chunk_tiling", "repair_identity", "repair_without_request")
CANDIDATE = ("quote_not_source", "invalid_record", "unverified_scope", "scope_without_link", "mapping_missing", "held_published", "historical_published", "validity_ended", "duplicate_published", "passage_twice")
INVARIANTS = DOCUMENT + CANDIDATE


class IntegrityViolation(RuntimeError):
    """counts: how many documents or candidates break which invariant; path: where the findings are."""

    def __init__(self, counts: dict[str, int], path: str):
        super().__init__(f"{counts}, see {path}")
        self.counts, self.path = counts, path


def _named(**tests: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


def _tiled(pieces: DataFrame, length: DataFrame) -> DataFrame:
    """doc, whole: whether pieces (doc, start, end) cover 0 to n without a gap or overlap. Each piece must begin where as many characters lie before it as
    it says: the sum of lengths, the smallest start and the largest end tell that of pieces that don't overlap, and a lag tells overlaps."""
    before = F.lag("end", 1, 0).over(Window.partitionBy("doc").orderBy("start", "end"))
    p = pieces.withColumn("joins", F.col("start") == before).groupBy("doc").agg(F.bool_and("joins").alias("joined"), F.max("end").alias("last"))
    met = length.join(p, "doc", "left")
    return met.select("doc", F.when(F.col("n") == 0, True).otherwise(F.coalesce(F.col("joined") & (F.col("last") == F.col("n")), F.lit(False))).alias("whole"))


def violations(documents: DataFrame, pieces: DataFrame, chunks: DataFrame, candidates: DataFrame, conditions: DataFrame, mappings: DataFrame, as_of: str) -> DataFrame:
    """doc, index (null for a document's own), violations.

    documents: doc, text, sha256, key, expected_key, repaired, repair_key, expected_repair_key, published (array of indices). pieces: doc, start, end, artifact (its recorded text, null for
    segments). chunks: doc, start, end, of large documents. candidates: doc, index, origin, accepted, held, historical, duplicate_of, category, start, end, quote, valid, ends (a date or null), provisions,
    applied (array of struct<condition, mode, governed>). conditions: doc, condition, verified. mappings: doc, condition, provision: those that apply.
    """
    length = documents.select("doc", F.length("text").alias("n"))
    text = documents.select("doc", "text")
    artifact = pieces.where("artifact IS NOT NULL").join(text, "doc").where(F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) != F.col("artifact")).select("doc").distinct()
    own = candidates.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("accepted"), F.col("index")))).alias("accepted"), F.count_if(F.col("origin") == "repair").alias("n_repair"))
    d = documents.join(_tiled(pieces, length).withColumnRenamed("whole", "tiled"), "doc", "left").join(artifact.withColumn("altered", F.lit(True)), "doc", "left").join(own, "doc", "left")
    d = d.join(_tiled(chunks, length.join(chunks.select("doc").distinct(), "doc", "left_semi")).withColumnRenamed("whole", "chunked"), "doc", "left")
    none = F.array().cast("array<bigint>")
    of_documents = d.select("doc", F.lit(None).cast("long").alias("index"), _named(
        source_hash=F.col("sha256") != F.sha2("text", 256), tiling=~F.col("tiled"), artifact_text=F.col("altered"), published_differs=F.array_sort("published") != F.coalesce("accepted", none),
        primary_identity=~F.col("key").eqNullSafe(F.col("expected_key")), chunk_tiling=~F.col("chunked"), repair_identity=F.col("repaired") & ~F.col("repair_key").eqNullSafe(F.col("expected_repair_key")),
        repair_without_request=~F.col("repaired") & (F.col("n_repair") > 0),
    ).alias("violations"))
    applied = candidates.where("accepted").select("doc", "index", "provisions", F.explode("applied").alias("x")).select("doc", "index", "provisions", "x.*")
    sure = conditions.where("verified").select("doc", "condition").distinct().withColumn("sure", F.lit(True))
    linked = mappings.groupBy("doc", "condition").agg(F.collect_set("provision").alias("mapped"))
    met = applied.join(sure, ["doc", "condition"], "left").join(linked, ["doc", "condition"], "left")
    scoped = met.groupBy("doc", "index").agg(
        F.bool_or(F.col("sure").isNull()).alias("unsure"), F.bool_or(F.col("governed").isNotNull() & ~F.arrays_overlap("governed", "provisions")).alias("apart"),
        F.bool_or((F.col("mode") == "named_subject") & (F.col("mapped").isNull() | ~F.arrays_overlap("mapped", "provisions"))).alias("unmapped"),
    )
    twice = candidates.where("accepted").groupBy("doc", "category", "quote").agg(F.count("*").alias("n"), F.min("index").alias("index")).where("n > 1").select("doc", "index", F.lit(True).alias("twice"))
    c = candidates.join(text, "doc", "left").join(scoped, ["doc", "index"], "left").join(twice, ["doc", "index"], "left")
    there = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    a = F.col("accepted")
    of_candidates = c.select("doc", F.col("index").cast("long").alias("index"), _named(
        quote_not_source=a & ~F.coalesce(there == F.col("quote"), F.lit(False)), invalid_record=a & ~F.col("valid"), unverified_scope=F.col("unsure"), scope_without_link=F.col("apart"), mapping_missing=F.col("unmapped"),
        held_published=a & F.col("held"), historical_published=a & F.col("historical"), validity_ended=a & (F.col("ends") <= F.lit(as_of).cast("date")), duplicate_published=a & F.col("duplicate_of").isNotNull(), passage_twice=F.col("twice"),
    ).alias("violations"))
    return of_documents.unionByName(of_candidates).where(F.size("violations") > 0)


def enforce(found: DataFrame) -> str:
    """Writes the findings (doc, index, violations) once, counting them on the way, and stops the run if there are any."""
    seen = Observation()
    path = shared_folder(found.sparkSession)
    found.observe(seen, *(F.count_if(F.array_contains("violations", n)).alias(n) for n in INVARIANTS)).write.parquet(path)
    if counts := {n: k for n, k in seen.get.items() if k}:
        raise IntegrityViolation(counts, path)
    return path
