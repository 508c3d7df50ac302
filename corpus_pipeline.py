"""A corpus pipeline of four stages: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the columns of documents:
doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import table, written
from lexigrid.llm.components import connected_components
from lexigrid.llm.line_quality import assess
from lexigrid.llm.pow2_packing import bucketed, digest
from lexigrid.llm.shingle_pairs import similar_groups
from lexigrid.llm.simhash_gph import near_duplicates
from lexigrid.llm.substring_dedup import remove_repeats
from lexigrid.llm.tokens import public_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose the lines above the limit, and n_chars follows.

    A line's limit counts distinct texts here, so that a clean document isn't rejected for its copies, which are the next stage's. Null and empty texts are
    rejected, repeated rows get one verdict, documents without a host form one host, an empty table gives no rows.
    """
    found = assess(docs.select(*COLUMNS), count="texts").where("kept")
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("removed_chars") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest doc_id (null is smallest), then of the smallest text hash.

    Rows are linked by op9's fingerprints of at most two differing bits, found by its pigeonhole keys, and, as these miss copies with more changes, also by Jaccard similarity of
    0.8 or more of five-word shingles; a group is what links of either kind reach.
    """
    docs = docs.select(*COLUMNS).withColumn("__th", F.xxhash64("text"))
    keyed = docs.select(F.struct("doc_id", "__th").alias("key"), "text")
    groups = near_duplicates(keyed, id_col="key").select("doc_id", "component_id").unionByName(similar_groups(keyed, id_col="key"))
    later = connected_components(groups.where(F.col("doc_id") != F.col("component_id")), "doc_id", "component_id")
    gone = later.select(F.col("node.doc_id").alias("__id"), F.col("node.__th").alias("__mark"))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__mark")), "left_anti")
    return kept.dropDuplicates(["doc_id", "__th"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars follows.

    A null text stays null, a text of under 20 words stays whole, repeated rows get the same text, rows of one id are ordered by a hash of the text, a null id is the
    smallest, an empty table gives no rows.
    """
    found = remove_repeats(docs.select(*COLUMNS))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of power-of-two length, read back from the buckets. Null texts count as empty, repeated rows are packed once each, an
    empty table gives no rows, other columns are not read."""
    return digest(bucketed(docs, public_file("byte_bpe_50k.json")))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pow2_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the tokenizer or the fingerprints' components; tests/llm has a brute-force version.
ORACLE_SQL = None
