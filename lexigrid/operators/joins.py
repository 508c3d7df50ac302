"""Joins that need more than an equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

#: Length of the blocks of an interval join; intervals meet in the blocks that both touch.
BLOCK = 64


def overlaps(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of half-open intervals [s, e) of one doc that overlap. Both sides are dealt to blocks of the axis, and a pair counts in
    the block where its overlap begins, so that a document with many intervals isn't one group of all pairs. Empty intervals overlap nothing."""

    def dealt(x: DataFrame, tag: str) -> DataFrame:
        last = F.floor((F.greatest(F.col("e") - 1, F.col("s"))) / block)
        return x.where("s < e").select("doc", *(F.col(c).alias(c if c not in ("s", "e") else f"{c}{tag}") for c in x.columns if c != "doc"), F.explode(F.sequence(F.floor(F.col("s") / block), last)).alias("block"))

    met = dealt(a, "1").join(dealt(b, "2"), ["doc", "block"]).where("s2 < e1 AND s1 < e2")
    return met.where(F.col("block") == F.floor(F.greatest("s1", "s2") / block)).drop("block")


def crosswalk(places: DataFrame, corpus: DataFrame) -> DataFrame:
    """geoid, jurisdiction, in_corpus: the corpus's name by state and folded name, else the place's own."""
    keyed = places.dropDuplicates(["geoid"]).withColumn("key", F.lower(F.trim("name")))
    met = keyed.join(corpus, ["state", "key"], "left")
    return met.select("geoid", F.coalesce("jurisdiction", "name").alias("jurisdiction"), F.col("jurisdiction").isNotNull().alias("in_corpus"))


def propagate(rules: DataFrame, conditions: DataFrame, doc: str) -> DataFrame:
    """Conditions that reach a rule: ids NULL reaches all rules of the document, [] none, else those that share a provision.
    Named provisions meet by equality; only conditions on a whole document are joined by document."""
    whole = rules.join(conditions.where(F.col("ids").isNull()), doc).drop("ids", "provs")
    named = conditions.where(F.col("ids").isNotNull()).withColumn("p", F.explode("ids")).drop("ids")
    some = rules.withColumn("p", F.explode("provs")).drop("provs").join(named, [doc, "p"]).drop("p").distinct()
    return whole.unionByName(some)


def similar_classes(rows: DataFrame, least: float, block: str | None = None) -> DataFrame:
    """a, b, jaccard, n_a, n_b of classes of rows (id, grams: distinct) that share at least `least` of their grams, within a block if one is given.

    Rows of one gram set are a class, named by its smallest id, of n rows; a class of several rows also has a row with itself, of jaccard 1. So a group of copies is one
    row, not all pairs. Prefix filter: with grams in the order of how many classes hold them, rarest first, two such sets share one of their first n - ceil(least * n) + 1.
    A gram of one class only can't be shared: these go after one count, and only the others are put together again, probed and compared. Classes and what they share
    are tables in the shared folder, made once, and grams are sorted by their number before the block's name. Grams are compared as 64-bit hashes. Sets without grams have no pairs.
    """
    keys = [block] if block else []
    hashed = rows.where(F.size("grams") > 0).select("id", *keys, F.array_sort(F.transform("grams", lambda g: F.xxhash64(g))).alias("grams"))
    mark = {"x": F.xxhash64("grams"), "size": F.size("grams"), "least": F.element_at("grams", 1)}
    classes = kept(hashed.groupBy(*(c.alias(k) for k, c in mark.items()), *keys).agg(F.min("id").alias("id"), F.count("*").alias("n_rows"), F.first("grams").alias("grams")).drop(*mark))
    each = classes.select("id", *keys, "n_rows", F.size("grams").alias("n"), F.explode("grams").alias("h"))
    each = each.withColumn("held", F.count("*").over(Window.partitionBy("h", *keys))).where("held > 1")
    shared = each.groupBy("id", *keys, "n", "n_rows").agg(F.array_sort(F.collect_list(F.struct("held", "h"))).alias("l")).withColumn("ranked", F.col("l.h")).drop("l")
    shared = kept(shared)
    # the grams of one class alone come first
    reach = F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1 - (F.col("n") - F.size("ranked"))
    probe = shared.select("id", *keys, "n", F.explode(F.slice("ranked", F.lit(1), F.greatest(reach, F.lit(0)))).alias("h"))
    left, right = probe.withColumnsRenamed({"id": "a", "n": "n1"}), probe.withColumnsRenamed({"id": "b", "n": "n2"})
    pairs = left.join(right, ["h", *keys]).where((F.col("a") < F.col("b")) & (F.least("n1", "n2") >= F.greatest("n1", "n2") * least)).select("a", "b", "n1", "n2").distinct()
    sets = shared.select("id", "ranked", "n_rows")
    met = pairs.join(sets.withColumnsRenamed({"id": "a", "ranked": "x", "n_rows": "n_a"}), "a").join(sets.withColumnsRenamed({"id": "b", "ranked": "y", "n_rows": "n_b"}), "b")
    both = F.size(F.array_intersect("x", "y"))
    near = met.select("a", "b", (both / (F.col("n1") + F.col("n2") - both)).alias("jaccard"), "n_a", "n_b").where(F.col("jaccard") >= least)
    copies = classes.where("n_rows > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"), F.col("n_rows").alias("n_a"), F.col("n_rows").alias("n_b"))
    return near.unionByName(copies)


def overridden(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with their override; stale if the evidence that it names (non-null fields of `evidence`) no longer holds."""
    met = rows.join(overrides, key, "left")
    stale = F.lit(False)
    for f in fields:
        stale = stale | (F.col(f"evidence.{f}").isNotNull() & ~F.col(f"evidence.{f}").eqNullSafe(F.col(f)))
    return met.withColumn("stale", F.col("evidence").isNotNull() & F.coalesce(stale, F.lit(False)))


def reconcile(left: DataFrame, right: DataFrame, key: str, compare: list[str], only: tuple[str, str]) -> DataFrame:
    """key, state: on which side alone the key is (named by `only`), else which of the compared columns differ (null differs from a value), else same. Keys are distinct on each side."""
    a = left.select(key, F.lit(True).alias("__l"), *(F.col(c).alias(f"__l_{c}") for c in compare))
    b = right.select(key, F.lit(True).alias("__r"), *(F.col(c).alias(f"__r_{c}") for c in compare))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")), F.lit(c)) for c in compare)))
    state = F.when(F.col("__r").isNull(), only[0]).when(F.col("__l").isNull(), only[1]).when(F.size(differ) == 0, "same").otherwise(F.concat(F.lit("differs: "), F.array_join(differ, ", ")))
    return a.join(b, key, "full").select(key, state.alias("state"))
