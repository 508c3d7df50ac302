"""References that name each other, by an index of token runs instead of a comparison of all pairs.

A reference is a list of tokens (`ref_tokens`). Rows are keyed by document and by the reference itself, so copies of a reference are one row; what comes out
are pairs that match, found by equality of whole lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def named_refs(rows: DataFrame, ref: str, ranges: bool = True) -> DataFrame:
    """rows with tokens: one row for each provision that the reference names (ranges expanded, what follows a comma dropped), without empty ones."""
    head = F.element_at(F.split(F.col(ref), ","), 1)
    each = F.explode(T.expand_range(head)) if ranges else head
    return rows.withColumn("__one", each).withColumn("tokens", T.ref_tokens(F.col("__one"))).where(F.size("tokens") > 0).drop("__one")


def _runs(tokens: Column, size: Column) -> Column:
    return F.when(F.size(tokens) >= size, F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.slice(tokens, i, size))).otherwise(F.array().cast("array<array<string>>"))


def _distinct(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(key, F.col("tokens").alias(name)).distinct()


def matching(refs: DataFrame, citations: DataFrame, key: str = "doc") -> DataFrame:
    """key, ref, citation: the distinct references and citations (key, tokens) of which the citation names the reference, as a run of its tokens.

    A citation's runs are made only in the lengths that its document's references have, so that a long text isn't cut in all ways.
    """
    r, c = _distinct(refs, key, "ref"), _distinct(citations, key, "citation")
    sizes = r.select(key, F.size("ref").alias("n")).distinct()
    runs = c.join(sizes, key).where(F.size("citation") >= F.col("n")).select(key, "citation", F.explode(F.array_distinct(_runs(F.col("citation"), F.col("n")))).alias("ref"))
    return runs.join(r, [key, "ref"]).select(key, "ref", "citation")


def ancestors(refs: DataFrame, citations: DataFrame, key: str = "doc") -> DataFrame:
    """key, ref, citation where the citation's tokens end with a proper prefix of the reference's."""
    r, c = _distinct(refs, key, "ref"), _distinct(citations, key, "citation")
    fronts = r.where(F.size("ref") > 1).select(key, "ref", F.explode(F.sequence(F.lit(1), F.size("ref") - 1)).alias("n")).select(key, "ref", F.slice("ref", F.lit(1), F.col("n")).alias("part"))
    sizes = fronts.select(key, F.size("part").alias("n")).distinct()
    ends = c.join(sizes, key).where(F.size("citation") >= F.col("n")).select(key, "citation", F.slice("citation", F.greatest(F.size("citation") - F.col("n") + 1, F.lit(1)), F.col("n")).alias("part"))
    return ends.join(fronts, [key, "part"]).select(key, "ref", "citation").distinct()


def same(refs: DataFrame, others: DataFrame, key: str = "doc") -> DataFrame:
    """key, ref, other that are equal, or of which the shorter has two tokens at least and ends the longer."""

    def ends(df: DataFrame, name: str) -> DataFrame:
        size = F.size(name)
        tails = F.when(size > 2, F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.slice(F.col(name), size - n + 1, n))).otherwise(F.array().cast("array<array<string>>"))
        return df.select(key, name, F.explode(tails).alias("tail"))

    r, o = _distinct(refs, key, "ref"), _distinct(others, key, "other")
    equal = r.join(o.withColumn("ref", F.col("other")), [key, "ref"])
    longer = ends(r, "ref").join(o.withColumn("tail", F.col("other")), [key, "tail"])
    shorter = ends(o, "other").join(r.withColumn("tail", F.col("ref")), [key, "tail"])
    return equal.select(key, "ref", "other").unionByName(longer.select(key, "ref", "other")).unionByName(shorter.select(key, "ref", "other"))


#: Why a provision is asked for again.
UNCOVERED, SUBDIVISION, CHALLENGE = "inventory_uncovered", "subdivision_guard", "scope_challenge"


def answers(targets: DataFrame, candidates: DataFrame, key: str = "doc") -> DataFrame:
    """key, target, candidate: which candidate answers which target.

    targets: key, target, ref, source (one of the three), provision (null if none); candidates: key, candidate, citation, provisions (array). A subdivision is answered by a
    citation that names it; a challenged provision by a link to it; an uncovered one by a link whose citation names it or an ancestor. A candidate without a citation
    answers nothing. Links meet by equality on the provision, names by the index of runs, so nothing is paired that doesn't share one of them.
    """
    t, c = named_refs(targets, "ref"), named_refs(candidates, "citation")
    names = matching(t, c, key)
    of_t = t.select(key, "target", "source", "provision", F.col("tokens").alias("ref"))
    of_c = c.select(key, "candidate", "provisions", F.col("tokens").alias("citation"))
    linked = targets.where(F.col("provision").isNotNull()).join(candidates.where(F.col("citation").isNotNull()).withColumn("provision", F.explode(F.array_distinct("provisions"))), [key, "provision"])
    challenged = linked.where(F.col("source") == CHALLENGE).select(key, "target", "candidate")
    named = of_t.where(F.col("source") == SUBDIVISION).join(names, [key, "ref"]).join(of_c, [key, "citation"]).select(key, "target", "candidate")
    covered = covers(targets.where(F.col("source") == UNCOVERED), candidates, key)
    return challenged.unionByName(named).unionByName(covered).distinct()


def covers(targets: DataFrame, candidates: DataFrame, key: str = "doc") -> DataFrame:
    """key, target, candidate: the answers to uncovered provisions (of targets: key, target, ref, provision). Rows meet by the link alone, once; names are compared only of rows that are linked."""
    t = named_refs(targets.where(F.col("provision").isNotNull()).select(key, "target", "provision", "ref"), "ref").select(key, "target", "provision", F.col("tokens").alias("__ref"))
    c = named_refs(candidates.select(key, "candidate", "provisions", "citation"), "citation").select(key, "candidate", F.explode(F.array_distinct("provisions")).alias("provision"), F.col("tokens").alias("__citation"))
    ref, citation = F.col("__ref"), F.col("__citation")
    return t.join(c, [key, "provision"]).where(T.contains_run(citation, ref) | T.is_ancestor(citation, ref)).select(key, "target", "candidate").distinct()


def unanswered(targets: DataFrame, answered: DataFrame, key: str = "doc") -> DataFrame:
    return targets.join(answered.select(key, "target").distinct(), [key, "target"], "left_anti")


def containers(inventory: DataFrame, conditions: DataFrame, key: str = "doc", tasks: int | None = None) -> DataFrame:
    """key, condition, depth, members: the smallest group of provisions that a condition's own provision stands in and that has all proposed provisions, while
    all in-scope provisions of the group are proposed.

    inventory: key, provision, tokens, in_scope, each provision once; conditions: key, condition, source (its provision, or null), governed (array of provisions, null: the whole document).
    A group is a node of the trie of tokens, a row with its counts; depth 0 is the whole document, null means that no group fits. Each provision counts once for
    each of its prefixes, each proposed one for each of its own, and both meet by the prefix: no list of a node's provisions is made.
    tasks: to how many tasks rows are dealt for each step, so that a task's rows don't grow with the table (null: as the session says).
    """
    front = F.explode(F.transform(F.sequence(F.lit(0), F.size("tokens")), lambda k: F.slice("tokens", F.lit(1), k))).alias("node")

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(tasks, key, *by) if tasks else df

    counted = dealt(inventory.select(key, "in_scope", front), "node")
    nodes = counted.groupBy(key, "node").agg(F.count("*").alias("members"), F.count_if("in_scope").alias("inside"))
    source = inventory.select(key, F.col("provision").alias("source"), "tokens")
    asked = conditions.select(key, "condition", "source", F.array_distinct("governed").alias("governed"))
    own = dealt(asked, "source").join(dealt(source, "source"), [key, "source"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    own = own.select(key, "condition", F.when(F.col("governed").isNotNull(), F.size("governed")).alias("n"), front)
    proposed = dealt(asked.select(key, "condition", F.explode("governed").alias("provision")), "provision").join(dealt(inventory, "provision"), [key, "provision"])
    # each of its prefixes comes after the join, so that rows meet once
    hit = dealt(proposed.select(key, "condition", "in_scope", front), "condition", "node").groupBy(key, "condition", "node").agg(F.count("*").alias("there"), F.count_if("in_scope").alias("there_inside"))
    met = dealt(dealt(own, "node").join(nodes, [key, "node"]), "condition", "node").join(hit, [key, "condition", "node"], "left").fillna(0, ["there", "there_inside"])
    whole = (F.size("node") == 0) & F.col("n").isNull()
    fits = whole | ((F.col("there") == F.col("n")) & (F.col("there_inside") == F.col("inside")))
    found = met.where(fits).groupBy(key, "condition").agg(F.max(F.struct(F.size("node").alias("depth"), "members")).alias("best"))
    return conditions.select(key, "condition").join(found, [key, "condition"], "left").select(key, "condition", "best.depth", "best.members")
