"""Extraction from stored responses: one request for a document (or one for each chunk of a large one), checks, at most one repair request, and a verdict.

A run is a set of tables keyed by document: provisions, scope conditions and candidates of the responses, evaluated by joins. What the checks leave open names
the targets of a second request; its identity holds the sorted targets, so a stored response is found only by exactly the same set. Nothing is requested twice.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions.posture import EXPECTED, establish_posture
from ..functions.scope import scope_mode
from .graph import kept
from .references import covers, unanswered
from .references import same as same_refs
from .references import named_refs
from .reviews import request_identity

_SCOPES = ("in_scope", "out_of_scope", "uncertain")
_STATUSES = ("enacted", "pending", "failed")
RULE = "struct<category:string,quote:string,citation:string,provision_ids:array<string>,enactment_status:string,status_evidence:string,effective_date:string,date_evidence:string>"
PAYLOAD = (
    "struct<document:struct<posture:string,evidence:string>,provisions:array<struct<id:string,ref:string,scope:string,category:string>>,"
    "global_scope:array<struct<id:string,statement:string,evidence:string,governed:array<string>>>,"
    f"rules:array<{RULE}>,no_rules:struct<reason:string,evidence:string>,"
    "target_resolutions:array<struct<ref:string,scope:string,reason:string,evidence:string>>,"
    "scope_mappings:array<struct<condition:string,provision:string,decision:string,reason:string,evidence:string>>>"
)
#: Codes of what keeps a document from being complete.
REASONS = (
    "response_unprocessable", "inventory_invalid", "inventory_empty", "unjustified_empty_result", "inventory_uncertain", "held", "status_posture_mismatch", "scope_mapping_unresolved",
    "scope_mapping_unverified", "legislative_status_conflict", "scope_not_applied", "repair_target_unresolved", "provision_without_record", "provision_all_rejected", "uncovered_subdivision",
    "repair_failed", "chunk_not_extracted",
)


def parse_responses(rows: DataFrame) -> DataFrame:
    """rows with payload -> r (null if it can't be used) and error. Each payload is parsed once: what a generator gives isn't computed again where it is used."""
    read = F.struct(F.try_parse_json("payload").isNotNull().alias("json"), F.from_json("payload", PAYLOAD).alias("r"))
    read = rows.withColumn("__x", F.explode(F.array(read)))
    error = F.when(F.col("payload").isNull(), "no stored response").when(~F.col("__x.json"), "not JSON").when(F.col("__x.r.rules").isNull(), "no list of rules")
    return read.withColumn("error", error).withColumn("r", F.when(F.col("error").isNull(), F.col("__x.r"))).drop("payload", "__x")


def _stands(span: Column, text: Column) -> Column:
    """Where the words stand in the text as they are (from 0); NULL if they don't, or are blank."""
    at = F.instr(text, span)
    return F.when(span.rlike(r"(?U)[^\s\x1c-\x1f]") & (at > 0), at - 1)


def _found(exact: Column, span: Column, text: Column) -> Column:
    loose = T.verify_span(F.when(exact.isNull(), span), F.when(exact.isNull() & span.isNotNull(), text))
    return F.when(exact.isNotNull(), F.struct(F.lit("exact_match").alias("status"), exact.alias("start"), (exact + F.length(span)).alias("end"))).otherwise(
        F.struct(F.coalesce(loose["status"], F.lit("failed")).alias("status"), loose["start"].alias("start"), loose["end"].alias("end"))
    )


def located(span: Column, text: Column) -> Column:
    """struct(status, start, end) of words in a text: by built-in functions where they stand as they are, else by the looser tiers."""
    return _found(_stands(span, text), span, text)


def _within(rows: DataFrame, docs: DataFrame, more: tuple[str, ...] = (), /, **spans: str) -> DataFrame:
    """rows with, for each name, where the words of that column stand in their document's text; for rows with raw_start and raw_end only between these. more: columns of docs to be kept.

    Only the texts in which some words don't stand as they are go on to the looser tiers, in Python."""
    met = rows.join(docs.select("doc", "text", *more), "doc", "left")
    moved = F.lit(0)
    if "raw_start" in rows.columns:
        moved = F.coalesce(F.col("raw_start"), F.lit(0)).cast("int")
        piece = F.substring(F.col("text"), moved + 1, (F.col("raw_end") - moved).cast("int"))
        met = met.withColumn("text", F.when(F.col("raw_start").isNull(), F.col("text")).otherwise(piece))
    met = met.withColumns({f"__{name}": _stands(F.col(column), F.col("text")) for name, column in spans.items()})
    wanting = [F.col(column).isNotNull() & F.col(f"__{name}").isNull() for name, column in spans.items()]
    met = met.withColumn("text", F.when(F.coalesce(F.greatest(*wanting) if len(wanting) > 1 else wanting[0], F.lit(False)), F.col("text")))
    for name, column in spans.items():
        at = _found(F.col(f"__{name}"), F.col(column), F.col("text"))
        met = met.withColumn(name, F.struct(at["status"].alias("status"), (at["start"] + moved).alias("start"), (at["end"] + moved).alias("end")))
    return met.drop("text", *(f"__{name}" for name in spans))


@dataclass(frozen=True)
class Merged:
    """What the responses to a document's requests say together.

    documents: doc, posture, evidence, empty (why there are no rules, its evidence), n_rules, parts, failed (parts without a usable response), listed (an inventory is there).
    items: doc, part, place, provision, ref, scope, category. conditions: doc, condition, statement, evidence, governed. rules: doc, index, rule, and the chunk's raw_start and raw_end.
    """

    documents: DataFrame
    items: DataFrame
    conditions: DataFrame
    rules: DataFrame


def merge(parsed: DataFrame) -> Merged:
    """parsed: doc, part (from 1), tag (null: ids stay as they are), r, error.

    Ids get their part's tag; a part's condition for the whole document is one for that part's own provisions; the first part that declares a
    posture decides it, and the first that explains an empty result, if no part has rules.
    """

    def own(c: Column) -> Column:
        return F.when(F.col("tag").isNull() | (c == ""), c).otherwise(F.concat("tag", F.lit("."), c))

    def first(c: str) -> Column:
        return F.min_by(f"r.{c}", F.when(F.col(f"r.{c}").isNotNull(), F.col("part")))

    listed = F.coalesce(F.bool_and(F.when(F.col("r").isNotNull(), F.col("r.provisions").isNotNull())), F.lit(False))
    n_rules = F.coalesce(F.sum(F.coalesce(F.size("r.rules"), F.lit(0))), F.lit(0))
    d = parsed.groupBy("doc").agg(first("document").alias("d"), first("no_rules").alias("e"), n_rules.alias("n_rules"), F.count("*").alias("parts"), F.count("error").alias("failed"), listed.alias("listed"))
    documents = d.select("doc", "d.posture", "d.evidence", F.when(F.col("n_rules") == 0, F.col("e")).alias("empty"), "n_rules", "parts", "failed", "listed")
    items = parsed.select("doc", "part", "tag", F.posexplode("r.provisions").alias("place", "x")).select("doc", "part", "place", own(F.col("x.id")).alias("provision"), "x.ref", "x.scope", "x.category")
    ids = F.array_sort(F.filter(F.transform(F.col("r.provisions"), lambda x: own(x["id"])), lambda x: x.isNotNull()))
    governed = F.when(F.col("x.governed").isNotNull(), F.transform("x.governed", own)).when(F.col("tag").isNotNull(), F.coalesce(F.col("ids"), F.array().cast("array<string>")))
    conditions = parsed.select("doc", "part", "tag", ids.alias("ids"), F.posexplode("r.global_scope").alias("place", "x"))
    conditions = conditions.select("doc", "part", "place", own(F.col("x.id")).alias("condition"), "x.statement", "x.evidence", governed.alias("governed"))
    rules = parsed.select("doc", "part", "tag", "raw_start", "raw_end", F.posexplode_outer("r.rules").alias("place", "rule")).where("place IS NOT NULL")
    links = F.when(F.col("rule").isNotNull(), F.col("rule").withField("provision_ids", F.transform("rule.provision_ids", own)))
    index = F.row_number().over(Window.partitionBy("doc").orderBy("part", "place")) - 1
    return Merged(documents, items, conditions, rules.select("doc", index.cast("long").alias("index"), links.alias("rule"), "raw_start", "raw_end"))


def inventory(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The well-formed items, of repeated ids the first, and doc, bad: how many are not."""
    sound = F.col("provision").isNotNull() & F.col("ref").isNotNull() & F.coalesce(F.col("scope").isin(*_SCOPES), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("doc", "provision").orderBy(F.col("sound").desc(), "part", "place"))
    rows = kept(items.withColumn("sound", sound).withColumn("ok", F.col("sound") & (nth == 1)))
    return rows.where("ok").drop("ok", "sound"), rows.where("NOT ok").groupBy("doc").agg(F.count("*").alias("bad"))


def evaluate(rules: DataFrame, docs: DataFrame, postures: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """doc, index, origin, rule, citation, provisions, record_id, at, reasons, unresolved, mismatch, worth, accepted: each candidate with all that speaks against it.

    rules: doc, index, origin, rule, and raw_start and raw_end of a chunk whose words they quote (null: the whole text); postures: doc, established. unresolved: why the time of application isn't known, which alone only holds the record. worth: the
    verified facts that a duplicate is compared by.
    """
    r = F.col("rule")
    known = items.select("doc", F.col("provision").alias("link")).withColumn("known", F.lit(True))
    links = rules.select("doc", "index", "origin", F.explode_outer("rule.provision_ids").alias("link")).join(known, ["doc", "link"], "left")
    links = links.groupBy("doc", "index", "origin").agg(F.count("link").alias("n_links"), F.count_if(F.col("link").isNotNull() & F.col("known").isNull()).alias("unknown"))
    met = rules.join(postures.select("doc", "established"), "doc", "left").join(links, ["doc", "index", "origin"], "left")
    met = met.withColumns({"q": r["quote"], "se": r["status_evidence"], "de": r["date_evidence"]})
    met = _within(met, docs, at="q", status_at="se", date_at="de")
    malformed = r.isNull() | r["category"].isNull() | r["quote"].isNull() | ~F.coalesce(r["enactment_status"].isin(*_STATUSES), F.lit(False))
    status_ok, date_ok = F.col("se").isNotNull() & (F.col("status_at.status") != "failed"), F.col("de").isNotNull() & (F.col("date_at.status") != "failed")
    proposal = r["enactment_status"].isin("pending", "failed")
    dated = date_ok & r["effective_date"].isNotNull() & F.coalesce(F.exists(D.calendar_dates(r["date_evidence"]), lambda d: F.startswith(d.cast("string"), r["effective_date"])), F.lit(False))
    effective = F.when(dated, r["effective_date"])
    codified = F.coalesce(F.col("established") == "codified_current_law", F.lit(False))
    status = D.derive_status(r["enactment_status"], effective, date_ok & ~dated & r["effective_date"].isNull(), F.lit(as_of).cast("date"), codified)
    unresolved = F.when(~malformed & status["status"].isNull(), F.concat(F.lit("status: "), status["why"]))
    reasons = [
        F.when(malformed, "malformed"),
        F.when(F.col("unknown") > 0, "provision link: unknown"),
        F.when(~malformed & (F.col("at.status") == "failed"), "citation: quote not found"),
        F.when(~malformed & F.col("se").isNotNull() & ~status_ok, "citation: status evidence not found"),
        F.when(~malformed & proposal & F.col("se").isNull(), "status: proposal without evidence"),
        F.when(~malformed & F.col("de").isNotNull() & ~date_ok, "citation: date evidence not found"),
        F.when(~malformed & r["effective_date"].isNotNull() & ~dated, "date: not in its evidence"),
        unresolved,
    ]
    expected = F.element_at(F.create_map(*(F.lit(x) for p in EXPECTED.items() for x in p)), F.coalesce("established", F.lit("unknown")))
    out = met.select(
        "doc", "index", "origin", "rule", r["citation"].alias("citation"), F.coalesce(r["provision_ids"], F.array().cast("array<string>")).alias("provisions"), F.col("at.start").alias("start"), F.col("at.end").alias("end"),
        T.record_id(F.col("doc").cast("string"), r["category"], F.col("at.start").cast("string"), F.col("at.end").cast("string"), r["citation"]).alias("record_id"),
        F.array_compact(F.array(*reasons)).alias("reasons"), unresolved.alias("unresolved"),
        F.coalesce(~malformed & (expected != r["enactment_status"]), F.lit(False)).alias("mismatch"), F.array(dated.cast("int"), status_ok.cast("int"), date_ok.cast("int")).alias("worth"),
    )
    return out.withColumn("accepted", F.size("reasons") == 0)


def _repeated(candidates: DataFrame) -> DataFrame:
    """Of accepted candidates with the same id all but the first are rejected."""
    w = Window.partitionBy("doc", "record_id", "accepted").orderBy("index")
    again = F.col("accepted") & (F.row_number().over(w) > 1)
    return _rejected(candidates.withColumn("__again", again), "__again", F.lit("duplicate: same record id")).drop("__again")


def _rejected(candidates: DataFrame, when: str, reason: Column) -> DataFrame:
    hit = F.coalesce(F.col(when), F.lit(False))
    return candidates.withColumn("reasons", F.when(hit, F.concat("reasons", F.array(reason))).otherwise(F.col("reasons"))).withColumn("accepted", F.col("accepted") & ~hit)


def same_source(candidates: DataFrame) -> DataFrame:
    """Of accepted candidates of one passage and category one stays: the first, or the first repaired one whose verified facts are nowhere fewer and
    somewhere more than those of a first one that wasn't repaired."""
    w = Window.partitionBy("doc", "rule.category", "start", "end", "accepted")
    ordered = w.orderBy("index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.first(F.struct("index", "origin", "worth")).over(ordered)
    c = candidates.withColumn("__lead", lead)
    better = F.forall(F.zip_with("worth", "__lead.worth", lambda a, b: a >= b), lambda x: x) & (F.col("worth") != F.col("__lead.worth"))
    c = c.withColumn("__better", F.when((F.col("origin") == "repair") & (F.col("__lead.origin") == "primary") & better, F.col("index")))
    c = c.withColumn("__keep", F.coalesce(F.min("__better").over(w), F.col("__lead.index")))
    c = c.withColumn("__drop", F.col("accepted") & (F.col("index") != F.col("__keep")))
    return _rejected(c, "__drop", F.concat(F.lit("duplicate: same passage as "), F.col("__keep").cast("string"))).drop("__lead", "__better", "__keep", "__drop")


def keep_or_replace(rows: DataFrame, key: str) -> DataFrame:
    """key, place, replaced: of each key's rows (place: their order; repaired; worth: an array of numbers) the first, or if that wasn't repaired the first repaired one
    that is worth at least as much in each number and more in one. Two aggregations and a join by key, so no list of a key's rows is made."""
    first = rows.groupBy(key).agg(F.min(F.struct("place", "repaired", "worth")).alias("lead"))
    met = rows.where("repaired").join(first.where("NOT lead.repaired"), key)
    better = F.forall(F.zip_with("worth", "lead.worth", lambda a, b: a >= b), lambda x: x) & (F.col("worth") != F.col("lead.worth"))
    found = met.where(better).groupBy(key).agg(F.min("place").alias("better"))
    return first.join(found, key, "left").select(key, F.coalesce("better", "lead.place").alias("place"), F.col("better").isNotNull().alias("replaced"))


def asked_for(items: DataFrame) -> DataFrame:
    """doc, provision, target, ref: each provision that the in-scope items name, ranges expanded."""
    refs = items.where("scope = 'in_scope'").select("doc", "provision", F.explode(T.expand_range(F.trim(F.element_at(F.split("ref", ","), 1)))).alias("ref"))
    return refs.select("doc", "provision", F.concat_ws(" ", "provision", "ref").alias("target"), "ref").distinct()


def _covers(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc, target, index: which candidate answers which target. It depends on what candidates name, not on what becomes of them, so it is found once for each."""
    return covers(asked, candidates.select("doc", F.col("index").alias("candidate"), "citation", "provisions")).withColumnRenamed("candidate", "index")


def coverage(asked: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """asked with n_candidates, n_accepted, n_held: of the candidates that answer it."""
    met = links.join(candidates.select("doc", "index", "accepted", "held"), ["doc", "index"])
    n = met.groupBy("doc", "target").agg(F.count("*").alias("n_candidates"), F.count_if("accepted").alias("n_accepted"), F.count_if("held").alias("n_held"))
    return asked.join(n, ["doc", "target"], "left").fillna(0, ["n_candidates", "n_accepted", "n_held"])


def _coded(rows: DataFrame, **codes: Column) -> DataFrame:
    """doc, code of each condition that a row meets."""
    return rows.select("doc", F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in codes.items())))).alias("code"))


def _held(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("held", F.coalesce(~F.col("accepted") & (F.col("reasons") == F.array("unresolved")), F.lit(False)))


def _mappings(conditions: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc, condition, provision: the pairs of a verified condition on a named subject and a provision that it proposes and a publishable record links."""
    linked = candidates.where("accepted OR held").select("doc", F.explode("provisions").alias("provision")).distinct()
    named = conditions.where("applied AND mode = 'named_subject'")
    some = named.where("governed IS NOT NULL").select("doc", "condition", F.explode("governed").alias("provision")).join(linked, ["doc", "provision"], "left_semi")
    every = named.where("governed IS NULL").select("doc", "condition").join(linked, "doc")
    return some.select("doc", "condition", "provision").unionByName(every.select("doc", "condition", "provision")).distinct()


@dataclass(frozen=True)
class Run:
    """documents: doc, status, reasons (codes), requests, n_candidates, n_accepted, n_held; candidates: as evaluated, with held and state; targets: doc, ref, resolution, why."""

    documents: DataFrame
    candidates: DataFrame
    targets: DataFrame


def identity(docs: DataFrame, settings: dict[str, str], of: str, **more: Column) -> Column:
    """The key of a document's request. docs: doc, text; settings: the constant fields."""
    fields = {k: F.lit(v) for k, v in settings.items()} | {"pass": F.lit(of), "source_doc_id": F.col("doc").cast("string"), "source_sha256": F.sha2(F.col("text"), 256), "view_sha256": F.sha2(F.col("text"), 256)}
    return request_identity(fields, **more)


def repair_key(primary: Column, refs: Column, mappings: Column, settings: dict[str, str]) -> Column:
    """The key of a repair request: of the first request, its sorted targets and pairs to be mapped."""
    return F.sha2(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(settings.items())), F.lit("repair").alias("pass"), primary.alias("primary"), F.array_sort(refs).alias("targets"), F.array_sort(mappings).alias("mappings"))), 256)


def extract(docs: DataFrame, requests: DataFrame, responses: DataFrame, settings: dict[str, str], as_of: str, repair: bool = True) -> Run:
    """docs: doc, text; requests: doc, part, tag, key, and of chunks raw_start, raw_end; responses: key, payload. Each document's requests meet the stored responses by key; what isn't stored is an error of
    that part, the others are kept. The second request is made only for documents with targets or pairs to map, once.

    A null text counts as empty: nothing is found in it. An empty table gives empty tables. A repeated key counts once (its smallest payload).
    """
    docs = docs.select("doc", F.coalesce("text", F.lit("")).alias("text"))
    stored = responses.groupBy("key").agg(F.min("payload").alias("payload"))
    if "raw_start" not in requests.columns:
        requests = requests.withColumns({"raw_start": F.lit(None).cast("long"), "raw_end": F.lit(None).cast("long")})
    parsed = kept(parse_responses(requests.join(stored, "key", "left")))
    m = merge(parsed)
    m = replace(m, documents=kept(m.documents))
    items, bad = inventory(m.items)
    recorded = docs.withColumn("recorded", F.col("text").rlike(D.BASE_DATE))
    declared = _within(m.documents.withColumn("justified", F.col("empty.evidence")), recorded, ("recorded",), posture_at="evidence", empty_at="justified")
    established = establish_posture(F.col("posture"), F.col("evidence"), F.col("posture_at.status"), F.coalesce("recorded", F.lit(False)))
    known = items.groupBy("doc").agg(F.count("*").alias("n_items"), F.count_if(F.col("scope") == "uncertain").alias("uncertain")).join(bad, "doc", "full")
    documents = kept(declared.withColumn("established", established["established"]).join(known, "doc", "left").fillna(0, ["n_items", "uncertain", "bad"]).drop("posture_at", "recorded"))
    conditions = kept(_conditions(m.conditions, docs, items))
    first = kept(_held(_repeated(evaluate(m.rules.withColumn("origin", F.lit("primary")), docs, documents, items, as_of))))
    named = kept(asked_for(items))
    links = kept(_covers(named, first))
    open_refs = kept(named.join(links, ["doc", "target"], "left_anti").select("doc", "provision", "target", "ref"))
    pairs = kept(_mappings(conditions, first))
    asked = open_refs.groupBy("doc").agg(F.collect_set("ref").alias("refs")).join(pairs.groupBy("doc").agg(F.collect_set(F.concat_ws(" ", "condition", "provision")).alias("pairs")), "doc", "full")
    primary = requests.groupBy("doc").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("key")), ","), 256).alias("primary"))
    none = F.array().cast("array<string>")
    key = repair_key(F.col("primary"), F.coalesce("refs", none), F.coalesce("pairs", none), settings)
    second = asked.join(primary, "doc").select("doc", F.lit(1).alias("part"), F.lit(None).cast("string").alias("tag"), key.alias("key"))
    second = kept(parse_responses(second.join(stored, "key", "left"))) if repair else None
    return _finish(docs, documents, items, conditions, first, named, links, open_refs, pairs, second, as_of)


def _conditions(conditions: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc, condition, statement, governed, mode, applied: conditions are applied if they are the first of their id, their evidence stands in the text and all provisions that they govern are known."""
    nth = F.row_number().over(Window.partitionBy("doc", "condition").orderBy("part", "place"))
    rows = _within(conditions.withColumn("nth", nth).where("nth = 1"), docs, at="evidence")
    known = items.select("doc", F.col("provision").alias("g")).withColumn("known", F.lit(1))
    each = rows.select("doc", "condition", F.explode("governed").alias("g")).join(known, ["doc", "g"], "left").groupBy("doc", "condition").agg(F.bool_and(F.col("known").isNotNull()).alias("all_known"))
    met = rows.join(each, ["doc", "condition"], "left")
    applied = (F.col("at.status") != "failed") & F.col("evidence").isNotNull() & (F.col("governed").isNull() | F.coalesce("all_known", F.lit(False)))
    return met.select("doc", "condition", "statement", "governed", scope_mode(F.coalesce("statement", F.lit(""))).alias("mode"), applied.alias("applied"))


def _resolutions(second: DataFrame, targets: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, target, scope, proven: the repair's classification of each target, of several the first; proven: with a reason and evidence from the text."""
    said = second.select("doc", F.posexplode("r.target_resolutions").alias("place", "x")).select("doc", "place", "x.*")
    said = _within(said, docs, at="evidence").withColumn("proven", F.coalesce((F.col("reason") != "") & (F.col("at.status") != "failed"), F.lit(False)))
    a, b = named_refs(targets.select("doc", "target", "ref"), "ref", ranges=False), named_refs(said, "ref", ranges=False)
    met = same_refs(a, b).join(a.select("doc", "target", F.col("tokens").alias("ref")), ["doc", "ref"]).join(b.select("doc", F.col("tokens").alias("other"), "place", "scope", "proven"), ["doc", "other"])
    return met.groupBy("doc", "target").agg(F.min_by(F.struct("scope", "proven"), "place").alias("x")).select("doc", "target", "x.scope", "x.proven")


def _repaired(docs, documents, items, first, named, targets, second, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The second response's classification of the targets, its candidates, and which of these answer what."""
    classified = kept(_resolutions(second, targets, docs))
    last = first.groupBy("doc").agg((F.max("index") + 1).alias("n"))
    more = second.select("doc", F.posexplode_outer("r.rules").alias("place", "rule")).where("place IS NOT NULL").join(last, "doc", "left")
    nowhere = F.lit(None).cast("long")
    more = more.select("doc", (F.coalesce("n", F.lit(0)) + F.col("place")).cast("long").alias("index"), F.lit("repair").alias("origin"), "rule", nowhere.alias("raw_start"), nowhere.alias("raw_end"))
    again = kept(evaluate(more, docs, documents, items, as_of))
    links = kept(_covers(named, again))
    hits = links.join(targets.select("doc", "target"), ["doc", "target"], "left_semi").join(classified, ["doc", "target"], "left")
    hits = hits.groupBy("doc", "index").agg(F.bool_and(F.coalesce(F.col("scope").isin("out_of_scope", "uncertain"), F.lit(False))).alias("declined"))
    again = again.join(hits, ["doc", "index"], "left")
    again = _rejected(again.withColumn("__x", F.col("declined").isNull()), "__x", F.lit("repair: answers no target"))
    return classified, _rejected(again.withColumn("__x", F.col("declined")), "__x", F.lit("repair: answers a declined target")).drop("__x", "declined"), links


def _finish(docs, documents, items, conditions, first, named, links, targets, pairs, second, as_of) -> Run:
    """links: which first candidates answer what; targets, which none of them answers, are closed by repaired ones only. Without a second request there is nothing to look up for one."""
    candidates, nothing = first.drop("held"), links.where("false")
    if second is None:
        asked = targets.select("doc").unionByName(pairs.select("doc")).distinct().select("doc", F.lit(None).cast(PAYLOAD).alias("r"), F.lit("repair disabled").alias("error"))
        asked, more = kept(asked), nothing
        classified = targets.where("false").select("doc", "target", F.lit(None).cast("string").alias("scope"), F.lit(None).cast("boolean").alias("proven"))
        decided = pairs.where("false")
    else:
        asked = second
        classified, again, more = _repaired(docs, documents, items, first, named, targets, second, as_of)
        candidates = _repeated(candidates.unionByName(again))
        decisions = asked.select("doc", F.explode("r.scope_mappings").alias("x")).select("doc", "x.condition", "x.provision", "x.decision", "x.reason", "x.evidence")
        decided = _within(decisions, docs, at="evidence").where((F.col("reason") != "") & ((F.col("decision") == "applies") & (F.col("evidence").isNull() | (F.col("at.status") != "failed")) | (F.col("decision") == "does_not_apply") & (F.col("at.status") != "failed")))
    candidates = kept(_held(same_source(candidates)))
    final = coverage(named, links.unionByName(more), candidates)
    ran = asked.select("doc", F.col("error").alias("problem"))
    answered = more.join(candidates.where("accepted").select("doc", "index"), ["doc", "index"], "left_semi")
    open_targets = unanswered(targets, answered)
    resolved = targets.join(open_targets.select("doc", "target").withColumn("open", F.lit(True)), ["doc", "target"], "left").join(classified, ["doc", "target"], "left").join(ran, "doc", "left")
    why = (
        F.when(F.col("open").isNull(), "resolved_by_accepted_rule").when(F.col("problem").isNotNull(), F.concat(F.lit("repair: "), F.col("problem"))).when(F.col("scope").isNull(), "omitted")
        .when((F.col("scope") == "out_of_scope") & F.col("proven"), "resolved_out_of_scope").when(F.col("scope") == "out_of_scope", "out of scope without proof").when(F.col("scope") == "uncertain", "uncertain")
        .otherwise("in scope, without an accepted record")
    )
    resolved = kept(resolved.withColumn("why", why).select("doc", "target", "ref", F.when(F.col("why").startswith("resolved"), F.col("why")).otherwise("unresolved").alias("resolution"), "why"))
    unmapped = pairs.join(decided, ["doc", "condition", "provision"], "left_anti").select("doc").unionByName(pairs.join(ran.where("problem IS NOT NULL"), "doc", "left_semi").select("doc"))
    unverified = _mappings(conditions, candidates).join(pairs, ["doc", "condition", "provision"], "left_anti")
    gaps = final.join(resolved, ["doc", "target"], "left_anti")
    d, n_failed = documents, F.col("failed") == F.col("parts")
    none_found = candidates.select("doc").distinct()
    sound = ~n_failed & F.col("listed") & (F.col("bad") == 0)
    found = [
        _coded(d, response_unprocessable=n_failed, inventory_invalid=~n_failed & (~F.col("listed") | (F.col("bad") > 0)), inventory_empty=sound & (F.col("n_items") == 0) & (F.col("n_rules") > 0), inventory_uncertain=F.col("uncertain") > 0, chunk_not_extracted=~n_failed & (F.col("failed") > 0)),
        _coded(d.where(~n_failed & (F.col("empty").isNull() | (F.col("empty_at.status") == "failed"))).join(none_found, "doc", "left_anti"), unjustified_empty_result=F.lit(True)),
        _coded(candidates, held=F.col("held"), status_posture_mismatch=F.col("mismatch")),
        _coded(unmapped, scope_mapping_unresolved=F.lit(True)),
        _coded(unverified, scope_mapping_unverified=F.lit(True)),
        _coded(conditions, scope_not_applied=~F.col("applied")),
        _coded(resolved, repair_target_unresolved=F.col("resolution") == "unresolved"),
        _coded(gaps, provision_without_record=F.col("n_candidates") == 0, provision_all_rejected=F.expr("n_candidates > 0 AND n_accepted = 0 AND n_held < n_candidates")),
        _coded(ran, repair_failed=F.col("problem").isNotNull()),
    ]
    rows = reduce(DataFrame.unionByName, found)
    reasons = rows.groupBy("doc").agg(F.array_sort(F.collect_set("code")).alias("reasons"))
    state = F.when(F.col("accepted"), "accepted").when(F.col("held"), "held").when(F.exists("reasons", lambda x: F.startswith(x, F.lit("duplicate"))), "duplicate").otherwise("rejected")
    candidates = candidates.withColumn("state", state)
    n = candidates.groupBy("doc").agg(F.count("*").alias("n_candidates"), F.count_if("accepted").alias("n_accepted"), F.count_if("held").alias("n_held"))
    out = d.select("doc", "established", "parts").join(reasons, "doc", "left").join(n, "doc", "left").join(ran.select("doc", F.lit(1).alias("second")), "doc", "left").fillna(0, ["n_candidates", "n_accepted", "n_held", "second"])
    out = out.withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>"))).withColumn("status", F.when(F.size("reasons") == 0, "complete").otherwise("review_required"))
    return Run(out.select("doc", "status", "reasons", "established", (F.col("parts") + F.col("second")).alias("requests"), "n_candidates", "n_accepted", "n_held"), candidates, resolved)
