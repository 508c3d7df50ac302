"""Review reasons as codes, what changed between two runs, requests by identity, retries, and attempts on what earlier ones left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (beginning of a review reason, code, subcode), the first that fits counts; None: the reason itself is enough.
REASON_CODES = (
    ("the response could not be processed", "other", "response_unprocessable"),
    ("no complete, well-formed provision inventory", "incomplete_inventory", "inventory_invalid"),
    ("the inventory lists no provisions", "incomplete_inventory", "inventory_invalid"),
    ("no rule candidates, and no source-grounded justification", "other", "unjustified_empty_result"),
    ("inventory provisions of uncertain scope", "uncertain_scope", "inventory_uncertain"),
    ("enactment_status inconsistent with the document posture", "ambiguous_document_posture", "status_posture_mismatch"),
    ("named-subject scope mappings unresolved", "scope_mapping_uncertain", None),
    ("named-subject scope mappings never", "scope_mapping_uncertain", None),
    ("legislative status needs review", "other", "legislative_status_conflict"),
    ("document-level scope conditions not applied", "uncertain_scope", "global_scope_unverified"),
    ("repair targets still unresolved", "incomplete_inventory", "unresolved_repair_target"),
    ("in-scope provisions with no candidate record", "incomplete_inventory", "in_scope_provision_without_record"),
    ("in-scope provisions whose candidate records were all rejected", "incomplete_inventory", "in_scope_provision_all_rejected"),
    ("source subdivisions with no accepted record", "uncovered_subdivision", None),
    ("repair pass:", "repair_failed", None),
)
# What a held candidate's derivation says, its code and subcode; the first that fits counts.
HELD_CODES = (
    (("legislative status undetermined",), "other", "legislative_status_conflict"),
    (("end boundar", "version/history evidence has a date", "stated end day", "start after as_of but an end"), "unresolved_effective_date", "validity_window"),
    (("relative or conditional",), "unresolved_relative_date", None),
    (("no effective date is established",), "unresolved_effective_date", "posture"),
)
HELD = "held, not published"


def review_code(reason: Column) -> Column:
    """struct(code, subcode) of a document's review reason; `held_rule` for held candidates, `other` for what no beginning fits."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("code"), F.lit("").alias("subcode")))
    for at, (start, code, subcode) in enumerate(REASON_CODES):
        if at == 5:  # held candidates are told by words inside, after the reasons about the inventory
            out = out.when(F.contains(reason, F.lit(HELD)), F.struct(F.lit("held_rule").alias("code"), F.lit(None).cast("string").alias("subcode")))
        out = out.when(F.startswith(reason, F.lit(start)), F.struct(F.lit(code).alias("code"), F.lit(subcode).cast("string").alias("subcode")))
    return out.otherwise(F.struct(F.lit("other").alias("code"), F.lit(None).cast("string").alias("subcode")))


def held_code(derivation: Column, formula_reason: Column) -> Column:
    """struct(code, subcode) of one held candidate."""
    text, why = F.coalesce(derivation, F.lit("")), F.coalesce(formula_reason, F.lit(""))
    unsupported = F.contains(why, F.lit("supported grammar")) | F.contains(why, F.lit("unsupported"))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("code"), F.lit("").alias("subcode")))
    for words, code, subcode in HELD_CODES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        of = F.when(unsupported, "unsupported_date_formula").otherwise(code) if code == "unresolved_relative_date" else F.lit(code)
        more = F.nullif(why, F.lit("")) if code == "unresolved_relative_date" else F.lit(subcode).cast("string")
        out = out.when(hit, F.struct(of.alias("code"), more.alias("subcode")))
    return out.otherwise(F.struct(F.lit("other").alias("code"), text.alias("subcode")))


def review_codes(reasons: DataFrame, held: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, code, subcode, candidate: a row for each reason (key, reason), and for a document with held candidates (key, candidate, derivation,
    formula_reason) one more for each of them."""
    coded = reasons.withColumn("x", review_code(F.col("reason")))
    own = coded.select(key, "x.code", "x.subcode", F.lit(None).cast("long").alias("candidate"))
    asked = coded.where(F.col("x.code") == "held_rule").select(key).distinct()
    each = held.join(asked, key, "left_semi").withColumn("x", held_code(F.col("derivation"), F.col("formula_reason")))
    return own.unionByName(each.select(key, "x.code", "x.subcode", F.col("candidate").cast("long").alias("candidate")))


def baseline_delta(old: DataFrame, new: DataFrame, key: str = "doc_id", index: str = "candidate") -> DataFrame:
    """key, index, before, after, reason of the candidates (key, index, state, reasons array) whose state changed. Candidates are paired by place; one that
    only one run has isn't a change."""
    a = old.select(key, index, F.col("state").alias("before"), F.col("reasons").alias("__why"))
    b = new.select(key, index, F.col("state").alias("after"))
    was, now, why = F.col("before"), F.col("after"), F.col("__why")
    reason = (
        F.when((was == "rejected") & F.exists(why, lambda x: F.contains(x, F.lit("version annotation is dated"))), "recovered: temporal")
        .when(was.isin("rejected", "held") & F.exists(why, lambda x: F.startswith(x, F.lit("citation:"))), "recovered: citation")
        .when(F.startswith(now, F.lit("historical")), "removed: expired")
        .when(now == "suppressed_exact_duplicate", "removed: duplicate")
        .otherwise("other")
    )
    return a.join(b, [key, index]).where(~was.eqNullSafe(now)).select(key, index, "before", "after", reason.alias("reason"))


IDENTITY = ("pass", "source_doc_id", "source_sha256", "view_sha256", "provider", "model", "prompt_version", "prompt_sha256", "response_schema_sha256", "generation_settings")


def request_identity(fields: dict[str, Column], targets: Column | None = None) -> Column:
    """SHA-256 of a request's identity as canonical JSON: its fields in the order of their names, and a repair's targets, sorted."""
    if missing := set(IDENTITY) - set(fields):
        raise ValueError(f"no identity without {sorted(missing)}")
    named = dict(fields) if targets is None else fields | {"targets": F.array_sort(targets)}
    return F.sha2(F.to_json(F.struct(*(named[k].alias(k) for k in sorted(named)))), 256)


BACKOFF_S, MOST_ATTEMPTS, MOST_WAIT_S = (2.0, 8.0), 3, 60.0


def retry(status: Column, attempt: Column, hint_s: Column) -> Column:
    """struct(action, wait_s) after a request: done, retry after wait_s, or fail. status null: the connection broke. Only that, 429 and 5xx are tried again, up to
    MOST_ATTEMPTS, and never if the server asks for a longer wait than MOST_WAIT_S."""
    transient = status.isNull() | (status == 429) | (status >= 500)
    hint = F.when(status.isNotNull() & hint_s.isNotNull(), F.greatest(hint_s, F.lit(0.0)))
    wait = F.coalesce(hint, F.when(attempt == 1, BACKOFF_S[0]).otherwise(BACKOFF_S[1]))

    def out(action: str, seconds: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), seconds.alias("wait_s"))

    none = F.lit(None).cast("double")
    over = F.coalesce(attempt >= MOST_ATTEMPTS, F.lit(False)) | F.coalesce(hint > MOST_WAIT_S, F.lit(False))
    return F.when(status == 200, out("done", none)).when(transient & ~over, out("retry", wait)).otherwise(out("fail", none))


#: An address is tried with all its parts, without the city, without the ZIP code.
ATTEMPTS = ("A", "B", "C")


def attempt_inputs(addresses: DataFrame) -> DataFrame:
    """id, attempt, street, city, state, zip, skipped: what each attempt would send, or why it isn't made. Needs id, street, city, state, zip."""
    no_zip, no_city = F.coalesce("zip", F.lit("")) == "", F.coalesce("city", F.lit("")) == ""
    skipped = {
        "A": F.lit(None).cast("string"),
        "B": F.when(no_zip, "no ZIP code: street and state alone are no request"),
        "C": F.when(no_zip, "no ZIP code: the same as A").when(no_city, "no city: the same as B"),
    }
    sent = [F.struct(F.lit(a).alias("attempt"), F.lit("").alias("city") if a == "B" else F.col("city"), F.lit("").alias("zip") if a == "C" else F.col("zip"), skipped[a].alias("skipped")) for a in ATTEMPTS]
    rows = addresses.select("id", "street", "city", "state", "zip", F.explode(F.array(*sent)).alias("x"))
    return rows.select("id", "x.attempt", "street", "x.city", "state", "x.zip", "x.skipped")


def run_attempts(addresses: DataFrame, responses: DataFrame) -> DataFrame:
    """id, used, place, tried, skipped: each attempt is made on the addresses that none before it has matched. responses: id, attempt, indicator,
    state, place; usable is a match in the address's own state. used is null if none was."""
    left = attempt_inputs(addresses)
    rows = None
    done = None
    for a in ATTEMPTS:
        own = left.where(F.col("attempt") == a) if done is None else left.where(F.col("attempt") == a).join(done, "id", "left_anti")
        got = responses.where(F.col("attempt") == a).select("id", "indicator", F.col("state").alias("found_state"), "place")
        met = own.join(got, "id", "left").withColumn("usable", F.coalesce(F.col("skipped").isNull() & (F.col("indicator") == "Match") & (F.col("found_state") == F.col("state")), F.lit(False)))
        hit = met.where("usable").select("id")
        done = hit if done is None else done.unionByName(hit)
        part = met.select("id", "attempt", "usable", "skipped", "place")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(
        F.max(F.when(F.col("usable"), F.col("attempt"))).alias("used"), F.max(F.when(F.col("usable"), F.col("place"))).alias("place"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("skipped").isNull(), F.col("attempt")))), "").alias("tried"), F.count("skipped").alias("skipped"),
    )
