"""C: projections, filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boundaries as B
from ..functions import dates as D
from ..functions import places as P
from ..functions.posture import CODIFIED, establish_posture
from ..functions.temporal import ENACTED, TERMINAL, effective_evidence
from ..operators import integrity as I
from ..operators.extraction import located
from ..operators import validation as V
from ..operators import reviews as RV
from ..registry import both, on_tables, query, table
from .inputs import AS_OF

CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN 'ST' || c_nationkey END AS jurisdiction, CASE WHEN c_custkey % 5 = 0 THEN 'x' END AS confidence FROM customer"


@query("c1_trusted_fields", f"SELECT c_custkey, c_name, concat_ws('; ', CASE WHEN jurisdiction IS NOT NULL THEN 'trusted field jurisdiction ignored: ' || jurisdiction END, CASE WHEN confidence IS NOT NULL THEN 'ignored confidence' END) AS warnings FROM ({CUSTOMERS})")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    rows = on_tables(spark, sf, CUSTOMERS).select("c_custkey", "c_name", "jurisdiction", "confidence")
    return V.split_trusted(rows, ["jurisdiction"], ["confidence"])


NAMES = "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN upper(substr(n_name, 1, 2)) ELSE n_name || ', ' || upper(substr(n_name, 1, 2)) END AS j FROM nation"


@query("c2_level", f"SELECT k, CASE WHEN regexp_full_match(j, '[A-Z]{{2}}') THEN 'state' ELSE 'city' END AS level FROM ({NAMES})")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    return on_tables(spark, sf, NAMES).select("k", P.level_for(F.col("j")).alias("level"))


@query("c3_state_of", f"SELECT k, trim(string_split(j, ',')[-1]) AS state FROM ({NAMES})")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return on_tables(spark, sf, NAMES).select("k", P.state_of(F.col("j")).alias("state"))


ZIPS = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'NJ' WHEN 2 THEN 'MA' ELSE 'TX' END AS state, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lpad(CAST(c_custkey * 641 % 100000 AS VARCHAR(9)), 5, '0') END AS zip FROM customer"


@query(
    "c4_zip_outside_state",
    "SELECT k, CASE WHEN zip = '' OR state = 'TX' THEN NULL ELSE NOT (substr(zip, 1, 3) BETWEEN CASE state WHEN 'CA' THEN '900' WHEN 'NJ' THEN '070' ELSE '010' END AND CASE state WHEN 'CA' THEN '961' WHEN 'NJ' THEN '089' ELSE '027' END) END AS outside FROM (" + ZIPS + ")",
)
def c4(spark: SparkSession, sf: str) -> DataFrame:
    return on_tables(spark, sf, ZIPS).select("k", P.zip_outside_state(F.col("state"), F.col("zip")).alias("outside"))


NAME = "^(?:([A-Za-z .''-]+), )?([A-Z]{2})$"


@query("c5_name_grammar", f"SELECT k, regexp_extract(j, '{NAME}', 1) AS place, regexp_extract(j, '{NAME}', 2) AS state FROM ({NAMES})")
def c5(spark: SparkSession, sf: str) -> DataFrame:
    p = NAME.replace("''", "'")
    return on_tables(spark, sf, NAMES).select("k", F.regexp_extract("j", p, 1).alias("place"), F.regexp_extract("j", p, 2).alias("state"))


@query(
    "c6_schema_validation",
    "SELECT p_partkey, concat_ws('; ', CASE WHEN p_name IS NULL OR length(p_name) < 12 THEN 'p_name: too short' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-3][1-5]$') THEN 'p_brand: pattern' END, CASE WHEN p_size > 40 THEN 'p_size: over 40' END, CASE WHEN p_type NOT IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE') THEN 'p_type: not allowed' END) AS errors FROM part",
)
def c6(spark: SparkSession, sf: str) -> DataFrame:
    schema = {
        "required": ["p_name"],
        "properties": {"p_name": {"minLength": 12}, "p_brand": {"pattern": "^Brand#[1-3][1-5]$"}, "p_size": {"maximum": 40}, "p_type": {"enum": ["STANDARD", "SMALL", "MEDIUM", "LARGE"]}},
    }
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("; ", V.schema_errors(schema)).alias("errors"))


PROPS = "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '{bad' WHEN event_id % 10 = 0 THEN '{\"k\": \"x\", \"extra\": 1}' ELSE props END AS p FROM events"


@query("c7_strict_types", "SELECT event_id, CASE WHEN NOT json_valid(p) THEN 'not JSON' WHEN list_has_any(list_filter(json_keys(p), lambda x: x <> 'k'), json_keys(p)) THEN 'extra field' WHEN json_type(p, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'wrong type' ELSE 'ok' END AS verdict FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '{bad' WHEN event_id % 10 = 0 THEN '{\"k\": \"x\", \"extra\": 1}' ELSE props END AS p FROM events)")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    return on_tables(spark, sf, PROPS).select("event_id", V.strict_verdict(F.col("p"), {"k": "BIGINT"}).alias("verdict"))


@query("c8_payload_parse", f"SELECT event_id, json_valid(p) AS parsed, CASE WHEN json_valid(p) THEN coalesce(array_to_string(list_sort(list_filter(json_keys(p), lambda x: x <> 'k')), ','), '') ELSE '' END AS unknown_keys FROM ({PROPS})")
def c8(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.json_object_keys("p")
    return on_tables(spark, sf, PROPS).select("event_id", F.try_parse_json("p").isNotNull().alias("parsed"), F.coalesce(F.array_join(F.array_sort(F.array_except(keys, F.array(F.lit("k")))), ","), F.lit("")).alias("unknown_keys"))


PARTIAL = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 4) WHEN 1 THEN substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) ELSE NULL END AS effective, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'enacted' ELSE 'enacted' END AS enactment, o_orderkey % 3 = 0 AS evidence, o_orderkey % 5 = 0 AS codified FROM orders"
LATEST = "CASE length(effective) WHEN 4 THEN CAST(effective || '-12-31' AS DATE) WHEN 7 THEN last_day(CAST(effective || '-01' AS DATE)) ELSE CAST(effective AS DATE) END"
EARLIEST = "CASE length(effective) WHEN 4 THEN CAST(effective || '-01-01' AS DATE) WHEN 7 THEN CAST(effective || '-01' AS DATE) ELSE CAST(effective AS DATE) END"


@query("c9_temporal_status", f"SELECT k, CASE WHEN status = 'in_force' AND {EARLIEST} > DATE '1998-06-17' THEN 'not_yet_effective' ELSE status END AS now FROM (SELECT *, CASE enactment WHEN 'enacted' THEN 'in_force' ELSE enactment END AS status FROM ({PARTIAL}))")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    """The orders' days as partial dates, seen from one day among them."""
    status = F.when(F.col("enactment") == "enacted", "in_force").otherwise(F.col("enactment"))
    return on_tables(spark, sf, PARTIAL).select("k", D.temporal_status(status, F.col("effective"), F.lit("1998-06-17").cast("date")).alias("now"))


@query("c10_date_bounds", f"SELECT k, {EARLIEST} AS earliest, {LATEST} AS latest FROM ({PARTIAL})")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return on_tables(spark, sf, PARTIAL).select("k", D.date_bounds(F.col("effective")).alias("b")).select("k", "b.earliest", "b.latest")


@query(
    "c11_derive_status",
    f"SELECT k, CASE WHEN enactment = 'pending' THEN 'pending' WHEN effective IS NULL THEN CASE WHEN evidence OR NOT codified THEN NULL ELSE 'in_force' END WHEN {LATEST} <= DATE '1998-06-15' THEN 'in_force' WHEN {EARLIEST} > DATE '1998-06-15' THEN 'not_yet_effective' END AS status, "
    f"CASE WHEN enactment = 'pending' THEN 'enactment_status' WHEN effective IS NULL THEN CASE WHEN evidence THEN 'relative_date_unresolved' WHEN NOT codified THEN 'no_effective_date' ELSE 'codified_without_date' END WHEN {LATEST} <= DATE '1998-06-15' THEN 'effective_on_or_before' WHEN {EARLIEST} > DATE '1998-06-15' THEN 'effective_after' ELSE 'straddles_as_of' END AS why FROM ({PARTIAL})",
)
def c11(spark: SparkSession, sf: str) -> DataFrame:
    s = D.derive_status(F.col("enactment"), F.col("effective"), F.col("evidence"), F.lit("1998-06-15").cast("date"), F.col("codified"))
    return on_tables(spark, sf, PARTIAL).select("k", s.alias("s")).select("k", "s.status", "s.why")


both(
    "c12_final_state",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' AND l_tax > 0.04 THEN 'rejected' WHEN l_returnflag = 'R' THEN 'held' WHEN l_linestatus = 'F' AND l_discount > 0.08 THEN 'historical' WHEN l_quantity = 1 THEN 'duplicate' ELSE 'accepted' END AS state FROM lineitem",
)
#: Reasons of a document, by its number modulo 17; documents with held candidates have two of them.
REASONS = (
    "SELECT o_orderkey AS doc_id, CASE o_orderkey % 17 WHEN 0 THEN 'the response could not be processed: no JSON' WHEN 1 THEN 'no complete, well-formed provision inventory' WHEN 2 THEN 'the inventory lists no provisions' "
    "WHEN 3 THEN 'no rule candidates, and no source-grounded justification for it' WHEN 4 THEN 'inventory provisions of uncertain scope: 3' WHEN 5 THEN '2 candidates held, not published' "
    "WHEN 6 THEN 'enactment_status inconsistent with the document posture' WHEN 7 THEN 'named-subject scope mappings unresolved: 1' WHEN 8 THEN 'named-subject scope mappings never answered' WHEN 9 THEN 'legislative status needs review' "
    "WHEN 10 THEN 'document-level scope conditions not applied' WHEN 11 THEN 'repair targets still unresolved: x' WHEN 12 THEN 'in-scope provisions with no candidate record: 4' WHEN 13 THEN 'in-scope provisions whose candidate records were all rejected: 5' "
    "WHEN 14 THEN 'source subdivisions with no accepted record: (b)' WHEN 15 THEN 'repair pass: failed' ELSE 'something else' END AS reason FROM orders"
)
HELD = (
    "SELECT o_orderkey AS doc_id, l.n AS candidate, CASE l.n WHEN 0 THEN 'held: a stated end day is not settled' WHEN 1 THEN 'date is relative or conditional' ELSE 'no effective date is established' END AS derivation, "
    "CASE WHEN o_orderkey % 2 = 0 AND l.n = 1 THEN 'outside the supported grammar' END AS formula_reason FROM orders CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) l"
)


@query(
    "c13_review_codes",
    "SELECT o_orderkey AS doc_id, list_extract(['other', 'incomplete_inventory', 'incomplete_inventory', 'other', 'uncertain_scope', 'held_rule', 'ambiguous_document_posture', 'scope_mapping_uncertain', 'scope_mapping_uncertain', 'other', 'uncertain_scope', "
    "'incomplete_inventory', 'incomplete_inventory', 'incomplete_inventory', 'uncovered_subdivision', 'repair_failed', 'other'], o_orderkey % 17 + 1) AS code, list_extract(['response_unprocessable', 'inventory_invalid', 'inventory_invalid', 'unjustified_empty_result', "
    "'inventory_uncertain', NULL, 'status_posture_mismatch', NULL, NULL, 'legislative_status_conflict', 'global_scope_unverified', 'unresolved_repair_target', 'in_scope_provision_without_record', 'in_scope_provision_all_rejected', NULL, NULL, NULL], o_orderkey % 17 + 1) AS subcode, "
    "CAST(NULL AS BIGINT) AS candidate FROM orders UNION ALL SELECT o_orderkey, CASE n WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'unsupported_date_formula' ELSE 'unresolved_relative_date' END ELSE 'unresolved_effective_date' END, "
    "CASE n WHEN 0 THEN 'validity_window' WHEN 2 THEN 'posture' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'outside the supported grammar' END END, n FROM orders, range(3) r(n) WHERE o_orderkey % 17 = 5",
)
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return RV.review_codes(on_tables(spark, sf, REASONS), on_tables(spark, sf, HELD))


@query(
    "c14_validation_findings",
    "SELECT 'ERROR' AS severity, 'empty' AS finding, count(*) AS n FROM documents WHERE text = '' OR text IS NULL UNION ALL SELECT 'WARNING', 'duplicate_text', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'ERROR', 'unknown_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) "
    "UNION ALL SELECT 'WARNING', 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'INFO', 'length_differs', count(*) FROM documents WHERE length(text) <> n_chars "
    "UNION ALL SELECT 'ERROR', 'duplicate_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) UNION ALL SELECT 'ERROR', 'unknown_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) "
    "UNION ALL SELECT 'ERROR', 'language_format', count(*) FROM documents WHERE NOT regexp_full_match(coalesce(lang, ''), '[a-z]{2}') UNION ALL SELECT 'ERROR', 'missing_column', 1 UNION ALL SELECT 'WARNING', 'extra_column', 1",
)
def c14(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    checks = [
        V.finding("ERROR", "empty", d.where("text = '' OR text IS NULL")),
        V.finding("WARNING", "duplicate_text", d.groupBy("text").count().where("count > 1")),
        V.finding("ERROR", "unknown_nation", table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")),
        V.finding("WARNING", "label_without_document", table(spark, sf, "labels").join(d, "doc_id", "left_anti")),
        V.finding("INFO", "length_differs", d.where("length(text) <> n_chars")),
        V.finding("ERROR", "duplicate_id", d.groupBy("doc_id").count().where("count > 1")),
        V.finding("ERROR", "unknown_customer", table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        V.finding("ERROR", "language_format", d.where(~F.coalesce("lang", F.lit("")).rlike("^[a-z]{2}$"))),
        *V.column_findings(d, ["doc_id", "text", "lang", "source", "license"]),
    ]
    return reduce(DataFrame.unionByName, checks)


@query(
    "c15_integrity_invariants",
    "SELECT doc_id, CAST(CASE WHEN m <= 8 THEN NULL WHEN m = 18 THEN 0 ELSE 1 END AS BIGINT) AS index, ['source_hash', 'tiling', 'artifact_text', 'published_differs', 'primary_identity', 'chunk_tiling', 'repair_identity', 'repair_without_request', 'quote_not_source', 'invalid_record', "
    "'unverified_scope', 'scope_without_link', 'mapping_missing', 'held_published', 'historical_published', 'validity_ended', 'duplicate_published', 'passage_twice'][m] AS violation FROM (SELECT doc_id, doc_id % 20 AS m FROM documents) WHERE m BETWEEN 1 AND 18",
)
def c15(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the documents in which each remainder of doc_id by 20, but 0 and 19, breaks one invariant."""
    m, text = F.pmod("doc_id", F.lit(20)), F.concat(F.coalesce("text", F.lit("")), F.lit(" tail of the text"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"), m.alias("m"))
    m, n = F.col("m"), F.length("text").cast("long")

    def whole(x: int):
        return F.lit(x).cast("long")

    documents = d.select(
        "doc", "text", F.when(m == 1, "x").otherwise(F.sha2("text", 256)).alias("sha256"), F.lit("k").alias("key"), F.when(m == 5, "other").otherwise("k").alias("expected_key"), (m != 8).alias("repaired"), F.lit("r").alias("repair_key"),
        F.when(m == 7, "s").otherwise("r").alias("expected_repair_key"), F.when(m == 4, F.array(whole(0))).otherwise(F.array(whole(0), whole(1))).alias("published"),
    )

    def piece(start, end, artifact=None):
        return F.struct(start.alias("start"), end.alias("end"), (F.lit(None).cast("string") if artifact is None else artifact).alias("artifact"))

    cut = F.when(m == 3, "zz").otherwise(F.substring("text", 6, 4))
    pieces = d.select("doc", F.inline(F.array(piece(whole(0), whole(5)), piece(whole(5), whole(9), cut), piece(F.when(m == 2, 10).otherwise(9).cast("long"), n))))
    chunks = d.where("m IN (6, 19)").select("doc", F.inline(F.array(piece(whole(0), whole(10)), piece(F.when(m == 6, 11).otherwise(10).cast("long"), n)))).drop("artifact")

    def scope(condition: str, mode: str, governed: list[str] | None):
        return F.array(F.struct(F.lit(condition).alias("condition"), F.lit(mode).alias("mode"), (F.lit(None) if governed is None else F.array(*map(F.lit, governed))).cast("array<string>").alias("governed")))

    applied = F.when(m == 11, scope("c9", "structural", None)).when(m == 12, scope("c1", "structural", ["p7"])).when(m == 13, scope("c2", "named_subject", ["p1"])).when(m == 19, scope("c3", "named_subject", ["p1"])).otherwise(scope("c1", "structural", None))

    def candidate(k: int, quote, start, origin: str, category, broken):
        return F.struct(
            whole(k).alias("index"), F.lit(origin).alias("origin"), F.lit(True).alias("accepted"), (broken & (m == 14)).alias("held"), (broken & (m == 15)).alias("historical"), F.when(broken & (m == 17), whole(0)).alias("duplicate_of"), category.alias("category"),
            start.cast("long").alias("start"), (start + 4).cast("long").alias("end"), quote.alias("quote"), (~(broken & (m == 10))).alias("valid"), F.when(broken & (m == 16), F.to_date(F.lit(AS_OF))).alias("ends"), F.array(F.lit("p1")).alias("provisions"),
            F.when(broken, applied).otherwise(scope("c1", "structural", None)).alias("applied"),
        )

    same = m == 18
    second = F.when(m == 9, "zzzz").otherwise(F.substring("text", F.when(same, 1).otherwise(5), F.lit(4)))
    candidates = d.select("doc", F.inline(F.array(candidate(0, F.substring("text", 1, 4), F.lit(0), "primary", F.lit("a"), F.lit(False)), candidate(1, second, F.when(same, 0).otherwise(4), "repair", F.when(same, "a").otherwise("b"), F.lit(True)))))
    conditions = d.select("doc", F.explode(F.array(*map(F.lit, ("c1", "c2", "c3")))).alias("condition"), F.lit(True).alias("verified"))
    mappings = d.where("m = 19").select("doc", F.lit("c3").alias("condition"), F.lit("p1").alias("provision"))
    found = I.violations(documents, pieces, chunks, candidates, conditions, mappings, AS_OF)
    return found.select(F.col("doc").alias("doc_id"), "index", F.explode("violations").alias("violation"))


@query(
    "c16_posture",
    "SELECT doc_id, ['unknown', 'unknown', 'unknown', 'unknown', 'unknown', 'unknown', 'codified_current_law', 'pending_bill'][m + 1] AS established, ['none declared', 'malformed', 'declared unknown', 'without evidence', 'evidence not in the text', 'the text records an enactment date', "
    "'verified evidence', 'verified evidence'][m + 1] AS basis, m = 6 AS in_force_without_date FROM (SELECT doc_id, CAST(doc_id % 8 AS INT) AS m FROM documents)",
)
def c16(spark: SparkSession, sf: str) -> DataFrame:
    """What each document declares itself to be, with evidence of every kind."""
    m = F.pmod("doc_id", F.lit(8))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" This code is  current."), F.when(m == 5, " Approved by Governor, March 3, 2020").otherwise(""))
    declared = F.when(m == 1, "no such kind").when(m == 2, "unknown").when(m == 7, "pending_bill").when(m > 2, CODIFIED)
    evidence = F.when(m == 4, "words of another text #~#").when(m.isin(5, 6, 7), "This code is current.")
    d = table(spark, sf, "documents").select("doc_id", text.alias("text"), declared.alias("declared"), evidence.alias("evidence"))
    x = establish_posture(F.col("declared"), F.col("evidence"), located(F.col("evidence"), F.col("text"))["status"], F.size(D.base_dates(F.col("text"))) > 0)
    return d.select("doc_id", x.alias("x")).select("doc_id", "x.established", "x.basis", (F.col("x.established") == CODIFIED).alias("in_force_without_date"))


_FORMULA = "take effect on the first day of the seventh month next following enactment"
#: What follows a document's text, the evidence, the declared kind and date, and what must come of them: kind, date, whether there is evidence of a date, rejection, reason.
EVIDENCE = (
    (" This section is in force from May 1, 2024.", "in force from May 1, 2024", "explicit_operative_date", "2024-05-01", "explicit_operative_date", "2024-05-01", True, None, None),
    (" This section is in force from May 2024.", "in force from May 2024", "explicit_operative_date", "2024-05", "explicit_operative_date", "2024-05", True, None, None),
    (" This section is in force from May 1, 2024.", "in force from May 1, 2024", "explicit_operative_date", "2024-06", "explicit_operative_date", None, False, "date not in its evidence", None),
    (" This section is in force from May 1, 2024.", "in force from May 1, 2024", "explicit_operative_date", None, "explicit_operative_date", None, False, "no date given", None),
    (" (Added 3-1-2020 by Ord. 1234; effective 4-1-2020.) End", "effective 4-1-2020", "explicit_operative_date", "2020-04-01", "history_note", None, False, None, None),
    (" (Added 3-1-2020 by Ord. 1234.) End", "Added 3-1-2020", "history_note", None, "history_note", None, False, None, None),
    (" It was so before.", "so before", "history_note", None, "history_note", None, False, "no history in the note", None),
    (f" Approved June 18, 2021. It shall {_FORMULA}.", _FORMULA, "operative_condition", "2021-01-01", "relative_date_formula", "2022-01-01", True, None, None),
    (f" It shall {_FORMULA}.", _FORMULA, "relative_date_formula", None, "relative_date_formula", None, True, None, "no base date"),
    (" It begins when a portal exists.", "when a portal exists", "operative_condition", None, "operative_condition", None, False, None, None),
    (" It begins when a portal exists.", "when a portal exists", None, None, None, None, False, "not classified", None),
    (" It begins.", "words of another text #~#", "operative_condition", None, "operative_condition", None, False, "evidence not found", None),
)


def _sql(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v + "'" for v in values) + f"][CAST(doc_id % {len(EVIDENCE)} + 1 AS INT)]"


@query("c17_effective_evidence", "SELECT doc_id, " + ", ".join(f"{_sql([e[4 + k] for e in EVIDENCE])} AS {name}" for k, name in enumerate(("applied", "effective", "dated", "rejection", "reason"))) + " FROM documents")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of every kind behind the documents' own texts."""
    pick = lambda k: F.get(F.array(*(F.lit(e[k]).cast("string") for e in EVIDENCE)), (F.col("doc_id") % len(EVIDENCE)).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("x" * 310 + "."), pick(0)).alias("text"), pick(1).alias("words"), pick(2).alias("kind"), pick(3).alias("given"))
    d = d.withColumn("s", F.instr(F.col("text"), F.col("words")) - 1).withColumn("span", F.when(F.col("s") >= 0, F.col("words")))
    start = F.greatest("s", F.lit(0))
    x = effective_evidence(F.col("kind"), F.col("given"), F.col("span"), F.col("text"), start, start + F.length("words"))
    return d.select("doc_id", F.explode(F.array(x)).alias("x")).select("doc_id", "x.*")


BILLS = "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'Approved by the Governor, July 9, 2024' WHEN 1 THEN 'House bill' || chr(10) || 'No further action taken.' WHEN 2 THEN 'In the 193rd (2023 - 2024) session' WHEN 3 THEN 'In the 194th (Current) session' ELSE 'No label here' END AS body FROM orders"


@query(
    "c18_legislative_status",
    f"SELECT k, CASE WHEN regexp_matches(body, '{ENACTED}') THEN 'conflict' WHEN regexp_matches(body, '{TERMINAL}') THEN 'failed' WHEN body LIKE '%193rd%' THEN 'failed' WHEN body LIKE '%194th%' THEN 'pending' ELSE 'model' END AS status FROM ({BILLS})",
)
def c18(spark: SparkSession, sf: str) -> DataFrame:
    s, as_of = D.session_of(F.col("body")), F.lit(AS_OF).cast("date")
    rows = on_tables(spark, sf, BILLS).withColumn("s", s)
    ended = F.col("s.consistent") & (as_of >= F.col("s.ends_by"))
    sits = F.col("s.consistent") & F.year(as_of).between(F.col("s.first_year"), F.col("s.last_year"))
    status = F.when(F.col("body").rlike(ENACTED), "conflict").when(F.col("body").rlike(TERMINAL), "failed").when(ended, "failed").when(sits, "pending").otherwise("model")
    return rows.select("k", status.alias("status"))


WINDOWS = (
    "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 6 WHEN 0 THEN 'This section is repealed as of ' WHEN 1 THEN 'This rule expires on ' WHEN 2 THEN 'Rates are effective through ' WHEN 3 THEN 'The rule becomes operative on ' WHEN 4 THEN 'Amended by Ord. 5. Effective ' ELSE 'It remains in effect until ' END AS lead_in FROM orders"
)
LAST = "CASE WHEN k % 6 IN (0) THEN d WHEN k % 6 IN (1, 2, 5) THEN d + 1 END"


@query(
    "c19_validity_decision",
    f"SELECT k, CASE WHEN k % 6 IN (1, 5) AND d = DATE '1998-06-15' THEN 'hold' WHEN {LAST} <= DATE '1998-06-15' THEN 'historical' WHEN k % 6 = 4 AND k % 2 = 0 AND d > DATE '1998-06-15' THEN 'not_yet_effective' END AS outcome, "
    f"CASE WHEN k % 6 IN (1, 5) AND d = DATE '1998-06-15' THEN NULL WHEN {LAST} <= DATE '1998-06-15' THEN CASE WHEN k % 6 = 0 THEN 'repealed' ELSE 'expired' END WHEN {LAST} > DATE '1998-06-15' THEN 'current_until' END AS state FROM ({WINDOWS})",
)
def c19(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("lead_in", F.date_format("d", "MMMM d, yyyy"), F.lit("."))
    rows = on_tables(spark, sf, WINDOWS).select("k", B.boundaries(text, F.col("k") % 2 == 0).alias("b"))
    return rows.select("k", B.decide(F.col("b"), F.lit("1998-06-15").cast("date")).alias("x")).select("k", "x.outcome", "x.state")


@query("c20_window_consequence", f"SELECT k, CASE WHEN k % 6 IN (1, 5) AND d = DATE '1998-06-15' THEN 'held' WHEN {LAST} <= DATE '1998-06-15' THEN 'historical' WHEN k % 6 = 4 AND k % 2 = 0 AND d > DATE '1998-06-15' THEN 'not_yet_effective' ELSE 'in_force' END AS status FROM ({WINDOWS})")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    x = c19(spark, sf)
    return x.select("k", F.when(F.col("outcome") == "hold", "held").when(F.col("outcome").isNotNull(), F.col("outcome")).otherwise("in_force").alias("status"))


both(
    "c21_postal_category",
    "SELECT c.c_custkey, CASE WHEN n.n_regionkey IS NULL THEN 'unresolved' WHEN c.c_nationkey = c.c_custkey % 25 THEN 'same' WHEN n.n_regionkey < 3 THEN 'known' ELSE 'other' END AS category FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_custkey % 30",
)


@query("c22_review_targets", "SELECT * FROM (SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END, CASE WHEN c_nationkey = 7 THEN 'nation' END) AS reasons FROM customer) WHERE reasons <> ''")
def c22(spark: SparkSession, sf: str) -> DataFrame:
    why = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, F.lit("negative_balance")), F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("segment")), F.when(F.col("c_nationkey") == 7, F.lit("nation"))))
    return table(spark, sf, "customer").select("c_custkey", why.alias("w")).where(F.size("w") > 0).select("c_custkey", F.array_join("w", ",").alias("reasons"))


both("c23_map_points", "SELECT s_suppkey, CAST(30 + s_suppkey * 0.01 AS DOUBLE) AS lat, CAST(-(70 + s_suppkey * 0.01) AS DOUBLE) AS lon, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AS flagged FROM supplier WHERE s_acctbal IS NOT NULL")


@query("c24_code_texts", "SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END, o_orderstatus) AS shown FROM orders")
def c24(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(texts, F.col("o_orderstatus")), "o_orderstatus").alias("shown"))


