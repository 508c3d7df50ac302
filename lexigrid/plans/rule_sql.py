"""The rule engine's results in plain SQL, by clause and atom rows and grouping: another route than the arrays of the operators."""

from __future__ import annotations

from ..functions import conditions as C
from .inputs import AS_OF, FACTS_SQL, RULES_SQL


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def hit(pattern: str) -> str:
    return f"regexp_matches(text, {q(pattern)})"


def split_sql(column: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({column}, ';\\s+([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def clause_ctes(as_of: str = AS_OF, rules_sql: str = RULES_SQL) -> str:
    year = int(as_of[:4])
    age = f"regexp_extract(text, {q(C.CERTIFICATE_AGE)}, 1)"
    reg = "NOT oper AND NOT prod AND NOT repl"
    atoms = [
        f"SELECT rule_id, role, ord, 'year_built' AS kind, 'year_built_missing' AS reason, lower(regexp_extract(text, {q(C.BUILT)}, 1)) AS op, CAST(regexp_extract(text, {q(C.BUILT)}, 4) AS INT) AS n FROM cl WHERE NOT oper AND NOT prod AND has_date",
        "SELECT rule_id, role, ord, 'replacement_unit', 'replacement_unit_status_unknown', NULL, NULL FROM cl WHERE NOT oper AND NOT prod AND repl",
        "SELECT rule_id, role, ord, 'operative_condition', 'operative_condition_unresolved', NULL, NULL FROM cl WHERE oper",
        f"SELECT rule_id, role, ord, 'certificate_of_occupancy_proxy', 'certificate_of_occupancy_unknown', 'after', {year} - CASE WHEN lower({age}) = 'fifteen' THEN 15 ELSE CAST({age} AS INT) END FROM cl WHERE {reg} AND {age} <> ''",
        f"SELECT rule_id, role, ord, 'certificate_of_occupancy', 'certificate_of_occupancy_unknown', NULL, NULL FROM cl WHERE {reg} AND {age} = '' AND {hit(C.CERTIFICATE)}",
        f"SELECT rule_id, role, ord, 'property_type', 'property_type_uncertain', NULL, NULL FROM cl WHERE {reg} AND {hit(C.FACILITY)}",
        f"SELECT rule_id, role, ord, 'separately_alienable', 'property_type_uncertain', NULL, NULL FROM cl WHERE {reg} AND {hit(C.SEPARATE)}",
        f"SELECT rule_id, role, ord, 'units', 'units_missing', '==', 2 FROM cl WHERE {reg} AND {hit(C.DUPLEX)}",
        f"SELECT rule_id, role, ord, 'units', 'units_missing', '==', 1 FROM cl WHERE {reg} AND NOT {hit(C.DUPLEX)} AND {hit(C.SINGLE)}",
        f"SELECT rule_id, role, ord, 'units', 'units_missing', '<=', 2 FROM cl WHERE {reg} AND {hit(C.ONE_OR_TWO)}",
        f"SELECT rule_id, role, ord, 'units', 'units_missing', '<=', 4 FROM cl WHERE {reg} AND {hit(C.UP_TO_FOUR)}",
    ]
    atoms += [f"SELECT rule_id, role, ord, '{k}', '{r}', NULL, NULL FROM cl WHERE {reg} AND {hit(p)}" for k, r, p in C.UNDECIDED]
    return f"""
rules AS ({rules_sql}),
raw AS (SELECT rule_id, 'coverage' AS role, {split_sql("coverage_conditions")} AS l FROM rules UNION ALL SELECT rule_id, 'exemption', {split_sql("exemptions")} FROM rules),
cl0 AS (SELECT rule_id, role, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS ord FROM raw WHERE l IS NOT NULL),
cl AS (SELECT *, {hit(C.OPERATIVE)} AS oper, role = 'exemption' AND {hit(C.PRODUCT)} AND NOT {hit(C.OPERATIVE)} AS prod, {hit(C.BUILT)} AS has_date,
       {hit(C.BUILT)} AND {hit(C.REPLACEMENT)} AS repl FROM cl0),
found AS ({" UNION ALL ".join(atoms)}),
kinds AS (SELECT cl.*, CASE WHEN oper THEN 'operative' WHEN prod THEN 'situational' WHEN EXISTS (SELECT 1 FROM found f WHERE f.rule_id = cl.rule_id AND f.role = cl.role AND f.ord = cl.ord) THEN 'property'
       WHEN {hit(C.GENERIC)} THEN 'generic' WHEN {hit(C.SITUATIONAL)} THEN 'situational' ELSE 'unsupported' END AS kind, (repl AND NOT oper AND NOT prod) OR {hit(C.TYPE_LIST)} AS any_of FROM cl),
atoms AS (SELECT * FROM found UNION ALL SELECT rule_id, role, ord, 'unsupported', role || '_condition_unsupported', NULL, NULL FROM kinds WHERE kind = 'unsupported')
"""


VALUE = """CASE
 WHEN a.kind IN ('year_built', 'certificate_of_occupancy_proxy') THEN CASE WHEN year_built IS NULL OR year_built = n THEN NULL WHEN op IN ('before', 'on or before') THEN year_built < n ELSE year_built > n END
 WHEN a.kind = 'units' THEN CASE WHEN units_min IS NULL THEN NULL
   WHEN op = '<=' THEN CASE WHEN units_max IS NOT NULL AND units_max <= n THEN true WHEN units_min > n THEN false END
   WHEN units_min = units_max THEN units_min = n WHEN units_min > n OR (units_max IS NOT NULL AND units_max < n) THEN false END
 WHEN a.kind = 'property_type' THEN CASE WHEN use_class IN ('apartment', 'subsidized_housing') THEN false END
 WHEN a.kind = 'separately_alienable' THEN CASE WHEN use_class = 'apartment' AND units_min >= 2 THEN false END END"""
REASON = """CASE WHEN a.kind IN ('year_built', 'certificate_of_occupancy_proxy') THEN CASE WHEN year_built IS NULL THEN 'year_built_missing' ELSE 'year_built_in_cutoff_year' END
 WHEN a.kind = 'units' AND units_min IS NOT NULL THEN 'property_type_uncertain' ELSE a.reason END"""
BOUNDS = """CASE length(effective_date) WHEN 4 THEN try_cast(effective_date || '-01-01' AS DATE) WHEN 7 THEN try_cast(effective_date || '-01' AS DATE) ELSE try_cast(effective_date AS DATE) END"""


def pair_ctes(as_of: str = AS_OF) -> str:
    """Up to `outcome`: one row for each candidate pair."""
    facts = " UNION ALL ".join(f"SELECT '{r}' AS r, '{f}' AS f" for r, f in (((k, v.replace("'", "''")) for k, v in C.FACT_OF_REASON.items())))
    return f"""{clause_ctes(as_of)},
facts AS ({FACTS_SQL}),
pairs AS (SELECT f.*, r.*, f.state_jurisdiction IS NULL AND f.local_jurisdiction IS NULL AS lost,
   CASE WHEN r.status = 'in_force' AND {BOUNDS} > DATE '{as_of}' THEN 'not_yet_effective' ELSE r.status END AS now
   FROM facts f JOIN rules r ON r.jurisdiction = f.state_jurisdiction OR r.jurisdiction = f.local_jurisdiction OR (f.state_jurisdiction IS NULL AND f.local_jurisdiction IS NULL AND r.status <> 'failed')),
vals AS (SELECT p.address_id, p.rule_id, k.role, k.ord, k.text, k.kind, k.any_of, {VALUE} AS v, {REASON} AS reason
   FROM pairs p JOIN kinds k ON k.rule_id = p.rule_id LEFT JOIN atoms a ON a.rule_id = k.rule_id AND a.role = k.role AND a.ord = k.ord),
cv AS (SELECT address_id, rule_id, role, ord, text, CASE WHEN kind IN ('generic', 'situational') THEN role = 'coverage'
   WHEN any_of THEN CASE WHEN count(*) FILTER (v) > 0 THEN true WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL ELSE false END
   ELSE CASE WHEN count(*) FILTER (NOT v) > 0 THEN false WHEN count(*) FILTER (v IS NULL) > 0 THEN NULL ELSE true END END AS value FROM vals GROUP BY address_id, rule_id, role, ord, text, kind, any_of),
roles AS (SELECT address_id, rule_id,
   CASE WHEN count(*) FILTER (role = 'coverage' AND NOT value) > 0 THEN false WHEN count(*) FILTER (role = 'coverage' AND value IS NULL) > 0 THEN NULL ELSE true END AS covers,
   CASE WHEN count(*) FILTER (role = 'exemption' AND value) > 0 THEN true WHEN count(*) FILTER (role = 'exemption' AND value IS NULL) > 0 THEN NULL ELSE false END AS exempt,
   min_by(text, ord) FILTER (role = 'coverage' AND NOT value) AS ctext, min_by(text, ord) FILTER (role = 'exemption' AND value) AS etext FROM cv GROUP BY address_id, rule_id),
why AS (SELECT DISTINCT c.address_id, c.rule_id, v.reason FROM cv c JOIN vals v USING (address_id, rule_id, role, ord) WHERE c.value IS NULL AND v.v IS NULL),
facts_of AS ({facts}),
because AS (SELECT w.address_id, w.rule_id, string_agg(w.reason, ',' ORDER BY w.reason) AS reasons FROM why w GROUP BY ALL),
missing AS (SELECT address_id, rule_id, string_agg(f, ',' ORDER BY f) AS missing FROM (SELECT DISTINCT address_id, rule_id, f FROM why JOIN facts_of ON r = reason) GROUP BY ALL),
o0 AS (SELECT p.address_id, p.rule_id, p.now, p.lost, p.jurisdiction, coalesce(o.covers, CASE WHEN o.rule_id IS NULL THEN true END) AS covers, coalesce(o.exempt, CASE WHEN o.rule_id IS NULL THEN false END) AS exempt, ctext, etext, b.reasons, m.missing
   FROM pairs p LEFT JOIN roles o ON o.address_id = p.address_id AND o.rule_id = p.rule_id LEFT JOIN because b ON b.address_id = p.address_id AND b.rule_id = p.rule_id LEFT JOIN missing m ON m.address_id = p.address_id AND m.rule_id = p.rule_id),
o1 AS (SELECT *, CASE WHEN now = 'failed' THEN 'status_failed' WHEN lost THEN NULL WHEN NOT covers THEN 'coverage_false' WHEN exempt THEN 'exempt' END AS omitted FROM o0),
outcome AS (SELECT address_id, rule_id, jurisdiction, covers, exempt, now, omitted, CASE omitted WHEN 'coverage_false' THEN ctext[1:120] WHEN 'exempt' THEN etext[1:120] END AS clause,
   CASE WHEN omitted IS NOT NULL THEN NULL WHEN lost THEN 'unknown' WHEN now IN ('pending', 'not_yet_effective') THEN now WHEN covers AND NOT exempt THEN 'applies' ELSE 'unknown' END AS result,
   CASE WHEN omitted IS NOT NULL THEN '' WHEN lost THEN 'jurisdiction_unresolved' ELSE coalesce(reasons, '') END AS reasons,
   CASE WHEN omitted IS NOT NULL THEN '' WHEN lost THEN 'jurisdiction' ELSE coalesce(missing, '') END AS missing_facts FROM o1)
"""
