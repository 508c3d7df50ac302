"""Conditions of rules as data: a clause becomes a kind and atoms, which one expression evaluates on property facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kleene import and3, built, compare_units, or3

# The wording by which a clause is recognised, and the reason given when its atom can't be decided.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
BUILT = rf"(?i)\b(?:first )?(?:built|constructed) (on or before|before|after|on or after) ({MONTHS}) (\d{{1,2}}), (\d{{4}})"
REPLACEMENT = r"(?i)replacement units?"
OPERATIVE = r"(?i)^Operative condition \(unresolved"
PRODUCT = r"(?i)\b(product|software|algorithmic device|report, study|market research|appraisal)\b"
CERTIFICATE_AGE = r"(?i)(?:certificate of occupancy within the previous|produced in the last) (\d+|fifteen) years"
CERTIFICATE = r"(?i)certificate of occupancy|produced in the last 15 years"
TYPE_LIST = r"(?i)certain property types, including|property types such as"
GENERIC = r"(?i)^(?:the ordinance )?applies to (?:all|any|security for|residential)|^residential units in|applies to all landlords"
SITUATIONAL = (
    r"(?i)\b(when|if|upon|after|prior to|tenan\w*|lease\w*|notice|terminat\w*|evict\w*|occupan\w*|occupies|occupy|service members?|transfer|inspection|repairs?|request|"
    r"violation|demoli\w*|remodel|relocation|vacat\w*|move-in|fees?|screening|applicant|security collected|interest|rent due|payment|cosmetic|death|forfeit\w*|vacancy|"
    r"habitab\w*|grounds|vacation|short-term|credit|mortgage|exceptions? provided|paragraphs?|subdivision|subject to paragraphs)\b"
)
#: (kind, reason, pattern) of atoms that no fact decides, in order.
UNDECIDED = (
    ("owner_type", "owner_type_unknown", r"(?i)natural person|\bREIT\b|real estate investment trust|corporat|family trust|\bLLC\b|mobilehome park management|own(?:s)? (?:only )?(?:no more than )?two (?:residential )?rental propert"),
    ("owner_occupancy", "owner_occupancy_unknown", r"(?i)owner[- ]occupied|owner-occupant|owner occupied one|(?:landlord|owner) occupied one|occupied by the landlord|principal residence|shares bathroom or kitchen"),
    ("subsidy_restriction", "subsidized_status_unknown", r"(?i)affordable housing|deed[- ]restricted|restricted by deed|regulatory restriction|subsid"),
    ("local_ordinance", "local_ordinance_coverage_unknown", r"(?i)local (?:just cause|rent)|local ordinance|local rent or price control"),
    ("local_program", "local_program_coverage_unknown", r"(?i)rent-controlled units|\bRSO\b|\bJCO\b|Protected Units?\b"),
    ("rent_history", "rent_history_unknown", r"(?i)monthly rent charged on or before"),
)
FACILITY = (
    r"(?i)hospital|nursing|health facility|religious facilit|extended care|residential care|adult residential|dormitor|transitional housing|substance abuse|hotel|transient"
    r"|^(?:homeowners? of (?:a )?mobilehomes?|a homeowner of a mobilehome|mobile ?homes? (?:subject|spaces))|condominium|townhome"
)
SEPARATE = r"(?i)separately alienable"
DUPLEX = r"(?i)duplex|two-unit propert"
SINGLE = r"(?i)single-family"
ONE_OR_TWO = r"(?i)one-family or two-family"
UP_TO_FOUR = r"(?i)premises of not more than four"
FACT_OF_REASON = {
    "year_built_missing": "year_built",
    "year_built_in_cutoff_year": "year_built (cutoff year)",
    "units_missing": "units",
    "owner_type_unknown": "owner_type",
    "owner_occupancy_unknown": "owner_occupancy",
    "certificate_of_occupancy_unknown": "certificate_of_occupancy_date",
    "subsidized_status_unknown": "subsidy_or_deed_restriction",
    "property_type_uncertain": "property_type",
    "local_ordinance_coverage_unknown": "local_ordinance_coverage",
    "local_program_coverage_unknown": "local_program_coverage",
    "rent_history_unknown": "rent_history",
    "replacement_unit_status_unknown": "replacement_unit_status",
    "jurisdiction_unresolved": "jurisdiction",
}

ATOM = "struct<kind:string,reason:string,op:string,n:int>"


def split_clauses(text: Column) -> Column:
    """At a semicolon before a capital letter; none for NULL."""
    return F.coalesce(F.filter(F.transform(F.split(text, r";\s+(?=[A-Z])"), lambda x: F.trim(x)), lambda c: c != ""), F.array().cast("array<string>"))


def _atom(kind: str, reason: str, op=None, n=None) -> Column:
    op = F.lit(op) if op is None or isinstance(op, str) else op
    n = F.lit(n) if n is None or isinstance(n, int) else n
    return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), op.cast("string").alias("op"), n.cast("int").alias("n"))


def classify(text: Column, role: Column, as_of_year: int | None = None) -> Column:
    """struct(kind, any_of, atoms): property, situational, generic, unsupported or operative. Without an as-of year, a
    test of a certificate's age is one that nothing decides."""
    has_date = F.regexp_extract(text, BUILT, 4) != ""
    built_atom = _atom("year_built", "year_built_missing", F.lower(F.regexp_extract(text, BUILT, 1)), F.when(has_date, F.regexp_extract(text, BUILT, 4)).cast("int"))
    age = F.regexp_extract(text, CERTIFICATE_AGE, 1)
    years = F.when(F.lower(age) == "fifteen", F.lit(15)).when(age != "", age.cast("int"))
    found = [F.when(has_date, built_atom)]
    if as_of_year is None:
        found.append(F.when(text.rlike(CERTIFICATE), _atom("certificate_of_occupancy", "certificate_of_occupancy_unknown")))
    else:
        proxy = _atom("certificate_of_occupancy_proxy", "certificate_of_occupancy_unknown", "after", F.lit(as_of_year) - years)
        found.append(F.when(age != "", proxy).when(text.rlike(CERTIFICATE), _atom("certificate_of_occupancy", "certificate_of_occupancy_unknown")))
    found += [F.when(text.rlike(p), _atom(k, r)) for k, r, p in UNDECIDED]
    found += [
        F.when(text.rlike(FACILITY), _atom("property_type", "property_type_uncertain")),
        F.when(text.rlike(SEPARATE), _atom("separately_alienable", "property_type_uncertain")),
        F.when(text.rlike(DUPLEX), _atom("units", "units_missing", "==", 2)).when(text.rlike(SINGLE), _atom("units", "units_missing", "==", 1)),
        F.when(text.rlike(ONE_OR_TWO), _atom("units", "units_missing", "<=", 2)),
        F.when(text.rlike(UP_TO_FOUR), _atom("units", "units_missing", "<=", 4)),
    ]
    atoms = F.array_compact(F.array(*found))
    none = F.array().cast(f"array<{ATOM}>")

    def made(kind: str, any_of: Column | bool, what: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(any_of) if isinstance(any_of, bool) else any_of).alias("any_of"), what.alias("atoms"))

    unsupported = F.when(role == "coverage", _atom("unsupported", "coverage_condition_unsupported")).otherwise(_atom("unsupported", "exemption_condition_unsupported"))
    return (
        F.when(text.rlike(OPERATIVE), made("operative", False, F.array(_atom("operative_condition", "operative_condition_unresolved"))))
        .when((role == "exemption") & text.rlike(PRODUCT), made("situational", False, none))
        .when(has_date & text.rlike(REPLACEMENT), made("property", True, F.array(built_atom, _atom("replacement_unit", "replacement_unit_status_unknown"))))
        .when(F.size(atoms) > 0, made("property", text.rlike(TYPE_LIST), atoms))
        .when(text.rlike(GENERIC), made("generic", False, none))
        .when(text.rlike(SITUATIONAL), made("situational", False, none))
        .otherwise(made("unsupported", False, F.array(unsupported)))
    )


def evaluate_atom(atom: Column, year: Column, low: Column, high: Column, use_class: Column) -> Column:
    unknown = F.lit(None).cast("boolean")
    return (
        F.when(atom["kind"].isin("year_built", "certificate_of_occupancy_proxy"), built(atom["op"], atom["n"], year))
        .when(atom["kind"] == "units", compare_units(atom["op"], atom["n"], low, high))
        .when(atom["kind"] == "property_type", F.when(use_class.isin("apartment", "subsidized_housing"), False).otherwise(unknown))
        .when(atom["kind"] == "separately_alienable", F.when((use_class == "apartment") & (low >= 2), False).otherwise(unknown))
        .otherwise(unknown)
    )


def evaluate_clause(clause: Column, role: Column | str, year: Column, low: Column, high: Column, use_class: Column) -> Column:
    """struct(value, reasons) of a classified clause. Situational and generic clauses are neutral: they cover, and don't exempt."""
    role = F.lit(role) if isinstance(role, str) else role
    values = F.transform(clause["atoms"], lambda a: F.struct(a.alias("atom"), evaluate_atom(a, year, low, high, use_class).alias("value")))
    flat = F.transform(values, lambda v: v["value"])
    neutral = clause["kind"].isin("situational", "generic")
    value = F.when(neutral, role == "coverage").when(clause["any_of"], or3(flat)).otherwise(and3(flat))
    dated = ("year_built", "certificate_of_occupancy_proxy")

    def reason(a: Column) -> Column:
        kind = a["kind"]
        return (
            F.when(kind.isin(*dated) & year.isNotNull(), F.lit("year_built_in_cutoff_year"))
            .when(kind.isin(*dated), F.lit("year_built_missing"))
            .when((kind == "units") & low.isNotNull(), F.lit("property_type_uncertain"))
            .otherwise(a["reason"])
        )

    open_atoms = F.transform(F.filter(values, lambda v: v["value"].isNull()), lambda v: reason(v["atom"]))
    return F.struct(value.alias("value"), F.when(value.isNull(), open_atoms).otherwise(F.array().cast("array<string>")).alias("reasons"))
