"""What a passage on scope governs, and statutes that a citation names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nouns of a legal text's containers, and the wordings that make one the subject of a clause.
KIND = r"(?:act|division|chapter|article|part|title|section|subsection|subdivision|ordinance|code|law)s?"
CONTAINER = rf"(?i)\b(?:(?:the\s+provisions\s+of\s+)?(?:this|these)\s+{KIND}\s+(?:shall|does|do|is|are|will|applies|apply)\b|(?:nothing\s+in|(?:for\s+)?(?:the\s+)?purposes\s+of)\s+(?:this|these)\s+{KIND}\b)"
REFERENCE = r"(?i)(?:§+|\b(?:sections?|subsections?|paragraphs?|subdivisions?|clauses?)\b)\s*(?:\d|\([A-Za-z0-9]{1,4}\))"
# Words that command or allow.
NORMATIVE = r"(?i)\b(?:shall|must|may\s+only|may\s+not|no\s+\w+\s+may|prohibited|unlawful|permitted|allowed|entitled|required)\b"
#: (state, prefix of the key, pattern of the section).
STATUTES = (("CA", "ca-civ-", r"(?i)Civ(?:\.|il)\s+Code\s+(?:§+\s*)?(\d+(?:\.\d+)?)"), ("NJ", "nj-", r"(?i)N\.?J\.?S\.?A?\.?\s*(\d+A?:\d+-\d+(?:\.\d+)?)"), ("MA", "ma-", r"(?i)c\.\s*(\d+[A-Z]?)"))


def scope_mode(words: Column) -> Column:
    return F.when(words.rlike(CONTAINER), "structural").when(words.rlike(REFERENCE), "explicit_reference").otherwise("named_subject")


def statute_keys(citation: Column, state: Column) -> Column:
    """The distinct keys of a citation, by its state's patterns."""
    none = F.array().cast("array<string>")
    per_state = [F.when(state == s, F.transform(F.regexp_extract_all(citation, F.lit(p), F.lit(1)), _with(prefix))).otherwise(none) for s, prefix, p in STATUTES]
    return F.array_distinct(F.concat(*per_state))


def _with(prefix: str):
    return lambda x: F.concat(F.lit(prefix), x)
