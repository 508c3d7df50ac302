"""Facts of a property from free text and recorded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and the wordings of unit ranges, first match wins.
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8}
OR_MORE = r"(?i)\b(\w+) or more (?:apartments|units)\b"
PLUS = r"(?i)\((\d+)\+ units\)"
FROM_TO = r"(?i)\b(\d+) to (\d+) units\b"
UNITS_OR_MORE = r"(?i)\b(\d+) units or more\b"
UNITS_OR_LESS = r"(?i)\b(\d+) units or less\b"
CODED_RANGE = r"(?i)^(?:MXD )?(\d+)-(\d+)-UNIT-APT$"
CODED_OVER = r"(?i)^(?:MXD )?>(\d+)-UNIT-APT$"
APT_RANGE = r"(?i)^APT (\d+)-(\d+) UNITS$"
CODED_UNITS = r"(?<![A-Z0-9])(\d+)U(?=|-|G|/)"
APARTMENT = r"(?i)apartment|\bAPT\b|UNIT-APT|\bflats?\b|\(5\+ units\)"


def unit_range(description: Column) -> Column:
    """struct(low, high); a NULL high is open; both NULL if no wording matches."""
    d = F.trim(description)

    def number(pattern: str, group: int) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(d, pattern, group), F.lit("")), F.lit("999999999")).cast("int")

    def pair(low: Column, high: Column | None) -> Column:
        return F.when(low.isNotNull(), F.struct(low.alias("low"), (F.lit(None).cast("int") if high is None else high).alias("high")))

    word = F.lower(F.regexp_extract(d, OR_MORE, 1))
    table = F.create_map(*(F.lit(x) for p in WORDS.items() for x in p))
    named = F.when(word.rlike(r"^\d+$"), F.try_to_number(word, F.lit("999999999")).cast("int")).otherwise(F.try_element_at(table, word))
    return F.coalesce(
        pair(named, None), pair(number(PLUS, 1), None), pair(number(FROM_TO, 1), number(FROM_TO, 2)), pair(number(UNITS_OR_MORE, 1), None), F.when(number(UNITS_OR_LESS, 1).isNotNull(), F.struct(F.lit(1).alias("low"), number(UNITS_OR_LESS, 1).alias("high"))),
        pair(number(CODED_RANGE, 1), number(CODED_RANGE, 2)), pair(number(CODED_OVER, 1) + 1, None), pair(number(APT_RANGE, 1), number(APT_RANGE, 2)), F.struct(F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high")),
    )


def use_class(description: Column, label: Column) -> Column:
    """label: the data's own words for the use code, or NULL."""
    return F.when(F.contains(F.upper(description), F.lit("SUBSD HOUSING")), F.lit("subsidized_housing")).when(description.rlike(APARTMENT) | F.coalesce(label, F.lit("")).rlike(APARTMENT), F.lit("apartment"))


def unit_facts(units: Column, description: Column) -> Column:
    """struct(units_min, units_max, units_source): a recorded count, unless the description contradicts it; else the description's range."""
    recorded = F.when(units.rlike(r"^\d+$"), F.nullif(units.cast("int"), F.lit(0)))
    span = unit_range(description)
    coded = F.transform(F.regexp_extract_all(description, F.lit(CODED_UNITS), F.lit(1)), lambda x: x.cast("int"))
    clash = ((F.size(coded) > 0) & ~F.array_contains(coded, recorded)) | F.coalesce(recorded < span["low"], F.lit(False)) | F.coalesce(recorded > span["high"], F.lit(False))

    def out(low: Column, high: Column, source: str) -> Column:
        return F.struct(low.cast("int").alias("units_min"), high.cast("int").alias("units_max"), F.lit(source).alias("units_source"))

    nothing = F.lit(None)
    return F.when(recorded.isNotNull() & clash, out(nothing, nothing, "conflict")).when(recorded.isNotNull(), out(recorded, recorded, "recorded")).when(span["low"].isNotNull(), out(span["low"], span["high"], "use_description")).otherwise(out(nothing, nothing, "missing"))
