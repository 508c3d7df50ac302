"""Streets, places and ZIP codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First three digits of ZIP codes by state.
ZIP_RANGES = {"CA": ("900", "961"), "NJ": ("070", "089"), "MA": ("010", "027")}
# Postal directionals, secondary units, and standard suffixes with their variants.
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
UNITS = ("APT", "BLDG", "DEPT", "FL", "HNGR", "LOT", "PIER", "RM", "SLIP", "SPC", "STE", "STOP", "TRLR", "UNIT")
# Street suffixes and their common variants, as the postal service's Publication 28, Appendix C1 lists them.
VARIANTS = {
    "ALY": "ALLEY ALLEE ALLY",
    "AVE": "AVENUE AV AVEN AVENU AVN AVNUE",
    "BLVD": "BOULEVARD BOUL BOULV",
    "CIR": "CIRCLE CIRC CIRCL CRCL CRCLE",
    "CT": "COURT",
    "DR": "DRIVE DRIV DRV",
    "EXT": "EXTENSION EXTN EXTNSN",
    "HTS": "HEIGHTS HT",
    "HWY": "HIGHWAY HIGHWY HIWAY HIWY HWAY",
    "LN": "LANE",
    "PARK": "PRK",
    "PKWY": "PARKWAY PARKWY PKWAY PKY",
    "PL": "PLACE",
    "PLZ": "PLAZA PLZA",
    "RD": "ROAD",
    "ROW": "",
    "SQ": "SQUARE SQR SQRE SQU",
    "ST": "STREET STRT STR",
    "TER": "TERRACE TERR",
    "WALK": "",
    "WAY": "WY",
}
SUFFIXES = {v: s for s, others in VARIANTS.items() for v in others.split()}
PREFIXES = {"ST": "SAINT", "MT": "MOUNT", "FT": "FORT"}
_ORDINALS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH ELEVENTH TWELFTH THIRTEENTH FOURTEENTH FIFTEENTH SIXTEENTH SEVENTEENTH EIGHTEENTH NINETEENTH TWENTIETH".split()


def ordinals() -> dict[str, str]:
    ending = {1: "ST", 2: "ND", 3: "RD"}
    return {w: f"{i}{'TH' if 10 <= i % 100 <= 20 else ending.get(i % 10, 'TH')}" for i, w in enumerate(_ORDINALS, 1)}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def level_for(jurisdiction: Column) -> Column:
    return F.when(jurisdiction.rlike(r"^[A-Z]{2}\z"), F.lit("state")).otherwise(F.lit("city"))


def state_of(jurisdiction: Column) -> Column:
    return F.trim(F.element_at(F.split(jurisdiction, ","), -1))


def zip_outside_state(state: Column, zip_code: Column) -> Column:
    """NULL without a ZIP code or for a state without known ranges."""
    known = F.when((zip_code == "") | zip_code.isNull(), F.lit(None).cast("boolean"))
    for s, (low, high) in ZIP_RANGES.items():
        known = known.when(state == s, ~F.substring(zip_code, 1, 3).between(low, high))
    return known


def clean(text: Column) -> Column:
    """Upper case, without commas and points that aren't decimal, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), r",|(?<!\d)\.|\.(?!\d)", " "), r"\s+", " "))


def same_place(a: Column, b: Column) -> Column:
    return clean(a) == clean(b)


def split_matched(matched: Column) -> Column:
    """struct(street, city, state, zip) from the right; all in street if there are fewer than four parts."""
    parts = F.transform(F.split(matched, ","), lambda x: F.trim(x))
    few = F.size(parts) < 4
    whole = F.struct(F.trim(matched).alias("street"), F.lit("").alias("city"), F.lit("").alias("state"), F.lit("").alias("zip"))
    cut = F.struct(
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 3, F.lit(0))), ", ").alias("street"), F.try_element_at(parts, F.lit(-3)).alias("city"), F.try_element_at(parts, F.lit(-2)).alias("state"), F.try_element_at(parts, F.lit(-1)).alias("zip")
    )
    return F.when(few, whole).otherwise(cut)


_NUMBER = r"\d+(?:\.\d+)?[A-Z]?"
_HOUSE = rf"^({_NUMBER})(?:\s*-\s*({_NUMBER}))?\s+(\S.*)$"
_UNIT = rf"^(\S+ .*?\S)\s+((?:(?:{'|'.join(UNITS)})\s+\S+|#\s*\S+))$"


def _let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def parse_street(text: Column) -> Column:
    """struct(low, high, predir, name, suffix, postdir, unit) of a street line. A part is taken off only if another remains."""

    def of(cleaned: Column) -> Column:
        unit = F.nullif(F.regexp_extract(cleaned, _UNIT, 2), F.lit(""))
        body = F.when(unit.isNull(), cleaned).otherwise(F.regexp_extract(cleaned, _UNIT, 1))
        low, high, rest = (F.nullif(F.regexp_extract(body, _HOUSE, g), F.lit("")) for g in (1, 2, 3))
        words = F.split(F.coalesce(rest, body), r"\s+")
        known = _map(ordinals())
        tokens = F.transform(words, lambda t: F.coalesce(F.try_element_at(known, t), F.regexp_replace(t, r"^0+(\d+(?:ST|ND|RD|TH))$", "$1")))
        directions = _map(DIRECTIONS | {d: d for d in DIRECTIONS.values()})
        suffixes = _map(SUFFIXES | {s: s for s in VARIANTS})

        def first(t: Column) -> Column:
            pre = F.when(F.size(t) > 1, F.try_element_at(directions, F.element_at(t, 1)))
            t2 = F.when(pre.isNotNull(), F.slice(t, 2, F.size(t))).otherwise(t)
            return F.struct(pre.alias("pre"), t2.alias("t"))

        def last(s: Column, table: Column, name: str) -> Column:
            got = F.when(F.size(s["t"]) > 1, F.try_element_at(table, F.element_at(s["t"], -1)))
            return F.struct(s["pre"].alias("pre"), *([s["post"].alias("post")] if name == "suffix" else []), got.alias(name), F.when(got.isNotNull(), F.slice(s["t"], 1, F.greatest(F.size(s["t"]) - 1, F.lit(1)))).otherwise(s["t"]).alias("t"))

        def final(s: Column) -> Column:
            full = F.when(F.size(s["t"]) > 1, F.try_element_at(_map(PREFIXES), F.element_at(s["t"], 1)))
            name = F.when(full.isNotNull(), F.concat(F.array(full), F.slice(s["t"], 2, F.size(s["t"])))).otherwise(s["t"])
            return F.struct(low.alias("low"), high.alias("high"), s["pre"].alias("predir"), name.alias("name"), s["suffix"].alias("suffix"), s["post"].alias("postdir"), unit.alias("unit"))

        a = _let(tokens, first)
        return _let(_let(_let(a, lambda s: last(s, directions, "post")), lambda s: last(s, suffixes, "suffix")), final)

    return _let(clean(text), of)
