"""Validity boundaries written in a passage, and what a window of them means on a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import calendar_dates, written_date

_DATE = r"((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4})"
_THROUGH = r",?\s+(?:through|thru)\s+"
# Fixed values: (kind, pattern, group of the start, group of the end), earlier ones first.
PATTERNS = (
    ("repealed_on", rf"(?i)\bremains?\s+in\s+effect\s+only\s+until\s+{_DATE},?\s+and\s+as\s+of\s+that\s+date\s+is\s+repealed", 0, 1),
    ("repealed_on", rf"(?i)\brepealed\s+(?:as\s+of|on)\s+{_DATE}", 0, 1),
    ("expires_on", rf"(?i)\bexpires?\s+on\s+{_DATE}", 0, 1),
    ("expires_on", rf"(?i)\b(?:remains?|shall\s+remain|is|are)\s+in\s+effect\s+(?:only\s+)?until\s+{_DATE}", 0, 1),
    ("valid_through", rf"(?i)\b(?:effective|valid|in\s+effect)\s+(?:from\s+|on\s+)?{_DATE}{_THROUGH}{_DATE}", 1, 2),
    ("valid_through", rf"(?i)\bfor\s+the\s+period\s+(?:of\s+|from\s+)?{_DATE}{_THROUGH}{_DATE}", 1, 2),
    ("valid_through", rf"(?i)\b(?:effective|valid|in\s+effect)\s+through\s+{_DATE}", 0, 1),
    ("operative_from", rf"(?i)\bbecomes?\s+operative\s+(?:on|as\s+of)\s+{_DATE}", 1, 0),
    ("effective_from", rf"(?i)\b(?:effective|takes?\s+effect|becomes?\s+effective)\s+(?:on\s+|as\s+of\s+)?{_DATE}", 1, 0),
)
HISTORY_NOTE = r"(?i)\b(?:added|amended|retitled|renumbered|repealed|rewritten|inserted|re-?enacted)\b[^()\[\]]{0,160}?\bby\b"
BOUNDARY = "struct<kind:string,role:string,date:date,end_exclusive:date,ambiguous_day:date,history:boolean,raw_start:int,raw_end:int,date_start:int,date_end:int>"


def _entry(kind: Column, role: str, day: Column, history: Column, raw: tuple[Column, Column], own: tuple[Column, Column]) -> Column:
    end = role == "end"
    none = F.lit(None).cast("date")
    return F.struct(
        kind.alias("kind"), F.lit(role).alias("role"), day.alias("date"), (F.when(kind == "repealed_on", day).otherwise(F.date_add(day, 1)) if end else none).alias("end_exclusive"),
        (F.when(kind == "expires_on", day) if end else none).alias("ambiguous_day"), history.alias("history"), raw[0].alias("raw_start"), raw[1].alias("raw_end"), own[0].alias("date_start"), own[1].alias("date_end"),
    )


def _matches(text: Column, pattern: str, start: int, end: int) -> Column:
    """array<struct<a, b, s, e>>: where each match begins and ends, and the dates of its start and end. Offsets are sums of the lengths of the matches and of what lies between."""
    parts = F.arrays_zip(*(x.alias(n) for n, x in (
        ("m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), ("gap", F.split(text, pattern)),
        ("s", F.regexp_extract_all(text, F.lit(pattern), F.lit(start)) if start else F.array().cast("array<string>")), ("e", F.regexp_extract_all(text, F.lit(pattern), F.lit(end)) if end else F.array().cast("array<string>")),
    )))
    none = F.array().cast("array<struct<a:int,b:int,s:string,e:string,m:string>>")

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        found = F.struct(at.alias("a"), (at + F.length(x["m"])).alias("b"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))
        return F.struct((at + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"), F.when(x["m"].isNull(), acc["l"]).otherwise(F.concat(acc["l"], F.array(found))).alias("l"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("l")), add, lambda acc: acc["l"])


def boundaries(text: Column, history: Column, base: Column | int = 0) -> Column:
    """Boundaries of one passage in the order of their patterns, then the dates that no pattern explains (kind unknown_temporal_note).

    A match whose date an earlier pattern has taken, at the same place, isn't taken again; the same date elsewhere in the passage is. history: the passage dates its own
    wording, so that a bare `effective` date is that of the wording. base: the passage's offset in its source, which raw_start and raw_end count from.
    """
    given = F.struct(F.coalesce(text, F.lit("")).alias("text"), history.alias("history"), (base if isinstance(base, Column) else F.lit(base)).alias("base"))
    return F.transform(F.array(given), lambda x: _scan(x["text"], x["history"], x["base"]))[0]


def _scan(text: Column, history: Column, base: Column) -> Column:
    dated = history | text.rlike(HISTORY_NOTE)

    def day(written: Column) -> Column:
        return written_date(F.regexp_replace(written, r",\s*", ", "))

    def candidates(kind: str, pattern: str, start: int, end: int) -> Column:
        """Of each match, its entries."""

        def entries(x: Column) -> Column:
            out = []
            for group, role, written in ((start, "start", x["s"]), (end, "end", x["e"])):
                if group:
                    # the end of two dates stands last, any other date stands first
                    at = x["b"] - F.length(written) if start and end and role == "end" else x["a"] + F.instr(x["m"], written) - 1
                    name = F.lit(kind) if role == "end" else F.when(dated & F.lit(kind == "effective_from"), "amendment_history").otherwise("effective_from" if kind == "valid_through" else kind)
                    out.append(_entry(name, role, day(written), history, (base + x["a"], base + x["b"]), (at, at + F.length(written))))
            return F.array(*out)

        found = F.transform(_matches(text, pattern, start, end), entries).cast(f"array<array<{BOUNDARY}>>")
        return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<array<{BOUNDARY}>>"))

    def take(found: Column, some: Column) -> Column:
        met = F.exists(some, lambda n: F.exists(found, lambda o: (n["date_start"] < o["date_end"]) & (o["date_start"] < n["date_end"])))
        return F.when(met, found).otherwise(F.concat(found, F.filter(some, lambda n: n["date"].isNotNull())))

    def others(found: Column) -> Column:
        none = F.lit(None).cast("int")
        known = F.transform(found, lambda b: b["date"])
        unknown = F.transform(F.array_except(calendar_dates(text), known), lambda d: _entry(F.lit("unknown_temporal_note"), "unknown", d, history, (none, none), (none, none)))
        return F.concat(found, unknown.cast(f"array<{BOUNDARY}>"))

    return F.aggregate(F.concat(*(candidates(*p) for p in PATTERNS)), F.array().cast(f"array<{BOUNDARY}>"), take, others)


def decide(bounds: Column, as_of: Column) -> Column:
    """struct(outcome, state) of a window: hold, historical, not_yet_effective or nothing."""
    ends = F.filter(bounds, lambda b: b["role"] == "end")
    days = F.array_distinct(F.transform(ends, lambda b: b["end_exclusive"]))
    later = F.filter(bounds, lambda b: b["history"] & (b["date"] > as_of))

    def out(outcome: str | None, state: Column | None = None) -> Column:
        return F.struct(F.lit(outcome).cast("string").alias("outcome"), (F.lit(None) if state is None else state).cast("string").alias("state"))

    current = F.when(F.size(days) == 1, F.lit("current_until"))
    return (
        F.when(F.size(days) > 1, out("hold"))
        .when(F.exists(later, lambda b: b["role"] == "unknown"), out("hold"))
        .when((F.size(days) == 1) & F.coalesce(F.exists(ends, lambda b: b["ambiguous_day"] == as_of), F.lit(False)), out("hold"))
        .when((F.size(days) == 1) & F.coalesce(F.try_element_at(days, F.lit(1)) <= as_of, F.lit(False)), out("historical", F.when(F.forall(ends, lambda b: b["kind"] == "repealed_on"), F.lit("repealed")).otherwise(F.lit("expired"))))
        .when(F.exists(later, lambda b: b["kind"] == "amendment_history"), out("not_yet_effective", current))
        .otherwise(out(None, current))
    )
