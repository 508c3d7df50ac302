"""Partial dates, temporal status, relative dates and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_bounds(partial: Column) -> Column:
    """struct(earliest, latest) of YYYY, YYYY-MM or YYYY-MM-DD; NULLs for anything that is no calendar date."""
    n = F.length(partial)
    first = F.when(n == 4, F.concat(partial, F.lit("-01-01"))).when(n == 7, F.concat(partial, F.lit("-01"))).when(n == 10, partial)
    earliest = F.try_to_date(first, "yyyy-MM-dd")
    latest = F.when(n == 4, F.try_to_date(F.concat(partial, F.lit("-12-31")), "yyyy-MM-dd")).when(n == 7, F.last_day(earliest)).otherwise(earliest)
    return F.struct(earliest.alias("earliest"), latest.alias("latest"))


def temporal_status(status: Column, effective: Column, as_of: Column) -> Column:
    """A rule in force whose date is later than as_of isn't effective yet. A partial date counts from its first day."""
    return F.when((status == "in_force") & (date_bounds(effective)["earliest"] > as_of), F.lit("not_yet_effective")).otherwise(status)


def derive_status(enactment: Column, effective: Column, has_evidence: Column, as_of: Column, codified: Column) -> Column:
    """struct(status, why): NULL status if the record must be held."""
    bounds = date_bounds(effective)

    def out(status: Column | str | None, why: str) -> Column:
        status = status if isinstance(status, Column) else F.lit(status).cast("string")
        return F.struct(status.alias("status"), F.lit(why).alias("why"))

    return (
        F.when(enactment.isin("pending", "failed"), out(enactment, "enactment_status"))
        .when(effective.isNull() & has_evidence, out(None, "relative_date_unresolved"))
        .when(effective.isNull() & ~codified, out(None, "no_effective_date"))
        .when(effective.isNull(), out("in_force", "codified_without_date"))
        .when(bounds["earliest"].isNull() | bounds["latest"].isNull(), out(None, "not_a_calendar_date"))
        .when(bounds["latest"] <= as_of, out("in_force", "effective_on_or_before"))
        .when(bounds["earliest"] > as_of, out("not_yet_effective", "effective_after"))
        .otherwise(out(None, "straddles_as_of"))
    )


def first_of_month_after(base: Column, n: Column) -> Column:
    """The first day of the n-th month next following a date."""
    return F.trunc(F.add_months(base, n), "MONTH").cast("date")


def written_date(text: Column) -> Column:
    """`August 1, 2025` in any case; NULL if it is no date."""
    return F.try_to_date(F.regexp_replace(F.initcap(F.lower(text)), r"\s+", " "), "MMMM d, yyyy")


DATE_TEXT = r"(?i)\b(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"


def calendar_dates(text: Column) -> Column:
    """Dates written in a text, in order; US numeric dates are month first. Repeats once."""

    def one(d: Column) -> Column:
        parts = F.split(d, "[-/]")
        us = F.when(d.rlike(r"^\d{1,2}[-/]"), F.concat(parts[2], F.lit("-"), F.lpad(parts[0], 2, "0"), F.lit("-"), F.lpad(parts[1], 2, "0")))
        spaced = F.regexp_replace(F.regexp_replace(d, r",\s*", ", "), r"\s+", " ")
        return F.when(d.rlike(r"^\d{4}-"), F.try_to_date(d, "yyyy-MM-dd")).when(us.isNotNull(), F.try_to_date(us, "yyyy-MM-dd")).otherwise(F.try_to_date(F.initcap(F.lower(spaced)), "MMMM d, yyyy"))

    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(DATE_TEXT), F.lit(0)), one), lambda d: d.isNotNull()))


# How a text records its enactment. The first letter is looked at before anything else, as most places fail there.
BASE_DATE = r"(?i)(?=[aes])\b(approved|enacted|signed)\b(?:\s+by\s+(?:the\s+)?governor)?[\s,:]*(?:on\s+)?((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4})"

# How far a note reaches back from a passage, and on after it.
NOTE_REACH = 300


def base_dates(text: Column) -> Column:
    """array<struct<event, date, start, end, text>>: enactment records written in a text, without dates that aren't in the calendar. A text without one is read once."""
    from .text import spans

    def one(s: Column) -> Column:
        day = written_date(F.regexp_extract(s["text"], BASE_DATE, 2))
        return F.struct(F.lower(F.regexp_extract(s["text"], BASE_DATE, 1)).alias("event"), day.alias("date"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))

    none = F.array().cast("array<struct<event:string,date:date,start:int,end:int,text:string>>")
    return F.when(text.rlike(BASE_DATE), F.filter(F.transform(spans(text, BASE_DATE), one), lambda x: x["date"].isNotNull())).when(text.isNotNull(), none)


def enclosing_note(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of the bracketed note around a passage, else of the passage: from the nearest bracket before it that isn't closed again, to the first
    closing bracket after it, each within NOTE_REACH characters."""
    from .text import _let, spans

    low = F.greatest(start - NOTE_REACH, F.lit(0))
    marks = F.reverse(spans(F.substring(text, low + 1, start - low), r"[()\[\]]"))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("at"))

    def back(acc: Column, m: Column) -> Column:
        closes = m["text"].isin(")", "]")
        here = F.struct(F.lit(0).alias("depth"), m["start"].alias("at"))
        on = F.struct((acc["depth"] + F.when(closes, 1).otherwise(-1)).alias("depth"), acc["at"].alias("at"))
        return F.when(acc["at"].isNotNull(), acc).when(~closes & (acc["depth"] == 0), here).otherwise(on)

    opened = low + F.aggregate(marks, zero, back, lambda acc: acc["at"])
    close = F.regexp_instr(F.substring(text, end + 1, F.lit(NOTE_REACH + 1)), F.lit(r"[)\]]"))

    def around(x: Column) -> Column:
        noted = x["opened"].isNotNull() & (x["close"] > 0)
        return F.struct(F.when(noted, x["opened"]).otherwise(start).alias("start"), F.when(noted, end + x["close"]).otherwise(end).alias("end"))

    return _let(F.struct(opened.alias("opened"), close.alias("close")), around)


SESSION = r"(?i)\b(\d{3})(?:st|nd|rd|th)\s*\(\s*(?:(\d{4})\s*[-–]\s*(\d{4})|Current)\s*\)"


def session_of(text: Column) -> Column:
    """struct(general_court, first_year, last_year, ends_by, consistent) of the first session label; NULL without one.
    The 193rd court sat in 2023 and 2024; a court ends on February 1 after its second year."""
    n, y1, y2 = (F.regexp_extract(text, SESSION, g) for g in (1, 2, 3))
    court = F.when(n != "", n.cast("int"))
    start = 2023 + 2 * (court - 193)
    agrees = (y1 == "") | ((y1 == start.cast("string")) & (y2 == (start + 1).cast("string")))
    made = F.struct(court.alias("general_court"), start.alias("first_year"), (start + 1).alias("last_year"), F.make_date(start + 2, F.lit(2), F.lit(1)).alias("ends_by"), agrees.alias("consistent"))
    return F.when(court.isNotNull(), made)
