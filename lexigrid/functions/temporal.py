"""Evidence of effective dates: what its classification lets it say, and relative dates by a small grammar that refuses whatever it doesn't know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import boundaries as B
from . import dates as D
from .text import _let

# The wordings of the grammar, its ordinals, which events an anchor accepts, and how far a sentence is read.
TRIGGER = r"(?:take\s+effect|become\s+effective|become\s+operative)"
FORMULA = TRIGGER + r"\s+(?:on\s+)?the\s+first\s+day\s+of\s+the\s+([a-z]+(?:-[a-z]+)?|\d{1,2}(?:st|nd|rd|th))\s+month\s+next\s+following\s+(?:the\s+date\s+of\s+)?(enactment|approval)\b"
OTHER_DATE = r"(?i)\btakes?\s+effect\b|\bbecomes?\s+(?:effective|operative)\b|\beffective\b|\boperative\b|\bappl(?:y|ies|icable)\b"
QUALIFIER = r"(?i)\b(?:except|notwithstanding|unless|subject\s+to)\b"
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth",
    "eighteenth", "nineteenth", "twentieth", "twenty-first", "twenty-second", "twenty-third", "twenty-fourth",
)
EVENTS = {"enactment": ("approved", "enacted", "signed"), "approval": ("approved",)}
CONTEXT = 400
# Lines that say that a bill was enacted, or that it ended.
ENACTED = r"(?im)\b(?:approved|enacted|signed)\b(?:\s+by\s+(?:the\s+)?governor)?[\s,:]*(?:on\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s*\d{4}|^\s*(?:signed by the governor\b.*|chapter \d+ of the acts of \d{4}\b.*)$"
TERMINAL = r"(?im)^\s*(?:no further action(?: taken)?|withdrawn|leave to withdraw(?: granted)?|rejected|defeated|vetoed)\s*\.?\s*$"
KINDS = ("explicit_operative_date", "relative_date_formula", "history_note", "operative_condition")


def ordinal(token: Column) -> Column:
    """1 to 24 of an ordinal in words or digits, else NULL."""
    digits = F.regexp_extract(token, r"^(\d{1,2})(?:st|nd|rd|th)$", 1)
    n = F.when(digits != "", digits.cast("int")).otherwise(F.nullif(F.array_position(F.array(*map(F.lit, ORDINALS)), F.lower(token)).cast("int"), F.lit(0)))
    return F.when(n.between(1, len(ORDINALS)), n)


def sentence_around(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """What stands before and after a passage in its sentence."""
    low = F.greatest(start - CONTEXT, F.lit(0))
    before = F.regexp_replace(F.substring(text, low + 1, start - low), r"(?s)^.*\.(?=[ \n\t])", "")
    return before, F.regexp_extract(F.substring(text, end + 1, F.lit(CONTEXT)), r"(?s)^(.*?\.(?=\s|$)|.*)", 1)


def relative_date(span: Column, before: Column, after: Column, bases: Column) -> Column:
    """struct(resolved, reason): the first day of the n-th month after the one base date that a text records, or why there is none.

    span: verified evidence, NULL if it isn't; bases: `base_dates` of the text, which are looked for only if the span holds one formula.
    """
    formulas = F.regexp_count(span, F.lit("(?i)" + FORMULA))
    word, anchor = (F.regexp_extract(span, "(?i)" + FORMULA, g) for g in (1, 2))
    n, lead = ordinal(word), F.element_at(F.split(span, "(?i)" + FORMULA), 1)
    accepted = F.when(F.lower(anchor) == "approval", F.array(*map(F.lit, EVENTS["approval"]))).otherwise(F.array(*map(F.lit, EVENTS["enactment"])))
    days = F.when(formulas == 1, F.array_distinct(F.transform(F.filter(bases, lambda b: F.array_contains(accepted, b["event"])), lambda b: b["date"])))

    def why(days: Column) -> Column:
        return (
            F.when(span.isNull(), "not verified").when(formulas != 1, "not one formula").when(F.regexp_count(span, F.lit("(?i)" + TRIGGER)) != 1, "more than one date").when(n.isNull(), "unsupported ordinal")
            .when(F.concat(before, lead).rlike(QUALIFIER) | after.rlike(OTHER_DATE), "qualified").when(F.size(days) == 0, "no base date").when(F.size(days) > 1, "several base dates")
        )

    def out(days: Column, reason: Column) -> Column:
        return F.struct(F.when(reason.isNull(), D.first_of_month_after(F.get(days, F.lit(0)), n)).alias("resolved"), reason.alias("reason"))

    return _let(days, lambda days: _let(why(days), lambda reason: out(days, reason)))


def in_evidence(effective: Column, span: Column) -> Column:
    """Whether a partial date is written in the words, without computing any."""
    year, month = F.substring(effective, 1, 4), F.date_format(D.date_bounds(effective)["earliest"], "MMMM")
    whole = F.exists(D.calendar_dates(span), lambda d: F.startswith(d.cast("string"), effective))
    return whole | ((F.length(effective) == 4) & F.regexp_like(span, F.concat(F.lit(r"\b"), year, F.lit(r"\b")))) | ((F.length(effective) == 7) & F.regexp_like(span, F.concat(F.lit(r"(?i)\b"), month, F.lit(r"\b\W{0,3}"), year, F.lit(r"\b"))))


def effective_evidence(kind: Column, effective: Column, span: Column, text: Column, start: Column, end: Column) -> Column:
    """struct(applied, effective, dated, rejection, reason): what evidence of this kind establishes. span: verified evidence at start to end of the text, NULL if it isn't there.

    Words of the relative grammar are a formula whatever they were called; an explicit date inside a history note is history. dated: there is evidence of a
    date even if none could be resolved. reason: why a formula wasn't resolved.

    The whole text is read for its base dates only, if there is a formula; all else is judged on what stands around the passage, cut out once, and each step's value is bound once.
    """
    formula, reach = span.rlike("(?i)" + FORMULA), max(CONTEXT, D.NOTE_REACH)
    low = F.greatest(start - reach, F.lit(0))
    near = F.struct(F.substring(text, low + 1, end - low + reach + 1).alias("text"), (start - low).alias("start"), (end - low).alias("end"))

    def noted(x: Column) -> Column:
        return _let(D.enclosing_note(x["text"], x["start"], x["end"]), lambda note: F.substring(x["text"], note["start"] + 1, note["end"] - note["start"]))

    def judged(x: Column, context: Column, history: Column) -> Column:
        applied = F.when(formula, KINDS[1]).when((kind == KINDS[0]) & history, KINDS[2]).otherwise(kind)
        return _let(applied, lambda applied: _let(why_not(applied, context, history), lambda rejection: out(x, applied, rejection)))

    def why_not(applied: Column, context: Column, history: Column) -> Column:
        stated = F.coalesce(in_evidence(effective, span), F.lit(False))
        return (
            F.when(span.isNull(), "evidence not found").when(applied.isNull(), "not classified").when(~applied.isin(*KINDS), "unknown kind").when((applied == KINDS[0]) & effective.isNull(), "no date given")
            .when((applied == KINDS[0]) & ~stated, "date not in its evidence").when((applied == KINDS[2]) & ~history & (F.size(D.calendar_dates(context)) == 0), "no history in the note")
        )

    def out(x: Column, applied: Column, rejection: Column) -> Column:
        before, after = sentence_around(x["text"], x["start"], x["end"])
        ok = rejection.isNull()

        def made(resolved: Column) -> Column:
            found = F.when(ok & (applied == KINDS[0]), effective).when(ok & (applied == KINDS[1]), resolved["resolved"].cast("string"))
            return F.struct(applied.alias("applied"), found.alias("effective"), (ok & applied.isin(KINDS[0], KINDS[1])).alias("dated"), rejection.alias("rejection"), resolved["reason"].alias("reason"))

        return _let(F.when(ok & (applied == KINDS[1]), relative_date(span, before, after, D.base_dates(text))), made)

    return _let(near, lambda x: _let(noted(x), lambda context: _let(context.rlike(B.HISTORY_NOTE), lambda history: judged(x, context, history))))
