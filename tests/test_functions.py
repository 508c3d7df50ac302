"""Edge cases of functions and operators of the rule engine."""

import datetime

from pyspark.sql import functions as F

from lexigrid.functions import boundaries, dates, facts, kleene, places, text
from lexigrid.operators import graph, joins


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_kleene_tables(spark):
    t, f, u = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    got = one(spark, *(g(F.array(*v)) for v in ((t, u), (f, u), (t, t), (f, f)) for g in (kleene.and3, kleene.or3)))
    assert list(got) == [None, True, False, None, True, True, False, False]
    empty = F.array().cast("array<boolean>")
    assert list(one(spark, kleene.and3(empty), kleene.or3(empty))) == [True, False]


def test_units_interval(spark):
    n = lambda *v: [F.lit(x).cast("int") for x in v]
    cases = [("<=", 4, 2, 4, True), ("<=", 4, 5, None, False), ("<=", 4, 2, None, None), ("==", 2, 2, 2, True), ("==", 2, 1, 3, None), ("==", 2, 3, 4, False), (">=", 3, 3, None, True), (">=", 3, 1, 2, False), ("<=", 4, None, None, None)]
    for op, k, low, high, want in cases:
        a, b, c = n(k, low, high)
        assert one(spark, kleene.compare_units(op, a, b, c))[0] is want, (op, k, low, high)


def test_partial_dates(spark):
    got = [one(spark, dates.date_bounds(F.lit(p)).alias("b"))["b"] for p in ("2024", "2024-02", "2023-02-29", "x")]
    assert (got[0].earliest, got[0].latest) == (datetime.date(2024, 1, 1), datetime.date(2024, 12, 31))
    assert got[1].latest == datetime.date(2024, 2, 29)
    assert got[2].earliest is None and got[3].earliest is None


def test_relative_date(spark):
    assert one(spark, dates.first_of_month_after(F.lit("2021-06-18").cast("date"), F.lit(7)))[0] == datetime.date(2022, 1, 1)


def test_spans():
    assert text.find_span("a b", "x a b a b")[:4] == ("exact_match", 2, 5, 2)
    assert text.find_span("a  b", "x a\n b")[0] == "normalized_match"
    assert text.find_span("f(a)", "x f ( a ) y")[0] == "layout_normalized_match"
    assert text.find_span("", "x")[0] == text.find_span("z", "x")[0] == text.find_span(None, "x")[0] == text.find_span("a", None)[0] == "failed"
    assert text.find_span(" a\u00a0b ", "xa \n b a\tb") == ("normalized_match", 1, 6, 2, "a \n b")
    assert text.find_span("e\u0301t", "l'\u00e9t")[:3] == ("normalized_match", 2, 4)
    assert text.find_span("see [ 1 ](b) c", "x see\n[1 ] ( b )c and [2]") == ("layout_normalized_match", 2, 17, 1, "see\n[1 ] ( b )c")
    assert text.find_span("see [ 1 ](b) c", "x see\n[1 ] ( b ) c and [2]") == ("layout_normalized_match", 2, 18, 1, "see\n[1 ] ( b ) c")
    assert text.find_span("a b", "a (b") == ("failed", None, None, 0, None)
    assert text.find_span("aa", "aaaa")[3] == 2 and text.find_span("a a", "a  a  a  a")[3] == 2


def test_anchored_spans():
    assert text.find_anchored("b", "a b \n", True) == ("exact_match", 2, 3) and text.find_anchored("b", "a b c", True)[0] == "failed"
    assert text.find_anchored("a  b", " a b c", False) == ("normalized_match", 1, 4) and text.find_anchored("(c)", "a ( c ) ", True) == ("layout_normalized_match", 2, 7)
    assert text.find_anchored(" ", "a", True)[0] == "failed"


def test_folded_places(spark):
    got = one(spark, text.fold_places(F.lit("a \n b ( c ]  [")).alias("x"), text.fold_places(F.lit("a \n b ( c ]  ["), True).alias("y"), text.fold_places(F.lit(None).cast("string")).alias("z"))
    assert got["x"].text == "a b ( c ] [" and got["x"].places == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11, 13]
    assert got["y"].text == "a b(c][" and got["y"].places == [0, 1, 4, 6, 8, 10, 13] and got["z"].text is None


def found_in(spark, words, history=False):
    return one(spark, boundaries.boundaries(F.lit(words), F.lit(history), 100).alias("b"))["b"]


def test_boundaries_take_a_place_once(spark):
    words = "This section shall remain in effect only until January 1, 2030, and as of that date is repealed."
    got = found_in(spark, words)
    assert [(b.kind, b.role, b.end_exclusive.isoformat(), b.date_start, b.date_end) for b in got] == [("repealed_on", "end", "2030-01-01", 47, 62)]
    words = "It remains in effect only until January 1, 2030, and as of that date is repealed."
    assert [(b.kind, b.end_exclusive.isoformat(), b.raw_start) for b in found_in(spark, words)] == [("repealed_on", "2030-01-01", 103)]


def test_boundaries_on_one_date(spark):
    got = found_in(spark, "repealed on January 1, 2030 or it expires on January 1, 2030")
    assert [(b.kind, b.date_start, b.ambiguous_day) for b in got] == [("repealed_on", 12, None), ("expires_on", 45, datetime.date(2030, 1, 1))]
    got = found_in(spark, "valid from March 3, 2020 through March 3, 2020, note of 4/5/2021 and 2022-13-01", True)
    assert [(b.kind, b.role, b.date_start) for b in got] == [("effective_from", "start", 11), ("valid_through", "end", 33), ("unknown_temporal_note", "unknown", None)]
    assert found_in(spark, "") == [] and one(spark, boundaries.boundaries(F.lit(None).cast("string"), F.lit(False)).alias("b"))["b"] in (None, [])
    assert [b.kind for b in found_in(spark, "Amended by Ord. 5. Effective May 1, 2020")] == ["amendment_history"]


def test_ranges(spark):
    got = one(spark, *(text.expand_range(F.lit(r)) for r in ("§ 9(a)-(b)(1)-(2)", "(c)-(a)", "§ 4", "(1)-(3)", "(a)-(2)", "(A)-(b)")))
    assert list(got) == [["§ 9(a)(1)", "§ 9(a)(2)", "§ 9(b)(1)", "§ 9(b)(2)"], ["(c)", "(a)"], ["§ 4"], ["(1)", "(2)", "(3)"], ["(a)", "(2)"], ["(A)", "(b)"]]


def test_figures(spark):
    got = one(spark, *(text.figures(F.lit(t)) for t in ("one hundred twenty days and $5 from August 1, 2025", "ten (10) percent within 2.50 years, 8/1/2025", "nothing, 2025-99-99", "Thirty-one business days; $1,200.00; 31 days")))
    assert list(got) == [["day:120", "money:5", "date:2025-08-01"], ["percent:10", "year:2.5", "date:2025-08-01"], [], ["day:31", "money:1200"]]


def test_suffix_variants(spark):
    got = one(spark, *(places.parse_street(F.lit(s)) for s in ("12 N MAPLE HTS", "12 Maple Avn", "3 Park Row", "9 Elm Terr", "1 Ocean Hiway")))
    assert [("".join(r["name"]), r.suffix) for r in got] == [("MAPLE", "HTS"), ("MAPLE", "AVE"), ("PARK", "ROW"), ("ELM", "TER"), ("OCEAN", "HWY")]


def test_an_empty_jurisdiction_is_unresolved(spark):
    from lexigrid.operators import applicability

    rules = spark.createDataFrame([(1, "CA", "in_force"), (2, "", "failed"), (3, "NJ", "failed")], "rule_id int, jurisdiction string, status string")
    rows = spark.createDataFrame([(1, "", None), (2, "CA", ""), (3, None, None)], "address_id int, state_jurisdiction string, local_jurisdiction string")
    got = {(r.address_id, r.rule_id) for r in applicability.candidates(rules, rows).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_unit_range_and_conflict(spark):
    r = one(spark, facts.unit_facts(F.lit("2"), F.lit("13B-93U-2C-G")).alias("r"))["r"]
    assert (r.units_min, r.units_source) == (None, "conflict")
    r = one(spark, facts.unit_facts(F.lit(""), F.lit("Five or more apartments")).alias("r"))["r"]
    assert (r.units_min, r.units_max, r.units_source) == (5, None, "use_description")


def test_level_needs_a_whole_match(spark):
    assert list(one(spark, places.level_for(F.lit("CA\n")), places.level_for(F.lit("CA")))) == ["city", "state"]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(60)} == {100}


def test_overlaps_across_blocks(spark):
    a = spark.createDataFrame([("d", 1, 0, 500), ("d", 2, 400, 900), ("d", 3, 500, 501), ("d", 4, 5, 5)], "doc string, id int, s int, e int")
    got = {(r.id, r.other) for r in joins.overlaps(a, a.withColumnRenamed("id", "other")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (2, 3), (3, 2)}


def test_change_tests(spark):
    from lexigrid.operators import applicability, changes

    kinds = "rule_id string, jurisdiction string, level string, category string, status string, effective_date string, coverage_conditions string, exemptions string"
    rules = spark.createDataFrame([("a", "CA", "state", "rent", "pending", None, None, None), ("b", "Town, CA", "city", "rent", "in_force", "2020-01-01", None, None), ("c", "NJ", "state", "notice", "pending", None, None, None)], kinds)
    facts = [(1, "CA", "Town, CA"), (2, "CA", None), (3, "NJ", None), (4, None, None), (5, "", "")]
    rows = spark.createDataFrame([(*f, 1990, 2, 2, "apartment") for f in facts], "address_id int, state_jurisdiction string, local_jurisdiction string, year_built int, units_min int, units_max int, use_class string")
    shown = applicability.outcomes(rules, rows, "2026-01-01")
    tests = [
        {"id": "1", "kind": "as_of", "states": ["CA"], "rule_ids": ["a"], "before": "2026-01-01", "after": "2026-12-31", "conflict_with": ["Town, CA"]}, {"id": "2", "kind": "boundary", "states": ["CA"], "rule_ids": ["b"]},
        {"id": "3", "kind": "pending", "states": ["NJ", "CA"], "rule_ids": ["c"]}, {"id": "4", "kind": "negative", "states": ["CA"], "rule_ids": [], "category": "rent"},
    ]
    found = changes.run_tests(tests, rules, rows, shown)
    got = {(r.test, r.role, r.address_id) for r in found.collect() if r.role != "undetermined"}
    assert got == {("1", "affected", 1), ("1", "affected", 2), ("1", "conflict", 1), ("2", "affected", 1), ("3", "affected", 3), ("3", "missing", 1), ("3", "missing", 2), ("4", "surfaced", 1), ("4", "surfaced", 2)}
    assert {r.address_id for r in found.where("role = 'undetermined' AND test = '2'").collect()} == {4, 5}
    said = {r.test: r.note for r in changes.notes(found, tests).collect()}
    assert said["1"].startswith("2026-01-01 to 2026-12-31: 2 addresses newly covered; 1 of them") and said["3"].startswith("1 addresses would be affected if enacted; 2 lack") and "2 addresses without" in said["4"]
    try:
        changes.run_tests([{"id": "9", "kind": "other", "states": []}], rules, rows, shown)
        raise AssertionError
    except ValueError:
        pass
