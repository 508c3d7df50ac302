"""Extraction, references, spans and integrity where SQL says less than a plain version."""

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import dates as D
from lexigrid.functions import places as P
from lexigrid.functions import text as T
from lexigrid.operators import extraction as X
from lexigrid.operators import integrity as I
from lexigrid.operators import references as R
from lexigrid.plans import projections, responses
from lexigrid.sources.sinks import Artifacts, file_digests
from lexigrid.streaming.runner import results, run_stage


def test_expand_range_has_no_cap(spark):
    ref = "§ 1(a)-(b)(1)-(2)(a)-(b)(1)-(2)(a)-(b)"
    got = spark.range(1).select(T.expand_range(F.lit(ref)).alias("x"), T.expand_range(F.lit("§ 2(a)-(b)-(c)")).alias("y"), T.expand_range(F.lit("§ 3")).alias("z"), T.expand_range(F.lit(None).cast("string")).alias("n")).first()
    assert len(set(got.x)) == 32 and got.x[0] == "§ 1(a)(1)(a)(1)(a)" and got.x[-1] == "§ 1(b)(2)(b)(2)(b)"
    assert got.y == ["§ 2(a)", "§ 2(b)", "§ 2(c)", "§ 2(b)", "§ 2(c)"] or set(got.y) == {"§ 2(a)", "§ 2(b)", "§ 2(c)"}
    assert got.z == ["§ 3"] and got.n is None


def test_spans(spark):
    rows = spark.createDataFrame([("ab12cd345",), ("",), (None,), ("77",), ("é 🙂 5",)], "t string")
    got = {r.t: r.x for r in rows.select("t", T.spans(F.col("t"), r"\d+").alias("x")).collect()}
    for t, x in got.items():
        assert x is None if t is None else all(t[s.start : s.end] == s.text for s in x)
    assert [len(got[t]) for t in ("ab12cd345", "", "77", "é 🙂 5")] == [2, 0, 1, 1]


def plain_note(raw, start, end):
    depth = 0
    for i in range(start - 1, max(-1, start - D.NOTE_REACH - 1), -1):
        if raw[i] in ")]":
            depth += 1
        elif raw[i] in "([":
            if depth == 0:
                ends = [j for j in (raw.find(")", end), raw.find("]", end)) if j >= 0]
                return (i, min(ends) + 1) if ends and min(ends) - end <= D.NOTE_REACH else (start, end)
            depth -= 1
    return start, end


def test_enclosing_note(spark):
    texts = ["(a (b) c [d] WORD e) f", "x WORD", "(WORD", "((a) WORD) b]", ") ( WORD ]", "(" + "y" * 299 + "WORD" + "z" * 300 + ")", "(" + "y" * 300 + "WORD)", "(y WORD" + "z" * 301 + ")"]
    rows = [(t, t.index("WORD"), t.index("WORD") + 4) for t in texts]
    got = spark.createDataFrame(rows, "t string, s int, e int").select("t", "s", "e", D.enclosing_note(F.col("t"), F.col("s"), F.col("e")).alias("x")).collect()
    assert all((r.x.start, r.x.end) == plain_note(r.t, r.s, r.e) for r in got)


def test_base_dates(spark):
    t = "Approved by the Governor, March 3, 2020; enacted February 30, 2021. signed on  may 5, 2022"
    x = spark.range(1).select(D.base_dates(F.lit(t)).alias("x")).first().x
    assert [(r.event, str(r.date), t[r.start : r.end]) for r in x] == [("approved", "2020-03-03", "Approved by the Governor, March 3, 2020"), ("signed", "2022-05-05", "signed on  may 5, 2022")]


def test_references_against_all_pairs(spark):
    refs = [["5", "a"], ["5"], ["a"], ["5", "a", "1"], ["code", "5", "a"], ["b", "5", "a", "b"]]
    both = spark.createDataFrame([(d, r) for d in (1, 2) for r in refs], "doc long, tokens array<string>")

    def run(x, y):
        return any(y[i : i + len(x)] == x for i in range(len(y)))

    def shown(df, b):
        return sorted((r.doc, r.ref, r[b]) for r in df.collect())

    pairs = [(d, x, y) for d in (1, 2) for x in refs for y in refs]
    assert shown(R.matching(both, both), "citation") == sorted(p for p in pairs if run(p[1], p[2]))
    assert shown(R.ancestors(both, both), "citation") == sorted((d, x, y) for d, x, y in pairs if any(y[-k:] == x[:k] for k in range(1, len(x)) if len(y) >= k))
    assert shown(R.same(both, both), "other") == sorted((d, x, y) for d, x, y in pairs if x == y or (n := min(len(x), len(y))) >= 2 and x[-n:] == y[-n:])


def test_repair_key_changes_with_the_targets(spark):
    keys = [X.repair_key(F.lit("p"), F.array(*map(F.lit, r)), F.array(*map(F.lit, m)), responses.SETTINGS) for r, m in ((["a", "b"], ["x"]), (["b", "a"], ["x"]), (["a"], ["x"]), (["a", "b"], ["y"]))]
    got = spark.range(1).select(*keys).first()
    assert got[0] == got[1] and len(set(got)) == 3


def test_a_second_request_is_made_only_where_something_is_open(spark, sf):
    run = X.extract(*responses.single(spark, sf), responses.SETTINGS, "2026-10-01")
    requests = {r.doc: r.requests for r in run.documents.collect()}
    targets = {r.doc for r in run.targets.select("doc").distinct().collect()}
    mapped = {d for d in requests if d % responses.KINDS == 23}
    assert all((requests[d] == 2) == (d in targets or d in mapped and requests[d] == 2) and requests[d] <= 2 for d in requests)
    origins = {r.doc for r in run.candidates.where("origin = 'repair'").collect()}
    assert origins <= {d for d in requests if requests[d] == 2}


def test_extraction_of_empty_tables(spark, sf):
    docs, requests, stored = responses.single(spark, sf)
    run = X.extract(docs.where("false"), requests.where("false"), stored, responses.SETTINGS, "2026-10-01")
    assert run.documents.collect() == [] and run.candidates.collect() == [] and run.targets.collect() == []


def test_integrity_stops_the_run(spark, sf):
    found = projections.c15(spark, sf).groupBy(F.col("doc_id").alias("doc"), "index").agg(F.collect_list("violation").alias("violations"))
    with pytest.raises(I.IntegrityViolation) as e:
        I.enforce(found)
    assert sum(e.value.counts.values()) == found.count() and set(e.value.counts) == set(I.INVARIANTS)
    assert spark.read.parquet(e.value.path).count() == found.count()
    assert spark.read.parquet(I.enforce(found.where("false"))).count() == 0


def test_figures_fold_compatibility_characters(spark):
    rows = spark.createDataFrame([("５ days and ２０％ of ＄３００",), ("5 days",), (None,)], "t string")
    got = [sorted(r.x) if r.x is not None else None for r in rows.select(T.figures(F.col("t")).alias("x")).collect()]
    assert got == [["day:5", "money:300", "percent:20"], ["day:5"], None]


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    """A batch that dies before it is published is processed again, one that was published isn't; a stop holds for later batches."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    seen = []

    def work(fail):
        def process(batch):
            seen.append(sorted(r.seq for r in batch.select("seq").collect()))
            if fail:
                raise RuntimeError("the driver dies")
            return batch.select("seq", F.when(F.col("seq") % 5 == 0, F.lit("odd")).alias("error"), (F.col("seq") == 13).alias("stops"), (F.col("seq") * 2).alias("twice"))

        return process

    def go(low, high, fail=False):
        spark.range(low, high).select(F.col("id").alias("seq")).coalesce(1).write.mode("append").parquet(source)
        run_stage(spark.readStream.schema("seq long").parquet(source), work(fail), out, checkpoint)

    go(0, 10)
    with pytest.raises(Exception, match="the driver dies"):
        go(10, 20, fail=True)
    run_stage(spark.readStream.schema("seq long").parquet(source), work(False), out, checkpoint)
    go(20, 25)
    got = {r.seq: (r.state, r.twice) for r in results(spark, out).collect()}
    expected = {s: ("not_run", None) if s > 13 else ("error" if s % 5 == 0 else "done", 2 * s) for s in range(25)}
    assert got == expected and results(spark, out).count() == 25
    assert seen.count(list(range(10))) == 1 and seen.count(list(range(10, 20))) == 2


STREETS = (
    ("123 North First Street Apt 4", "123", None, "N", "1ST", "ST", None, "APT 4"),
    ("45-47 St. James Ave.", "45", "47", None, "SAINT JAMES", "AVE", None, None),
    ("9 Broadway", "9", None, None, "BROADWAY", None, None, None),
    ("14.5 Mt Vernon Rd W", "14.5", None, None, "MOUNT VERNON", "RD", "W", None),
    ("200 South 05th St #12", "200", None, "S", "5TH", "ST", None, "#12"),
    ("Avenue", None, None, None, "AVENUE", None, None, None),
    ("77A Fort Hill Square", "77A", None, None, "FORT HILL", "SQ", None, None),
)


def test_streets(spark):
    rows = spark.createDataFrame([(s[0],) for s in STREETS], "line string").select("line", P.parse_street(F.col("line")).alias("s")).collect()
    assert [(r.line, r.s.low, r.s.high, r.s.predir, " ".join(r.s.name), r.s.suffix, r.s.postdir, r.s.unit) for r in rows] == list(STREETS)


def test_number_phrases(spark):
    phrases = {"one hundred twenty": 120, "fifteen": 15, "two thousand five": 2005, "thirty-one": 31, "ninety nine": 99, "three hundred": 300, "twelve thousand": 12000}
    got = spark.createDataFrame([(p,) for p in phrases], "p string").select("p", T.phrase_value(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == phrases


def test_artifacts_are_never_overwritten(spark, tmp_path):
    def rows(*pairs):
        return spark.createDataFrame([(k, i, f"{k} {i}") for k, i in pairs], "key long, identity string, payload string")

    def said(df):
        return {r.key: r.action for r in df.collect()}

    store = Artifacts(spark, str(tmp_path / "artifacts"))
    assert store.current().collect() == []
    assert said(store.write(rows((1, "a"), (2, "b")))) == {1: "write", 2: "write"}
    assert said(store.write(rows((1, "a"), (2, "c"), (3, "d")))) == {1: "keep", 2: "refuse", 3: "write"}
    assert {r.key: r.payload for r in store.current().collect()} == {1: "1 a", 2: "2 b", 3: "3 d"}
    before = {r.path: r.sha256 for r in file_digests(spark, str(tmp_path / "artifacts")).collect()}
    assert said(store.write(rows((2, "c")), replace=True)) == {2: "version"}
    assert {r.key: r.payload for r in store.current().collect()} == {1: "1 a", 2: "2 c", 3: "3 d"} and store.all().count() == 4
    after = {r.path: r.sha256 for r in file_digests(spark, str(tmp_path / "artifacts")).collect()}
    assert before.items() <= after.items()
