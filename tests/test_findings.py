"""Small cases of faults that larger tables showed."""

import pyarrow as pa

from lexigrid import registry
from lexigrid.functions import text as T


def test_places_are_made_in_bounded_arrays():
    """four bytes a character, and so many bytes of text at a time, not a list of objects for a whole batch."""
    folded, places = T._placed("a \n b ( c ]  [\U0001f600", True)
    assert folded == "a b(c][\U0001f600" and places.dtype == "int32" and places.tolist() == [0, 1, 4, 6, 8, 10, 13, 14]
    parts = [p.to_pylist() for p in T._slices(pa.array(["ab", "c", None, "defgh", "", "i"]), 3)]
    assert parts == [["ab", "c", None], ["defgh"], ["", "i"]]


def test_places_of_sliced_batches(spark, monkeypatch):
    monkeypatch.setattr(T, "FOLDED_BYTES", 4)
    rows = spark.createDataFrame([(i, None if i % 7 == 3 else f"x{i}  ( y") for i in range(50)], "i long, t string").coalesce(1)
    for r in rows.select("i", "t", T.fold_places(rows["t"], True).alias("x")).collect():
        assert (r.x.text, r.x.places) == ((None, None) if r.t is None else (f"x{r.i}(y", [*range(len(f"x{r.i}")), len(f"x{r.i}") + 2, len(f"x{r.i}") + 4]))


def test_two_citations_of_one_statute(spark, tmp_path):
    """each citation's keys are listed."""
    spark.createDataFrame([(140,), (141,), (1,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.s_suppkey: r["keys"] for r in registry.queries()["d43_statute_keys"](spark, str(tmp_path)).collect()}
    assert got == {140: "ca-civ-1950|ca-civ-1950", 141: "ca-civ-1951|ca-civ-1951", 1: "ca-civ-1901|ca-civ-1951"}


def test_near_dedup_links_by_fingerprints(spark, sf):
    """texts whose fingerprints differ in two bits at most are linked, though their five-word shingles are too different; so are those that shingles alone link."""
    import corpus_pipeline
    from lexigrid.llm.simhash_gph import fingerprint

    again = " ".join(f"w{j}" for j in range(5))
    rows = [(1, f"{again} " * 40 + "x1"), (2, f"{again} " * 40 + "y1 y2 y3 y4"), (3, "quite another text than these two")]
    rows += [(4, " ".join(f"a{j}" for j in range(100))), (5, " ".join(f"a{j}" if j != 50 else "b" for j in range(100)))]
    prints = [fingerprint(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[3] ^ prints[4]).bit_count()
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [1, 3, 4]


def test_a_nation_is_dealt_to_many_tasks(spark, tmp_path):
    """rows of one nation aren't one task's."""
    from pyspark.sql import functions as F

    spark.range(2000).select(F.col("id").alias("c_custkey"), F.when(F.col("id") > 0, 3).alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).select(F.col("id").alias("s_suppkey"), F.when(F.col("id") > 0, 3).alias("s_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.queries()["a11_candidate_listing"](spark, str(tmp_path))
    assert found.count() == found.distinct().count() == 1999 * 4
    assert found.select(F.spark_partition_id()).distinct().count() > 10


def test_complement_deals_rows_once(spark):
    """F16: rows that lie by document stay where they are, and nothing is put together from two readings."""
    from lexigrid.operators.ordered import complement

    rows = spark.createDataFrame([(1, 40, 60), (1, 0, 10), (2, 5, 100), (3, 20, 120)], "doc long, s int, e int").repartition(3, "doc")
    found = complement(rows, 100)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 10, 40, 1), (1, 60, 100, 2), (2, 0, 5, 1), (3, 0, 20, 1)]


def test_furniture_reads_each_text_once(spark):
    """F8, F10: runs come from one pass over each text; no line is dealt, sorted or matched again, and a text without a group gives no run."""
    from lexigrid.operators import ordered

    page = lambda k: f"Code of the State\r\nPage {k}\n" + "".join(f"line {'abcdefghij'[i]}{'xyz'[k]}\x0b" for i in range(10))
    docs = spark.createDataFrame([(1, "".join(map(page, range(3)))), (2, "one\ntwo\n" * 5), (3, None), (4, "")], "doc_id long, text string")
    found = ordered.page_furniture(docs)
    plan = found._jdf.queryExecution().toString()
    assert "regexp" not in plan and "Window" not in plan and "text" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 12 * k, 12 * k + 2, 96 * k + k * 10, 96 * k + k * 10 + 26) for k in range(3)]
    assert ordered._runs(3, 2)("one\ntwo\n" * 5) == []
    lines = sorted(map(tuple, ordered.whole_lines(spark.createDataFrame([(7, " a \r\n\x85\u2003b")], "doc_id int, text string")).collect()))
    assert lines == [(7, 0, "a", None, 0, 5), (7, 1, "", "a", 5, 6), (7, 2, "b", "", 6, 8)]


def test_similar_classes_hash_rows_once(spark):
    """classes and their shared grams are tables, so neither hashes nor counts are made again for each side of a join."""
    from lexigrid.operators.joins import similar_classes

    rows = [(1, "x", [1, 2, 3, 4, 5]), (2, "x", [1, 2, 3, 4, 6]), (3, "y", [1, 2, 3, 4, 5]), (4, "x", [5, 4, 3, 2, 1]), (5, "y", [9]), (6, "x", [])]
    found = similar_classes(spark.createDataFrame(rows, "id long, block string, grams array<long>"), 0.6, "block")
    assert "xxhash64" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1.0, 2, 2), (1, 2, 4 / 6, 2, 1)]


def test_kept_tables_are_not_broadcast(spark):
    """a kept table's files are small, its rows needn't be: joins with what comes of it are merged. Words that stand as they are send no text to Python."""
    from pyspark.sql import functions as F
    from lexigrid.operators import extraction as X
    from lexigrid.operators.graph import kept

    docs, rows = kept(spark.createDataFrame([(1, "some words here"), (2, "other  words")], "doc long, text string")), kept(spark.range(3).select(F.col("id").alias("doc"), F.lit("words").alias("q"), F.lit("other words").alias("r")))
    met = rows.join(docs.groupBy("doc").agg(F.max("text").alias("t")).where("t > ''"), "doc", "left")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    found = {x.doc: (tuple(x.at), tuple(x.other)) for x in X._within(rows, docs, at="q", other="r").collect()}
    nowhere = ("failed", None, None)
    assert found == {0: (nowhere, nowhere), 1: (("exact_match", 5, 10), nowhere), 2: (("exact_match", 7, 12), ("normalized_match", 0, 12))}


def test_containers_deal_rows_to_as_many_tasks_as_asked(spark):
    """each step's tasks follow the rows, not the session's number of partitions; the groups stay the same."""
    from lexigrid.operators.references import containers

    inventory = spark.createDataFrame([(d, i, [str(i % 2), str(i)], i < 4) for d in range(3) for i in range(6)], "doc long, provision long, tokens array<string>, in_scope boolean")
    conditions = spark.createDataFrame([(d, c, s, g) for d in range(3) for c, s, g in ((1, 0, [0, 2]), (2, 1, None), (3, 3, [3]), (4, None, [0]))], "doc long, condition long, source long, governed array<long>")
    plain, dealt = containers(inventory, conditions), containers(inventory, conditions, tasks=7)
    assert dealt._jdf.queryExecution().toString().count(", 7)") > 5
    want = [(d, *x) for d in range(3) for x in ((1, 1, 3), (2, 0, 6), (3, 2, 1), (4, None, None))]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect())) == want


def test_a_replay_looks_nothing_up_for_a_second_request(spark, sf, monkeypatch):
    """payloads are parsed once, links of candidates to provisions are found once and by one join, and without a second request no text is read for one."""
    from lexigrid.operators import extraction as X
    from lexigrid.plans import responses

    rows = spark.createDataFrame([(1, None), (2, "{oops"), (3, '{"rules": 7}'), (4, '{"rules": []}'), (5, "[]")], "doc long, payload string")
    parsed = X.parse_responses(rows)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.doc: (r.error, r.r is None) for r in parsed.collect()} == {1: ("no stored response", True), 2: ("not JSON", True), 3: ("no list of rules", True), 4: (None, False), 5: ("no list of rules", True)}
    calls = []
    for name in ("_within", "covers"):
        monkeypatch.setattr(X, name, lambda *a, f=getattr(X, name), name=name, **b: calls.append(name) or f(*a, **b))
    args = (*responses.single(spark, sf), responses.SETTINGS, "2026-10-01")
    X.extract(*args, repair=False)
    assert sorted(calls) == ["_within"] * 3 + ["covers"]


def test_links_are_compared_by_name_only_if_linked(spark):
    """a link counts if its citation names the provision or an ancestor; rows meet once."""
    from lexigrid.operators.references import covers

    targets = spark.createDataFrame([(1, "t1", "p1", "§ 5(a)"), (1, "t2", "p2", "§ 5(b)-(c)"), (1, "t3", None, "§ 5"), (2, "t1", "p1", "§ 5(a)")], "doc long, target string, provision string, ref string")
    candidates = spark.createDataFrame([(1, 0, ["p1", "p1"], "§ 5(a)"), (1, 1, ["p1"], "§ 5"), (1, 2, ["p1", "p2"], "§ 5(c)"), (1, 3, ["p1"], None), (1, 4, None, "§ 5(a)"), (2, 5, ["p1"], "Code § 5(a)(1)"), (2, 6, ["p2"], "§ 5(a)")], "doc long, candidate long, provisions array<string>, citation string")
    found = covers(targets, candidates)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "t1", 0), (1, "t1", 1), (1, "t2", 2), (2, "t1", 5)]


def test_evidence_is_judged_on_what_stands_around_it(spark):
    """the whole text is cut once, and read for base dates only if there is a formula; notes and sentences at the edges of what is cut out count as before."""
    from pyspark.sql import functions as F
    from lexigrid.functions import temporal as TP

    formula, day = "shall take effect on the first day of the seventh month next following enactment", "effective 4-1-2020"
    far = "Enacted June 18, 2021. " + "z" * 5000 + ". "
    texts = [
        (f"{far}It {formula}.{'y' * 5000}", formula, "operative_condition", None),
        (f"{far}Unless it rains, it {formula}.", formula, None, None),
        (f"{far}Unless {'w' * 380} it {formula}.", formula, None, None),
        (f"Unless {'w' * 400} it {formula}. Signed May 2, 2020", formula, None, None),
        (f"{far}(Added 3-1-2020 by Ord. 1234;{'w' * 200} {day}{'w' * 300})", day, "explicit_operative_date", "2020-04-01"),
        (f"{far}(Added 3-1-2020 by Ord. 1234;{'w' * 200} {day}{'w' * 301})", day, "explicit_operative_date", "2020-04-01"),
        (f"{far}(Added 3-1-2020 by Ord. 1234;{'w' * 280} {day})", day, "explicit_operative_date", "2020-04-01"),
        ("nothing of it", "other", "history_note", None),
    ]
    rows = [(i, t, w, k, g, max(t.find(w), 0)) for i, (t, w, k, g) in enumerate(texts)]
    d = spark.createDataFrame(rows, "i long, text string, words string, kind string, given string, s int").withColumn("span", F.when(F.contains("text", "words"), F.col("words")))
    x = TP.effective_evidence(F.col("kind"), F.col("given"), F.col("span"), F.col("text"), F.col("s"), F.col("s") + F.length("words"))
    found = d.select("i", F.explode(F.array(x)).alias("x")).select("i", "x.*")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("substring(text#") == 1
    relative = "relative_date_formula"
    assert sorted(map(tuple, found.collect())) == [
        (0, relative, "2022-01-01", True, None, None), (1, relative, None, True, None, "qualified"), (2, relative, None, True, None, "qualified"), (3, relative, "2020-12-01", True, None, None),
        (4, "history_note", None, False, None, None), (5, "explicit_operative_date", "2020-04-01", True, None, None), (6, "explicit_operative_date", "2020-04-01", True, None, None), (7, "history_note", None, False, "evidence not found", None),
    ]


def test_texts_without_a_record_have_no_base_dates(spark):
    """NULL stays NULL, a text without a record an empty list; letters before the event's first one, case and records that aren't in the calendar count as before."""
    from lexigrid.functions import dates as D

    rows = [(1, None), (2, ""), (3, "disapproved March 3, 2020; ENACTED on march 3, 2020"), (4, "signed February 30, 2020"), (5, "eapproved, Signed: May 2, 2021")]
    d = spark.createDataFrame(rows, "i long, t string")
    assert {r.i: r.x and [(b.event, str(b.date), b.start) for b in r.x] for r in d.select("i", D.base_dates(d["t"]).alias("x")).collect()} == {1: None, 2: [], 3: [("enacted", "2020-03-03", 27)], 4: [], 5: [("signed", "2021-05-02", 11)]}
    assert "THEN filter" in d.select(D.base_dates(d["t"]))._jdf.queryExecution().optimizedPlan().toString()


def test_listed_pairs_take_few_bytes_when_written(spark, tmp_path):
    """F3 of round 4: a nation's suppliers, which are more than a page of a written column holds over and over, come in short rows; none is lost, a NULL key included."""
    import pathlib
    from pyspark.sql import functions as F

    spark.range(900).select(F.col("id").alias("c_custkey"), F.when(F.col("id") > 0, 3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(7001).select(F.expr("nullif(id, 5)").alias("s_suppkey"), F.when(F.col("id") > 0, 3).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    registry.queries()["a11_candidate_listing"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == found.distinct().count() == 899 * 7000
    assert found.where("candidate IS NULL").count() == 899
    assert sum(p.stat().st_size for p in pathlib.Path(f"{tmp_path}/out").rglob("*.parquet")) < 0.4 * 899 * 7000


def test_evidence_is_diagnosed_by_exact_words(spark, tmp_path):
    """F1 of round 4: a text that repeats words holds its quote only once white space is folded: the SQL looks for the words as they are. The operator's own reading folds, unless asked."""
    import duckdb
    from pyspark.sql import functions as F
    from lexigrid.operators.evidence import verify_evidence

    texts = [None, "", "  ", "ab", "äbc defg " * 30, "abcdefghi " * 30, "ab cd " * 40, "a" * 300, "word one two three " * 20, "(x) [y] " * 40, "abcd " * 40, "x\n\ny " * 60, " ".join(f"w{j}" for j in range(60))]
    spark.createDataFrame([(i, texts[i // 5]) for i in range(5 * len(texts))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["d5_evidence_diagnosis"]).fetchall())
    assert len({v for _, v in want}) == 6
    assert sorted(map(tuple, registry.queries()["d5_evidence_diagnosis"](spark, str(tmp_path)).collect())) == want
    rows = spark.createDataFrame([("ab  ab", "ab ab ab")], "q string, t string").withColumn("a", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    read = [tuple(verify_evidence(rows, "q", "t", "a", exact=e).select("verdict", "status", "start", "occurrences").first()) for e in (False, True)]
    assert read == [("verified", "normalized_match", 0, 1), ("joins text across furniture", "failed", None, 0)]


def test_ids_of_a_document_of_over_99_chunks(spark, tmp_path):
    """F2 of round 4: ids are printed as the SQL does; the merged tables' own stay unique."""
    import duckdb
    from lexigrid.operators import extraction as X
    from lexigrid.plans import responses

    rows = [(1, "some words. " * 9500), (2, "few words"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = registry.queries()["h11_merge_chunks"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()['h11_merge_chunks']})").fetchall()
    assert max(r[-1] for r in want) > 99
    assert sorted(map(tuple, found.collect())) == sorted(want)
    _, requests, answers = responses.chunked(spark, str(tmp_path))
    items = X.merge(X.parse_responses(requests.join(answers, "key"))).items
    assert items.count() == items.select("doc", "provision").distinct().count() == sum(r[-1] for r in want)
