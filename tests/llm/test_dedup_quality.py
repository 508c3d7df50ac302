import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import components, license_scan, line_quality, simhash_gph, substring_dedup, tier_compaction
from lexigrid.llm.queries import oracle_sql, queries

from .helpers import ODD, SCHEMA, groups, repeats, sha, simhash, words


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_rolling_hashes_are_the_sums():
    w = np.array([random.Random(5).getrandbits(64) for _ in range(40_000)], np.uint64)
    a, b = substring_dedup.rolling(w, 20)
    for base, got in zip(substring_dedup._BASES, (a, b), strict=True):
        inverse = pow(base, -1, 1 << 64)
        for i in (0, 1, 16_000, 16_383, 16_384, 39_980):
            assert int(got[i]) == sum(int(w[i + j]) * pow(inverse, j, 1 << 64) for j in range(20)) % (1 << 64)
    assert len(substring_dedup.rolling(w[:19], 20)[0]) == 0 and len(a) == 39_981


def test_ranked_with_equal_hashes():
    rng = np.random.default_rng(4)
    for bits in (1, 8):
        h, more = rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 1 << (bits - 1), 400).astype(np.uint8)
        order, begins = substring_dedup.ranked(h, more)
        want = sorted(range(400), key=lambda i: (h[i], more[i], i))
        assert order.tolist() == want
        assert begins.tolist() == [i == 0 or (h[want[i]], more[want[i]]) != (h[want[i - 1]], more[want[i - 1]]) for i in range(400)]


def test_op6_bits_beside_the_hash_decide(spark, monkeypatch):
    """Two windows of one hash and one bucket are different if the other bits are."""
    whole = substring_dedup.hashed
    monkeypatch.setattr(substring_dedup, "hashed", lambda t, w, b: (lambda x: (x[0], x[1] * np.uint64(0), x[2], x[3] * 0))(whole(t, w, b)))
    words_, h, more, bucket = substring_dedup.hashed(" ".join(f"w{i}" for i in range(24)), 20, 4)
    order, begins = substring_dedup.ranked(h, more)
    assert not h.any() and not bucket.any() and begins.sum() == len(set(more.tolist()))


def test_intervals_and_cut():
    marks = np.zeros(30, bool)
    marks[[2, 3, 10, 25]] = True
    assert substring_dedup.intervals(marks, 5) == [(2, 8), (10, 15), (25, 30)]
    assert substring_dedup.cut("a b\nc  d e", [(1, 3)]) == "a d e"
    assert substring_dedup.cut(" é b", [(0, 2)]) == " "


@pytest.mark.parametrize(("block", "bucket"), [(2_000_000, 8 << 20), (300, 2000)])
def test_op6_against_plain(spark, sf, block, bucket):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = documents(spark, sf)[:60] + [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + (f" {passage} tail{i}" if i % 3 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, block=block, bucket_bytes=bucket).collect()}
    for doc, (n, removed, kept) in repeats(rows).items():
        r = got[doc]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, sha(" ".join(kept))), doc
        assert words(r.kept_text) == kept and sum(s.end - s.start for s in r.spans) == removed


def test_op6_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("lang", "n_words")
    got = substring_dedup.remove_repeats(df).collect()
    assert len(got) == len(ODD)
    assert len({(r.n_removed, r.kept_sha256) for r in got if r.doc_id == 7 and r.n_words == 3000}) == 1
    assert next(r for r in got if r.doc_id == 8).n_removed == 100
    assert [r.n_removed for r in got if r.doc_id == 6] == [400] and [r.n_removed for r in got if r.doc_id == 5] == [repeats([(5, "Word " * 400)])[5][1]]
    assert next(r for r in got if r.doc_id == 2).kept_text is None
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_allot_keeps_the_principle():
    rng = np.random.default_rng(7)
    for n in (10, 10**6, 10**9):
        bits = rng.random((2000, 64)) < rng.uniform(0.1, 0.9, 64)
        both = bits.T.astype(float) @ bits * (n / 2000)
        plan = simhash_gph.allot(n, both, 2)
        assert sum(t + 1 for _, t in plan) == 3 and sorted(b for g, _ in plan for b in g) == sorted({b for g, _ in plan for b in g})
    assert simhash_gph.within(np.array([0.5, 0.5]), 1) == 0.75


@pytest.mark.parametrize(("few", "k"), [(64, 2), (2, 2), (2, 1), (64, 1), (2, 0)])
def test_links_lose_no_component(spark, few, k):
    rng = random.Random(8 + few)
    centres = [rng.getrandbits(64) for _ in range(8)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(30)} | {0, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash_gph.links(spark.createDataFrame([(v,) for v in signed], "fp long"), k, few).collect()
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= k for e in edges)
    want = groups({v: v & (1 << 64) - 1 for v in signed}, k)
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame([(e.a, e.b) for e in edges], "a long, b long")).collect()}
    assert {v: roots.get(v, v) for v in signed} == want


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_probing_with_each_threshold(spark, monkeypatch, threshold):
    plans = {0: [([*range(21)], 0), ([*range(21, 42)], 0), ([*range(42, 64)], 0)], 1: [([*range(32)], 1), ([*range(32, 64)], 0)], 2: [([*range(64)], 2)]}
    monkeypatch.setattr(simhash_gph, "allot", lambda n, both, k: plans[threshold])
    test_links_lose_no_component(spark, 5, 2)


def test_op9_query(spark, sf):
    rows = documents(spark, sf)
    prints = {d: simhash(t) for d, t in rows}
    want = groups(prints)
    got = queries()["op9_simhash_gph"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_op9_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = simhash_gph.near_duplicates(df).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 4)} == {1} and {r.fp for r in got if r.doc_id in (1, 2, 4)} == {0}
    assert next(r.component_id for r in got if r.doc_id == 6) == 5
    assert simhash_gph.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chain_hub_and_pairs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(-5, -6), (3, 3), (None, 1)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {-5: -6}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_quality(text):
    w = words(text)
    again = {}
    for i in range(len(w) - 7):
        again.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for places in again.values() if len(places) > 1 for i in places for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_op7_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = line_quality.assess(df).collect()
    assert sorted((str(r.text), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((str(t), *plain_quality(t)) for _, t, *_ in ODD)
    assert all(r.kept_text == r.text for r in got)
    assert line_quality.assess(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"lang": "__th", "n_chars": "kept"})
    out = line_quality.assess(clash.withColumn("__often", clash["source"]))
    assert out.columns[:4] == ["doc_id", "text", "__th", "source"] and out.columns.count("kept") == 1 and out.where("kept").count() == sum(r.kept for r in got)


def test_op7_removes_lines_of_a_host(spark):
    def own(i):
        return " ".join("own" + "".join(chr(97 + int(c)) for c in f"{i}") + chr(97 + j) for j in range(25))

    shared = "Subscribe TO our  list 12 now " + " ".join("more" + chr(97 + j) for j in range(20))
    rows = [(i, f"{own(i)}\n{shared}" if i % 2 else f"{shared.replace('12', '34')}\nx{i}", "hot") for i in range(80)]
    rows += [(100 + i, f"{own(i)}\n{shared}", f"host{i}") for i in range(60)] + [(200 + i, own(999), "hot") for i in range(200)] + [(500, shared, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rejected = {r.doc_id for r in line_quality.assess(df, limit=50).collect() if not r.kept}
    assert rejected >= {200 + i for i in range(200)}  # a text that stands in 200 documents
    got = {r.doc_id: r for r in line_quality.assess(df, limit=50, count="texts").collect()}
    assert all(got[i].kept and got[i].removed_chars > 0 and got[i].kept_text == own(i) for i in range(1, 80, 2))
    assert all(got[i].depleted and not got[i].kept for i in range(0, 80, 2))
    assert all(got[100 + i].removed_chars == 0 for i in range(60)) and all(got[200 + i].kept and got[200 + i].removed_chars == 0 for i in range(200))
    assert got[500].removed_chars == 0


@pytest.mark.parametrize("name", ["op4_chat_events", "op6_substring_dedup", "op7_line_quality", "op8_tier_compaction"])
def test_against_sql(spark, sf, name):
    df = queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cur.fetchall())


def test_op7_sql_with_low_limit(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for count, what in (("documents", "(doc_id, t)"), ("texts", "t")):
        sql = f"WITH {line_quality.VERDICT_SQL.format(docs='documents', limit=1, what=what)} SELECT doc_id, removed_chars, kept_text FROM verdict"
        got = line_quality.assess(spark.read.parquet(f"{sf}/documents.parquet"), limit=1, count=count)
        assert sorted((r.doc_id, r.removed_chars, r.kept_text) for r in got.collect()) == sorted(con.execute(sql).fetchall())
    with pytest.raises(ValueError):
        line_quality.assess(got, count="rows")


def test_store(spark, tmp_path):
    store = tier_compaction.Store(spark, str(tmp_path / "s"), "k long, t string", target=200_000, least=1000, fanout=4)
    assert store.read().count() == 0 and store.compact() == 0
    for i in range(9):
        store.append(spark.range(i * 100, i * 100 + 100).selectExpr("id AS k", "repeat(cast(id AS string), 20) AS t", "1 AS other").coalesce(1))
    old, n = store.versions()[-1], len(store.shards())
    store.compact()
    assert len(store.shards()) < n and store.read().count() == 900 and store.read(old).count() == 900
    with pytest.raises(tier_compaction.Conflict):
        store.commit(old, [])
    store.append(spark.createDataFrame([(None, None), (None, None)], "k long, t string"))
    assert store.read().count() == 902 and store.read(old).count() == 900
    assert store.vacuum() > 0 and store.read().count() == 902
    with pytest.raises(ValueError):
        store.read(old)


def test_vacuum_leaves_what_is_not_committed_yet(spark, tmp_path):
    """Another writer's shards lie there before their commit."""
    store = tier_compaction.Store(spark, str(tmp_path / "s"), "k long", target=1 << 20, least=1000, fanout=2)
    store.append(spark.range(10).selectExpr("id AS k").coalesce(1))
    late = store._write(spark.range(10, 30).selectExpr("id AS k").coalesce(1))
    store.append(spark.range(30, 40).selectExpr("id AS k").coalesce(1))
    store.compact()
    assert store.vacuum() == 2  # the two that were merged
    store._change(set(), late)
    assert sorted(r.k for r in store.read().collect()) == list(range(40))
    lost = store._write(spark.range(5).selectExpr("id AS k").coalesce(1))
    assert store.vacuum() == 0 and store.vacuum(grace_s=-10) == len(lost)
    assert store.read().count() == 40


def test_arrivals_are_versions(spark, tmp_path):
    store = tier_compaction.Store(spark, str(tmp_path / "s"), "k long, t string")
    rows = spark.createDataFrame([(i, t, "x") for i in range(9) for t in ("", None, "é" * 100_000)], "k long, t string, __arrival string")
    seen = [(v, store.read(v).count()) for v in store.arrivals(rows, F.col("k") % 3)]
    assert seen == [(1, 9), (2, 18), (3, 27)]
    assert sorted((r.k, r.t or "") for r in store.read().collect()) == sorted((r.k, r.t or "") for r in rows.collect()) and store.read().columns == ["k", "t"]
    assert list(store.arrivals(rows.limit(0), F.col("k"))) == []


def calibration_error(p, hit, bins=10):
    """Mean distance between confidence and accuracy over bins of confidence."""
    at = np.minimum((p * bins).astype(int), bins - 1)
    return sum(abs(p[at == k].mean() - hit[at == k].mean()) * (at == k).mean() for k in range(bins) if (at == k).any())


def test_license_model_on_unseen_sentences_and_families():
    model, other = license_scan.trained(), license_scan.unseen()
    last = len(model.families) - 1
    z = other.logits
    temperature = 2.0 / model.intercept[-1]
    p = other.probabilities(temperature)
    best = np.where(p.max(axis=1) >= model.threshold, p.argmax(axis=1), last)
    known, strange = other.right != last, (other.right == last) & (other.family != last)
    passing = best != last
    report = {model.families[f]: round(float((best == f)[known & (other.family == f)].mean()), 2) for f in range(last)}
    report["passed as another family"] = round(float((passing & (best != other.right)).mean()), 3)
    report["unknown sentences passed"] = round(float(passing[(other.family == last)].mean()), 3)
    report["unseen families passed"] = round(float(passing[strange].mean()), 3)
    report["calibration error"] = round(float(calibration_error(p.max(axis=1), p.argmax(axis=1) == other.right)), 3)
    print(report)
    assert len(z) == len(best) and report["passed as another family"] <= 0.06 and report["unknown sentences passed"] <= 0.01 and report["unseen families passed"] <= 0.12
    assert report["calibration error"] <= 0.12 and all(report[f] >= 0.6 for f in model.families[:-1])
    assert all(license_scan.telling(g) for g in model.grams)
    rows = license_scan.examples()
    assert np.mean([model.scores(r.text).argmax() == r.family for r in rows]) > 0.98  # the model in use has seen these


def test_wrapped_notices_are_one_paragraph(spark):
    """At 80 columns no line of a notice need hold enough; a line that ends a sentence, or a blank one, ends a paragraph."""
    import textwrap

    model = license_scan.trained()
    notice = " ".join(license_scan.TEMPLATES["MIT"][:1])
    rows = [(i, "Prose before.\n" + "\n".join(textwrap.wrap(notice, width)) + "\n \nProse after the blank line") for i, width in enumerate((20, 40, 80))]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.place, r.family, r.confirmed) for r in got) == [(i, 1, "MIT", True) for i in range(3)]
    assert all(license_scan.tokens(r.paragraph) == license_scan.tokens(notice) for r in got) and model.threshold >= 0.5


def paragraphs(text):
    import regex

    return regex.split(license_scan.BREAK, text or "")


def test_op3_query(spark, sf):
    """Against the model and the templates, paragraph by paragraph."""
    model, want = license_scan.trained(), {}
    sets = {f: [set(license_scan.grams(license_scan.tokens(t))) for t in ts] for f, ts in license_scan.TEMPLATES.items()}
    for doc, text in documents(spark, sf):
        for n, part in enumerate(paragraphs(text)):
            s = model.scores(part)
            if s.argmax() != len(model.families) - 1 and s.max() >= model.threshold:
                family, own = model.families[s.argmax()], set(license_scan.grams(license_scan.tokens(part)))
                alike = max(len(own & t) / max(1, min(len(own), len(t))) for t in sets[family])
                want[doc, n] = (family, round(float(s.max()), 5), round(alike, 5), alike >= license_scan.CONFIRMED)
    got = {(r.doc_id, r.place): (r.family, round(r.probability, 5), round(r.similarity, 5), r.confirmed) for r in queries()["op3_license_scan"](spark, sf).collect()}
    assert got.keys() == want.keys() and want
    assert all(g[0] == w[0] and g[3] == w[3] and abs(g[1] - w[1]) < 1e-4 and abs(g[2] - w[2]) < 1e-4 for g, w in ((got[k], want[k]) for k in want))


def test_scan_is_the_model(spark):
    texts = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.UNKNOWN + ["", "Prose of no kind.", "Distributed under the terms of the MIT License; see the file."]
    rows = [(i, f"Some words first.\n{t}\nlast line") for i, t in enumerate(texts)] + [(None, texts[4]), (0, f"Some words first.\n{texts[0]}\nlast line"), (77, None)]
    model = license_scan.trained()
    rows += [(78, ("Licensed under the MIT license and many more words " * 5000)), (79, "Licensed under CC BY 4.0.\n" * 3), (79, "other text")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, gram string, place string")
    got = {(r.doc_id, r.place): r for r in license_scan.scan(df).collect()}
    want = {}
    for doc, text in rows:
        for n, line in enumerate(paragraphs(text)):
            s = model.scores(line)
            if s.argmax() != len(model.families) - 1 and s.max() >= model.threshold:
                want[doc, n] = (model.families[s.argmax()], s.max())
    assert set(got) == set(want) and all(got[k].family == f and abs(got[k].probability - p) < 1e-5 for k, (f, p) in want.items())
    assert sum(r.confirmed for r in got.values()) >= 0.9 * len(got)
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
