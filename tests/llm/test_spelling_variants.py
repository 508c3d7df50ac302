"""Spelling variants against a plain version that compares deletions, and the tries against all pairs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import spelling_variants as sv
from lexigrid.llm.queries import queries

from .helpers import ODD, SCHEMA


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_near(n):
    short = defaultdict(set)
    for w in n:
        short[w].add(w)
        for k in range(len(w)):
            short[w[:k] + w[k + 1 :]].add(w)
            short[w[:k] + "*" + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for key, ws in short.items():
        for a in ws:
            for b in ws:
                if a != b and ("*" in key or len(a) != len(b)):
                    near[a].add(b)
    return near


def plain(rows):
    n = plain_words(rows)
    near = plain_near(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abÿé", min_size=1, max_size=6), min_size=1), st.lists(st.text("abÿéz", min_size=1, max_size=7)))
def test_trie_finds_each_pair_once(words, asked):
    words = sorted(words)
    trie = sv.Trie.build(sv.Words.of(words))
    pairs = [p for q, t in trie.near(sv.Words.of(asked)) for p in zip(q.tolist(), t.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if a != b and apart(a, b)}


def test_long_words_and_all_letters():
    words = sorted({"a" * 5000, "a" * 4999, "a" * 4999 + "b", *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))})
    trie = sv.Trie.build(sv.Words.of(words))
    assert [trie.words.word(k) for k in range(len(words))] == words
    near = Counter(x for q, _ in trie.near(sv.Words.of(words)) for x in q.tolist())
    assert near[words.index("a" * 5000)] == 2 and near[words.index("ÿ")] == 89


def test_query_is_the_plain_version(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries()["op13_spelling_variants"](spark, sf)) == plain(rows)


def test_many_shards_groups_chains_and_ties(spark, monkeypatch):
    """Words whose forms are words with forms; two neighbours of one count; small shards in small groups."""
    words = {"letterbox": 2, "letterboxe": 20, "letterboxes": 200, "postboxes": 30, "postboxed": 3, "postboxet": 30, "Überfall": 3, "Überfalll": 40, "überfall": 3}
    text = " ".join(" ".join([w] * k) for w, k in words.items())
    rows = [(k, text) for k in (1, 2, 2, 3)]
    monkeypatch.setattr(sv, "HELD_WORDS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = sv.written(sv.counted_words(docs))
    near = {r.word: (r.n_near, r.best_n, r.best) for r in sv.neighbours(counts, each=2, group_bytes=300).collect()}
    n = plain_words(rows)
    expected = plain_near(n)
    assert near == {w: (len(expected[w]), *((n[b], b) if (b := min(expected[w], key=lambda x: (-n[x], x), default=None)) else (None, None))) for w in n}
    assert found(sv.spelling_variants(docs)) == plain(rows)


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, empty):
    rows = [] if empty else ODD
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "3 AS root")
    assert found(sv.spelling_variants(docs)) == plain([(r[0], r[1]) for r in rows])


def test_roots_of_a_long_chain(spark):
    chain = [f"w{k}" for k in range(12)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    assert {tuple(r) for r in sv.roots(forms, 2 * 10**11).collect()} == {(w, "w11") for w in chain[:-1]}


def test_codes_are_latin_1():
    assert np.array_equal(sv._BYTE[sv._CODE[97:123]], np.arange(97, 123)) and sv.Words.of(["aÿ"]).codes.tolist() == [0, 89]
