"""Toxicity: the kernel against a plain version, training on planted insults, accuracy on documents that aren't learned from."""

import itertools
import math
import zlib

import numpy as np
import pytest

from lexigrid.llm import toxicity as tx
from lexigrid.llm.queries import queries

from .helpers import ODD, SCHEMA


def plain_kernel(a, b):
    def features(w):
        codes, out = [0, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 for c in w), 0], {}
        for places in (p for n in (3, 4) for p in itertools.combinations(range(len(codes)), n)):
            if places[-1] - places[0] < tx.SPAN:
                key = tuple(codes[i] for i in places)
                out[key] = out.get(key, 0) + tx.DECAY ** (places[-1] - places[0] - len(places) + 1)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_is_the_plain_one():
    words = ["idiot", "idioot", "ixdxiot", "a", "ab", "aaaaaaa", "überall", "日本語", "trash"]
    got = tx.kernel(words, words)
    for (i, a), (j, b) in itertools.product(enumerate(words), repeat=2):
        assert got[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-5)
    assert got[0, 1] > 0.6 and got[0, 2] > 0.2 and got[0, 8] < 0.05


def test_words():
    assert tx.words_of("You I-D.I*O_T, i d i o t x1y ok 12 Été") == {"you", "i", "d", "o", "t", "idiot", "x", "y", "xy", "ok", "été", "idiotx"} - {"idiotx"} | tx.words_of("i d i o t x1y")
    assert "idiot" in tx.words_of("an i d i o t!") and tx.words_of("") == set()


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = np.sign(x[:, 0] + 0.3)
    w = tx._machine(x, y, np.ones(400))
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def auc(pairs):
    pairs = sorted(pairs)
    good, total, bad = 0, 0.0, 0
    for _, same in itertools.groupby(pairs, key=lambda p: p[0]):
        same = [y for _, y in same]
        total += sum(same) * (good + (len(same) - sum(same)) / 2)
        good, bad = good + len(same) - sum(same), bad + sum(same)
    return total / (good * bad)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries()["op12_toxicity"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert set(rows) == {d.doc_id for d in docs}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    # other languages' labels have nothing to go by on these tables, and few documents are labelled
    english = {d.doc_id for d in docs if d.lang == "en"}
    assert auc([(rows[d].score, labels[d]) for d in labels if d in rows and d in english and rows[d].held_out]) > 0.85


def test_labels_of_held_out_rows_change_nothing(spark):
    clean = "the weather was fine on monday and we walked home"
    insults = ["worthless", "idiot", "clown", "pathetic"]
    rows = [(k, f"{clean if k % 3 else clean.replace('fine', insults[k // 3 % 4])} number{k % 7}. We left early.") for k in range(120)]
    odd = [(1000, "what an i d i o t"), (1001, "the id-iot came"), (1002, "wortthless"), (1003, "we walked home"), (1004, ""), (1005, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS features", "3 AS score")
    out = {}
    for flip in (False, True):
        labels = [(k, int(k % 3 == 0) if zlib.crc32(str(k).encode()) % 5 or not flip else int(k % 3 != 0)) for k in range(120)]
        df = spark.createDataFrame([*labels, (None, 1), (1003, 7)], "doc_id long, toxic int").selectExpr("*", "'x' AS text")
        out[flip] = {r.doc_id: (round(r.score, 9), r.predicted) for r in tx.toxicity(docs, df).collect()}
    assert out[False] == out[True]
    got = out[False]
    assert all(got[k][1] == int(k % 3 == 0) for k in range(120))
    assert [got[k][1] for k in range(1000, 1006)] == [1, 1, 1, 0, 0, 0]


@pytest.mark.parametrize("n_rows", [0, len(ODD)])
@pytest.mark.parametrize("labels", [[], [(1, 0), (3, 0)], [(1, 1), (3, 0), (3, 1), (4, 0), (5, None)]])
def test_odd_rows(spark, n_rows, labels):
    docs = spark.createDataFrame(ODD[:n_rows], SCHEMA)
    got = tx.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == n_rows and all(0 <= r.score <= 1 for r in got) and all(not r.held_out for r in got if r.doc_id is None)
