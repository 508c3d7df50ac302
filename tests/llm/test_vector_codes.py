"""Vector codes against a plain version with whole distances."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import vector_codes as vc


def plain(rows):
    """rows of (vec_id, vector, label), all sound vectors of one length that is a multiple of four -> rows of the query."""
    kept = [(i, [math.floor(1024 * c) for c in v], g) for i, v, g in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 4
    parts = [[r[1][p * d : (p + 1) * d] for r in kept] for p in range(4)]
    books = [x[:256] for x in parts]

    def to(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            hits = [to(x, books[p])[1] for x in parts[p]]
            books[p] = [[sum(c) // len(c) for c in zip(*mine, strict=True)] if (mine := [x for x, h in zip(parts[p], hits, strict=True) if h == k]) else e for k, e in enumerate(books[p])]
    found = [[to(x, books[p]) for x in parts[p]] for p in range(4)]
    total, out = {}, []
    for k, (i, _, g) in enumerate(kept):
        error = sum(found[p][k][0] for p in range(4))
        total[g] = total.get(g, 0) + error
        out.append([i, "".join(f"{found[p][k][1]:02x}" for p in range(4)), error, g])
    h = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, total[g], h) for i, c, e, g in out), key=repr)


def found(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(1, 300), st.sampled_from([2, 50, 1 << 26]), st.integers(0, 9))
def test_partial_distances_find_the_first_nearest(d, n, k, reach, seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-reach, reach, (n, d)), rng.integers(-reach, reach, (k, d))
    entry, error = vc.nearest(x, book)
    every = np.square(x[:, None] - book[None]).sum(axis=2)
    assert entry.tolist() == every.argmin(axis=1).tolist() and error.tolist() == every.min(axis=1).tolist()


def test_is_the_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.1, 8)], int(i) % 3 or None) for i in rng.permutation(400)]
    rows += [(500, None, 1), (501, [0.1] * 7 + [None], 1), (502, [0.1] * 7 + [float("nan")], 1), (503, [0.1] * 7 + [float("inf")], 1), (None, [0.5] * 8, 2), (7, rows[0][1], 2), (7, rows[0][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS code", "2 AS v").repartition(3)
    assert found(vc.compress(df)) == plain(rows)


def test_few_vectors_and_equal_ones(spark):
    rows = [(k, [1.0, -1.0, 0.0, 2.5], None) for k in range(5)]
    got = found(vc.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")))
    assert got == plain(rows) and {r[1] for r in got} == {"00000000"}


def test_lengths(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1), (3, [], 2), (4, [3e38] * 4, 3)], "vec_id long, embedding array<float>, label int")
    got = {r[0]: r[1:4] for r in found(vc.compress(df))}
    assert got[1][0] == "00000000" and got[2] == (None, None, 0) and got[3] == (None, None, None) and got[4][0] == "01010101"
    odd = vc.compress(df.where("vec_id <> 1").withColumn("embedding", vc.F.expr("slice(embedding, 1, 3)"))).collect()
    assert len(odd) == 3 and {r.code for r in odd} == {None}
    none = vc.compress(df.where("vec_id = 3")).collect()
    assert [(r.code, r.error) for r in none] == [("00000000", 0)]


@pytest.mark.parametrize("where", ["false", "embedding IS NULL"])
def test_empty(spark, where):
    assert vc.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int").where(where)).collect() == []
