import random

import pytest

import corpus_pipeline
from lexigrid.llm import shingle_pairs

from .helpers import SCHEMA, words


def shingled(text):
    w = words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / max(1, len(a | b))


def firsts(rows):
    """Ids of the smallest row of each component of pairs with similarity 0.8 or more, and the components."""
    sets, root = {d: shingled(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (similarity(sets[a], sets[b]) >= 0.8 or not sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def near_copies():
    rng = random.Random(11)
    rows = []
    for i in range(40):
        base = [f"v{i}x{j}" for j in range(200)]
        rows.append((10 * i, " ".join(base)))
        for c, changed in enumerate((1, 3, 4, 6, 9, 30)):
            copy = base[:]
            for j in rng.sample(range(200), changed):
                copy[j] = f"new{i}c{c}j{j}"
            rows.append((10 * i + 1 + c, " ".join(copy)))
    return rows


@pytest.mark.parametrize("few,block", [(64, 1 << 19), (2, 1 << 19), (2, 500)])
def test_groups_are_those_of_all_pairs(spark, few, block):
    rows = near_copies() + [(1000, None), (1001, " \n"), (1002, "too short"), (1003, "Too SHORT")]
    got = shingle_pairs.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), few=few, block=block).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.doc_id == r.component_id} == firsts(rows)


def test_stage_removes_copies_beyond_two_bits(spark, sf):
    rows = [(d, t, "en", "a", len(t)) for d, t in near_copies()]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert kept == firsts([r[:2] for r in rows]) and len(kept) < 0.6 * len(rows)


def test_blocks_link_components_by_whole_sets():
    rng = random.Random(12)
    base = [f"b{j}" for j in range(100)]
    texts = [" ".join(f"n{i}" if j == rng.randrange(100) else w for j, w in enumerate(base)) for i in range(150)]
    plain, sets = [shingled(t) for t in texts], [shingle_pairs.shingles(t) for t in texts]
    got = shingle_pairs.block_links(sets[:70], list(range(70)), sets[70:], list(range(70, 150)))
    assert sorted(got) == [(i, j - 70) for i in range(70) for j in range(70, 150) if similarity(plain[i], plain[j]) >= 0.8]
    one = shingle_pairs.block_links(sets[:70], [0] * 70, sets[70:], [0] * 80)
    assert one == []


def chain(n):
    """Texts each of which is like the next only, in a key of their own: many components under one key, and long chains."""
    words = [f"c{j}" for j in range(20 * n + 400)]
    return [(k, " ".join(words[20 * k : 20 * k + 400])) for k in range(n)]


def test_a_key_of_unlike_texts(spark, monkeypatch):
    """All texts under the same keys: links must come from comparisons across components."""
    monkeypatch.setattr(shingle_pairs, "minima", lambda found: shingle_pairs.np.zeros(shingle_pairs.BANDS * shingle_pairs.ROWS, shingle_pairs.np.uint64))
    signed = shingle_pairs._signatures
    rows = chain(60) + [(1000 + d, t.replace("c", "d")) for d, t in chain(25)] + [(2000 + k, f"alone {k} " * 30) for k in range(30)]
    held = [r[3] for r in zip(*signed([d for d, _ in rows], [t for _, t in rows]), strict=True)]
    assert all(len(set(b)) == len(set(held[0])) for b in held)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = shingle_pairs.by_rows
    monkeypatch.setattr(shingle_pairs, "by_rows", lambda df, make, schema: made(df, make, schema) if "bands" not in schema else spark.createDataFrame([((r.id.doc_id, r.id.th), *x) for r in df.collect() for x in [[c[0] for c in signed([0], [r.text])[1:]]]], schema))
    got = {r.doc_id: r.component_id for r in shingle_pairs.similar_groups(docs, few=4, block=3000).collect()}
    assert {d for d, c in got.items() if d == c} == firsts(rows)
