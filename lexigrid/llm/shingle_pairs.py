"""Near-duplicates by Jaccard similarity of word shingles: MinHash bands find candidates, whole shingle sets decide.

A pair of similarity s shares one of the BANDS keys of ROWS minima each with a chance of 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, more above.
SimHash with a bit bound can't serve here: at similarity 0.8 fingerprints differ in about ten of 64 bits, so that the bound had to be
16 or so, for which pigeonhole keys are so short that most unrelated texts meet. Pairs under a key are formed up to a bound of texts. Under a larger key
each text is compared with the key's first one, which links a group of copies in as many comparisons as it has texts; only what stays in several components is compared across them, in
blocks of bounded size that are dealt to tasks. Every link is decided by whole shingle sets, whatever the size of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, by_rows, in_steps, written
from .components import connected_components
from .substring_dedup import rolling, word_hashes

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
#: Texts under one key up to which its pairs are formed.
FEW = 64
#: Shingles of a block of texts that are compared with another block in a task.
BLOCK_SHINGLES = 1 << 19
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(tokens), min(words, len(tokens)))[0])


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(len(_TIMES), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1 << 11):
        np.minimum(out, (found[None, at : at + (1 << 11)] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=out)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.uint64).view(np.int64).tolist()


def _signatures(ids: list, texts: list) -> list[list]:
    """Of each text: a key of its whole shingle set, the set's size and the bands' keys."""
    sets, sizes, bands = [], [], []
    for text in texts:
        found = shingles(text)
        mark = np.array([int(np.bitwise_xor.reduce(found * (found >> np.uint64(7) | np.uint64(1)))) if len(found) else 0], np.uint64) + np.uint64(len(found))
        sets += _signed(mark)
        sizes.append(len(found))
        if len(found):
            x = minima(found).reshape(BANDS, ROWS)
            x = ((x ^ (x >> np.uint64(31))) * _MIX).sum(axis=1, dtype=np.uint64)
            bands.append(_signed(x ^ (x >> np.uint64(29))))
        else:
            bands.append([])
    return [ids, sets, sizes, bands]


def _verify(similar: float):
    arrow = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            got = [(a, b) for a, b, x, y in rows if jaccard(shingles(x), shingles(y)) >= similar]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], schema=arrow)

    return run


def block_links(sets: list[np.ndarray], roots: list[int], others: list[np.ndarray], other_roots: list[int], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Places of sets and others that are similar enough and in different components. Shared shingles are counted by postings; a text that
    is linked to a component isn't compared with the rest of it."""
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    every = np.concatenate(others)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    sizes, names = np.array([len(x) for x in others]), np.array(other_roots)
    out = []
    for i, x in enumerate(sets):
        lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(x) else np.empty(0, int)
        shared = np.bincount(owner[at], minlength=len(others))
        hit = np.flatnonzero((names != roots[i]) & (shared > 0) & (shared / np.maximum(1, sizes + len(x) - shared) >= similar))
        _, first = np.unique(names[hit], return_index=True)
        out += [(i, int(j)) for j in hit[first]]
    return out


def _blocks(similar: float):
    arrow = arrow_schema("a long, b long")

    def run(group: pa.Table) -> pa.Table:
        keys, roots, left = (group.column(c).to_pylist() for c in ("set", "root", "left"))
        sets = [np.array(x, np.int64).view(np.uint64) for x in group.column("shingles").to_pylist()]
        i, j = [k for k, x in enumerate(left) if x], [k for k, x in enumerate(left) if not x]
        got = block_links([sets[k] for k in i], [roots[k] for k in i], [sets[k] for k in j], [roots[k] for k in j], similar) if i and j else []
        return pa.Table.from_arrays([pa.array([keys[i[x]] for x, _ in got], pa.int64()), pa.array([keys[j[y]] for _, y in got], pa.int64())], schema=arrow)

    return run


def _across(members: DataFrame, links: DataFrame, texts: DataFrame, similar: float, block: int) -> DataFrame | None:
    """Links between the components of each key's texts, or None if no key has several. members: band, key, set, size.

    In a key all texts but those of its largest component are compared with all texts of the key, a block with a block.
    """
    roots = connected_components(links)
    placed = written(members.join(roots.withColumnRenamed("node", "set"), "set", "left").select("band", "key", "set", "size", F.coalesce("root", "set").alias("root")))
    parts = placed.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("band", "key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("main")).where("parts > 1")
    rows = placed.join(main.select("band", "key", "main"), ["band", "key"])
    rows = written(rows.withColumn("few", F.col("root") != F.col("main")))
    if not rows.limit(1).count():
        return None
    wanted = rows.select("set").distinct()
    sets = by_rows(texts.join(wanted, "set", "left_semi").select("set", "text"), lambda: lambda ids, ts: [ids, [_signed(shingles(t)) for t in ts]], "set long, shingles array<bigint>")
    dealt = rows.groupBy("band", "key").agg(F.ceil(F.sum("size") / block).cast("int").alias("all"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("few"), F.col("size"))) / block)).cast("int").alias("some"))
    rows = rows.join(dealt, ["band", "key"]).join(written(sets), "set")
    mine = rows.where("few").select("band", "key", "set", "root", "shingles", F.lit(True).alias("left"), F.pmod(F.xxhash64("set"), F.col("some")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"))
    theirs = rows.select("band", "key", "set", "root", "shingles", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("some") - 1)).alias("i"), F.pmod(F.xxhash64("set"), F.col("all")).cast("int").alias("j"))
    return mine.unionByName(theirs).groupBy("band", "key", "i", "j").applyInArrow(_blocks(similar), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, few: int = FEW, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links of at least that similarity of five-word shingle sets reach.

    Upper case A-Z counts as lower case. A null text or one without words is like any other such text only. Repeated rows and texts with the same
    shingles share a component. Very long texts are compared in whole. Shingle sets are known by a 64-bit number and their size: two sets that agree in both count as equal. An empty
    table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("id"), "text")
    made = by_rows(keyed, lambda: _signatures, f"id struct<doc_id: {kind}, th: bigint>, set long, size int, bands array<bigint>")
    signed = written(made.select("id.doc_id", "id.th", "set", "size", "bands"))

    nodes = signed.groupBy("set", "size").agg(F.min("th").alias("th"), F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    nodes = written(nodes)
    held = nodes.select("set", "size", F.posexplode("bands").alias("band", "key"))
    groups = held.groupBy("band", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set")).alias("members")).where("n > 1")
    # groups of the same texts are formed once
    groups = groups.groupBy("n", "members").agg(F.min(F.struct("band", "key")).alias("k")).select("n", "k.band", "k.key")
    met = written(held.join(groups, ["band", "key"]))
    cold = met.where(F.col("n") <= few)
    a, b = (cold.select("band", "key", F.col("set").alias(x), F.col("size").alias(f"n{x}")) for x in "ab")
    alike = F.least("na", "nb") >= F.lit(similar) * F.greatest("na", "nb")
    pairs = a.join(b, ["band", "key"]).where((F.col("a") < F.col("b")) & alike).select("a", "b")
    hot = met.where(F.col("n") > few).select("band", "key", "set", "size")
    star = hot.join(hot.groupBy("band", "key").agg(F.min(F.struct("set", "size")).alias("lead")), ["band", "key"])
    close = F.least("size", "lead.size") >= F.lit(similar) * F.greatest("size", "lead.size")
    star = star.where((F.col("set") != F.col("lead.set")) & close).select(F.col("lead.set").alias("a"), F.col("set").alias("b"))
    pairs = written(pairs.unionByName(star).distinct())

    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).unionByName(hot.select("set")).distinct()
    reps = nodes.select("set", "th").join(wanted, "set", "left_semi")
    texts = written(rows.withColumn("th", F.xxhash64("text")).join(reps, "th").select("set", "text").dropDuplicates(["set"]))
    full = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")
    links = written(full.select("a", "b", "x", "y").mapInArrow(_verify(similar), "a long, b long"))
    if hot.limit(1).count() and (more := _across(hot, links, texts, similar, block)) is not None:
        links = links.unionByName(more)
    roots = connected_components(links)
    joined = nodes.select("set", "first").join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", "first", F.coalesce("root", "set").alias("root"))
    best = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(best, "root").select("set", "component_id")
    return signed.join(classes, "set").select("doc_id", "component_id")
