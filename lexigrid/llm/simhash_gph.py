"""SimHash near-duplicates by the generalised pigeonhole principle.

With bits in groups and thresholds t_i whose t_i + 1 add up to k + 1, fingerprints that differ in at most k bits differ in at most t_i
bits of some group i. Correlated bits share a group; dynamic programming on estimated candidate counts allots the thresholds, -1 (skip
the group) included. Fingerprints that meet under a key are verified in full. Keys with more fingerprints than a bound yield no pairs: two fingerprints within
two bits share a neighbour that differs from each by one bit at most, so these fingerprints meet under their neighbours,
of which each has at most 65 fingerprints, all within two bits of each other. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, in_steps, table, written
from .components import connected_components

BITS = 64
#: Fingerprints under one key up to which its pairs are formed.
FEW = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Of all shingles, repeats included, as a signed 64-bit number; a shorter text is one shingle, an empty one gives 0."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = np.array([xxh64_intdigest(b" ".join(tokens), seed)], np.uint64)
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        begins = np.concatenate(([0], ends[:-1])).tolist()
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=False)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp. A null text counts as empty (fp 0). Null ids and repeated rows are kept; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return by_rows(rows, lambda: lambda ids, texts: [ids, [fingerprint(t, words) for t in texts]], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each two bits the rows that have both. What reaches the driver is 64 x 64 numbers, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in in_steps(batches, 1 << 14):
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            i, j = np.indices((BITS, BITS)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total.reshape(-1), n).astype(np.int64))], ["i", "j", "n"])

    both, n = np.zeros((BITS, BITS)), 0
    for i, j, c in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            n = c
        else:
            both[i, j] = c
    return n, both


def groups_of(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size: each begins with the two free bits of the highest correlation and takes the free bit that is most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, -1)
    free, out = list(range(BITS)), []
    for k in range(m, 0, -1):
        size = -(-len(free) // k)
        if size >= len(free) or size < 2:
            group = free[:size]
        else:
            part = near[np.ix_(free, free)]
            i, j = divmod(int(part.argmax()), len(free))
            group = [free[i], free[j]]
            while len(group) < size:
                group.append(max((b for b in free if b not in group), key=lambda b: (near[b, group].sum(), -b)))
        out.append(sorted(group))
        free = [b for b in free if b not in group]
    return out


def within(differ: np.ndarray, t: int) -> float:
    """Chance that two fingerprints differ in at most t of the bits, from the chance for each bit."""
    chances = np.zeros(t + 2)
    chances[0] = 1.0
    for q in differ:
        chances[1:-1] = chances[1:-1] * (1 - q) + chances[:-2] * q
        chances[0] *= 1 - q
    return float(chances[:-1].sum())


def ball(bits: list[int], t: int) -> list[int]:
    """Masks of at most t of the bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in some) for size in range(t + 1) for some in combinations(bits, size)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def allot(n: int, both: np.ndarray, k: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed: the cheapest of 1 to k + 1 groups, by rows to shuffle and estimated candidates."""
    p = np.diag(both) / max(n, 1)
    differ, best = 2 * p * (1 - p), (float("inf"), [])
    for m in range(1, k + 2):
        groups = groups_of(n, both, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            costs = {-1: 0.0}
            for t in range(k + 1):
                rows = n * (1 + (len(ball(group, t)) if t else 0))
                costs[t] = rows + n * n * within(differ[group], t) / 2
            grown: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in table.items():
                for t, more in costs.items():
                    if spent + t + 1 <= k + 1 and cost + more < grown.get(spent + t + 1, (float("inf"),))[0]:
                        grown[spent + t + 1] = (cost + more, [*chosen, t])
            table = grown
        cost, chosen = table[k + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, k: int = 2, few: int = FEW) -> DataFrame:
    """a, b: of the distinct fingerprints in nodes.fp, edges that connect any two within k bits; every edge is within k bits. k is 0, 1 or 2."""
    if k not in (0, 1, 2):
        raise ValueError("the way for large groups holds for up to two bits")
    plan = allot(*bit_counts(nodes), k)
    rows = []
    for i, (group, t) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in group))).cast("long"))
        own = nodes.select(F.lit(i).alias("g"), value.alias("key"), "fp", F.lit(True).alias("own"))
        rows.append(own)
        if t:
            masks = F.array(*(F.lit(x).cast("long") for x in ball(group, t)[1:]))
            probes = nodes.select(value.alias("value"), "fp", F.explode(masks).alias("mask"))
            rows.append(probes.select(F.lit(i).alias("g"), F.col("value").bitwiseXOR(F.col("mask")).alias("key"), "fp", F.lit(False).alias("own")))
    met = rows[0]
    for r in rows[1:]:
        met = met.unionByName(r)
    sizes = met.groupBy("g", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).where("n > 1 and n_own > 0")
    met = written(met.join(sizes, ["g", "key"]))
    cold = met.where(F.col("n") <= few).drop("n", "n_own")
    other = cold.where("own").select("g", "key", F.col("fp").alias("b"))
    pairs = cold.select("g", "key", F.col("fp").alias("a"), "own").join(other, ["g", "key"]).where(((F.col("a") < F.col("b")) | ~F.col("own")) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= k)).select("a", "b")
    hot = met.where(F.col("n") > few).select("fp").distinct()
    # k 2: all numbers within one bit; k 1: the fingerprint without each bit, marked by the bit; k 0: itself
    marks = [(0 if k == 2 else b + 1, signed(1 << b)) for b in range(BITS)] if k else []
    steps = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(x).cast("long").alias("x")) for m, x in [(0, 0), *marks]))
    around = hot.select("fp", F.explode(steps).alias("s"))
    moved = F.col("fp").bitwiseXOR(F.col("s.x")) if k == 2 else F.col("fp").bitwiseAND(F.bitwise_not(F.col("s.x")))
    around = around.select("fp", F.struct(F.col("s.m").alias("m"), moved.alias("x")).alias("near"))
    least = around.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = around.join(least, "near").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, k: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most k bits reach, over all rows.

    Ties: rows of one fingerprint are one node, so repeated rows and copies share a component. A null text or one without
    words has fingerprint 0 and is linked like any other. A null id is never a component_id unless the component has no other.
    An empty table gives no rows. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, words))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(nodes, k))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(best, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
