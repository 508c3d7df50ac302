"""Spelling variants: words at a distance of one, found by running each word's Levenshtein automaton over broadcast tries.

The distinct words are sorted into shards, each a compact trie: a branch with a single word left is cut short to that word. Shards are
broadcast in groups of bounded size; every word's automaton runs through each shard depth-first, a block of words in step. What a task emits is
already reduced to a number of neighbours and the best form.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, shared_dir, table, written

#: Fixed values of the contract.
RUN, LEAST_LENGTH, NOISE, RATIO = "[A-Za-zÀ-ÿ]", 7, 31, 10

#: Distinct words of a task before they are handed to Spark's aggregation.
HELD_WORDS = 200_000
#: Words of a shard, bytes of the shards that are broadcast together, and words whose automata run in step.
SHARD_WORDS, GROUP_BYTES, BLOCK = 1 << 17, 32 << 20, 4096
#: Words of a task that runs automata.
TASK_WORDS = 1 << 15

_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Latin-1 bytes a-z as 0 to 25, from C0 on as 26 to 89.
_CODE = np.zeros(256, np.uint8)
_CODE[97:123], _CODE[0xC0:] = np.arange(26), np.arange(26, 90)
_BYTE = np.zeros(90, np.uint8)
_BYTE[_CODE[97:123]], _BYTE[_CODE[0xC0:]] = np.arange(97, 123), np.arange(0xC0, 0x100)


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """word, n: the words of whole texts that occur at least so often. A task hands on bounded counts, Spark adds them up."""
    schema = "word string, n long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, crc = re.compile(RUN + f"{{{LEAST_LENGTH},}}").findall, {}, zlib.crc32

        def flush() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            held.clear()
            for at in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 10_000], pa.string()), pa.array(counts[at : at + 10_000], pa.int64())], schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                doc, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if not text:
                    continue
                head = crc(f"{'' if doc is None else doc}:".encode())
                for word in find(text):
                    if not word.islower():
                        word = word.translate(_LOWER)
                    h = crc(word.encode(), head)
                    if h % NOISE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    held[word] = held.get(word, 0) + 1
                if len(held) >= HELD_WORDS:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


@dataclass
class Words:
    """Words as codes in a row, with where each begins."""

    codes: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        ends = np.cumsum([0, *map(len, words)])
        return cls(_CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)], ends)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def word(self, k: int) -> str:
        return _BYTE[self.codes[self.at[k] : self.at[k + 1]]].tobytes().decode("latin-1")


def _same_tails(a: Words, x: np.ndarray, i: np.ndarray, b: Words, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the words x (from i on) and y (from j on) have the same rest."""
    left = a.at[x + 1] - a.at[x] - i
    out = np.zeros(len(x), bool)
    live = np.flatnonzero(left == b.at[y + 1] - b.at[y] - j)
    p, q, left = (a.at[x] + i)[live], (b.at[y] + j)[live], left[live]
    k = 0
    while live.size:
        done = left == k
        if done.any():
            out[live[done]] = True
            more = ~done
            live, p, q, left = live[more], p[more], q[more], left[more]
        same = a.codes[p + k] == b.codes[q + k]
        if not same.all():
            live, p, q, left = live[same], p[same], q[same], left[same]
        k += 1
    return out


def _shared(a: Words, x: np.ndarray, b: Words, y: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix of the words x and y, of which so many code points are known."""
    out = np.full(len(x), depth, np.int64)
    least = np.minimum(a.at[x + 1] - a.at[x], b.at[y + 1] - b.at[y])
    live = np.flatnonzero(least > depth)
    while live.size:
        live = live[a.codes[a.at[x[live]] + out[live]] == b.codes[b.at[y[live]] + out[live]]]
        out[live] += 1
        live = live[least[live] > out[live]]
    return out


@dataclass
class Trie:
    """Sorted words as a trie. An inner node has a bit for each letter that goes on, its first edge, and the word that ends there or -1; an edge
    leads to an inner node, or (negative) to the only word below it, whose rest isn't stored again."""

    words: Words
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    edges: np.ndarray
    letters: np.ndarray

    @classmethod
    def build(cls, words: Words) -> Trie:
        """A level at a time. words: sorted, distinct, one at least."""
        sizes = words.sizes
        low, high, first, ends, edges, letters = [], [], [], [], [], []
        node, index = np.zeros(len(sizes), np.int64), np.arange(len(sizes))  # the words below this level's inner nodes
        n_nodes, n_edges, depth = 1, 0, 0
        while n_nodes:
            end = np.full(n_nodes, -1, np.int32)
            stop = sizes[index] == depth
            end[node[stop]] = index[stop]
            node, index = node[~stop], index[~stop]
            code = words.codes[words.at[index] + depth]
            new = np.ones(len(index), bool)
            new[1:] = (node[1:] != node[:-1]) | (code[1:] != code[:-1])
            start = np.flatnonzero(new)
            single = np.diff(start, append=len(index)) == 1
            owner, letter = node[start], code[start]
            bit = np.uint64(1) << (letter & 63).astype(np.uint64)
            lo, hi = np.zeros(n_nodes, np.uint64), np.zeros(n_nodes, np.uint64)
            np.bitwise_or.at(lo, owner[letter < 64], bit[letter < 64])
            np.bitwise_or.at(hi, owner[letter >= 64], bit[letter >= 64])
            low.append(lo), high.append(hi), ends.append(end), letters.append(letter)
            first.append(n_edges + np.searchsorted(owner, np.arange(n_nodes)))
            base = sum(map(len, low))
            edges.append(np.where(single, ~index[start], base + np.cumsum(~single) - 1))
            n_edges += len(start)
            below = np.repeat(~single, np.diff(start, append=len(index)))
            node, index = (np.cumsum(~single) - 1)[np.cumsum(new) - 1][below], index[below]
            n_nodes, depth = int((~single).sum()), depth + 1
        join = np.concatenate
        return cls(words, join(low), join(high), join(first).astype(np.int32), join(ends), join(edges).astype(np.int32), join(letters))

    def along(self, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes go on by the letter, and those nodes' edges."""
        upper = code >= 64
        bits = np.where(upper, self.high[node], self.low[node])
        bit = np.uint64(1) << (code & 63).astype(np.uint64)
        goes = np.flatnonzero(bits & bit)
        node, upper = node[goes], upper[goes]
        rank = np.bitwise_count(bits[goes] & (bit[goes] - np.uint64(1))) + np.where(upper, np.bitwise_count(self.low[node]), 0)
        return goes, self.edges[self.first[node] + rank]

    def _exact(self, words: Words, q: np.ndarray, i: np.ndarray, edge: np.ndarray, longer: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """With the one error made: the rest must be equal. longer: by how much the trie's word is then the longer one."""
        sizes = words.sizes
        while q.size:
            tail = edge < 0
            if tail.any():
                x, y, at = q[tail], ~edge[tail], i[tail]
                found = _same_tails(words, x, at, self.words, y, at + longer)
                yield x[found], y[found]
                q, i, edge = q[~tail], i[~tail], edge[~tail]
            done = i == sizes[q]
            if done.any():
                x, y = q[done], self.ends[edge[done]]
                yield x[y >= 0], y[y >= 0]
                q, i, edge = q[~done], i[~done], edge[~done]
            goes, edge = self.along(edge, words.codes[words.at[q] + i])
            q, i = q[goes], i[goes] + 1

    def near(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs (which of the words, which of the trie's) at a distance of exactly one, each pair once.

        The automaton's states without an error follow the word itself; at each node they branch into the states with one error, which
        are followed to their end before the next letter. Of equal letters in a row the last is deleted, and a letter is inserted behind its equals.
        """
        sizes = words.sizes
        q, edge, depth = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), 0
        while q.size:
            tail = edge < 0
            if tail.any():
                yield self._rest(words, q[tail], ~edge[tail], depth)
                q, edge = q[~tail], edge[~tail]
            more = sizes[q] > depth
            own = np.full(len(q), 255, np.uint8)
            own[more] = words.codes[words.at[q[more]] + depth]
            following = np.full(len(q), 255, np.uint8)
            last = sizes[q] > depth + 1
            following[last] = words.codes[words.at[q[last]] + depth + 1]
            drop = more & (own != following)
            yield from self._exact(words, q[drop], np.full(int(drop.sum()), depth + 1), edge[drop], -1)
            n = (np.bitwise_count(self.low[edge]) + np.bitwise_count(self.high[edge])).astype(np.int64)
            each = np.repeat(np.arange(len(q)), n)
            place = self.first[edge][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            to, same = self.edges[place], self.letters[place] == own[each]
            other = ~same
            x, to_other = each[other], to[other]
            yield from self._exact(words, q[x], np.full(len(x), depth), to_other, 1)
            swap = more[x]
            yield from self._exact(words, q[x[swap]], np.full(int(swap.sum()), depth + 1), to_other[swap], 0)
            q, edge, depth = q[each[same]], to[same], depth + 1

    def _rest(self, words: Words, q: np.ndarray, t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words that have met the only word of a branch without an error: those at a distance of one."""
        longer = self.words.sizes[t] - words.sizes[q]
        close = np.abs(longer) <= 1
        q, t, longer = q[close], t[close], longer[close]
        at = _shared(words, q, self.words, t, depth)
        differ = (at < words.sizes[q]) | (longer > 0)
        q, t, longer, at = q[differ], t[differ], longer[differ], at[differ]
        found = _same_tails(words, q, at + (longer <= 0), self.words, t, at + (longer >= 0))
        return q[found], t[found]


PARTS = "shard long, n_words int, n_bytes long, codes binary, at binary, low binary, high binary, first binary, ends binary, edges binary, letters binary, counts binary"
_KINDS = {"codes": np.uint8, "at": np.int64, "low": np.uint64, "high": np.uint64, "first": np.int32, "ends": np.int32, "edges": np.int32, "letters": np.uint8, "counts": np.int64}


def shards(words: DataFrame, n_words: int, each: int = SHARD_WORDS) -> DataFrame:
    """Tries of the words, in the words' order by shard."""
    arrow = arrow_schema(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, counts = TaskContext.get().partitionId() << 33, [], []

        def made() -> pa.RecordBatch:
            t = Trie.build(Words.of(held))
            arrays = [t.words.codes, t.words.at, t.low, t.high, t.first, t.ends, t.edges, t.letters, np.array(counts, np.int64)]
            parts = [a.astype(k).tobytes() for a, k in zip(arrays, _KINDS.values(), strict=True)]
            cols = [shard, len(held), sum(map(len, parts)), *parts]
            return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            while names:
                room = each - len(held)
                held += names[:room]
                counts += n[:room]
                names, n = names[room:], n[room:]
                if len(held) == each:
                    yield made()
                    shard, held, counts = shard + 1, [], []
        if held:
            yield made()

    return words.select("word", "n").repartitionByRange(-(-n_words // each), "word").sortWithinPartitions("word").mapInArrow(run, PARTS)


def _loaded(parts: dict[str, bytes]) -> tuple[Trie, np.ndarray]:
    a = {k: np.frombuffer(parts[k], kind) for k, kind in _KINDS.items()}
    return Trie(Words(a["codes"], a["at"]), *(a[k] for k in ("low", "high", "first", "ends", "edges", "letters"))), a["counts"]


FOUND = "word string, n long, n_near long, best_n long, best string"


def _found(words: DataFrame, group) -> DataFrame:
    """word, n, n_near, best_n, best over the group's shards, for words that have a neighbour there."""
    arrow = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [_loaded(parts) for parts in group.value]
        for batch in batches:
            for from_ in range(0, batch.num_rows, BLOCK):
                names, n = batch.column(0).slice(from_, BLOCK), batch.column(1).slice(from_, BLOCK)
                asked = Words.of(names.to_pylist())
                near, best_n, best = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.full(len(names), None, object)
                for trie, counts in tries:
                    pairs = [p for p in trie.near(asked) if p[0].size]
                    if not pairs:
                        continue
                    q, t = (np.concatenate(x) for x in zip(*pairs, strict=True))
                    near += np.bincount(q, minlength=len(names))
                    order = np.lexsort((t, -counts[t], q))
                    q, t = q[order], t[order]
                    top = np.append(True, q[1:] != q[:-1])
                    q, t = q[top], t[top]
                    better = counts[t] > best_n[q]  # a later shard's words are larger, so an equal count doesn't win
                    for k, w in zip(q[better], t[better], strict=True):
                        best[k] = trie.words.word(w)
                    best_n[q[better]] = counts[t[better]]
                hit = np.flatnonzero(near)
                cols = [names.take(pa.array(hit)), n.take(pa.array(hit)), pa.array(near[hit]), pa.array(best_n[hit]), pa.array(best[hit].tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return words.select("word", "n").mapInArrow(run, FOUND)


def neighbours(words: DataFrame, each: int = SHARD_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """n_near, best_n and best for each of the words (word, n; distinct): how many are at a distance of one, and of them the one with the largest n, of equal n the smallest.

    Tries are broadcast in groups of at most group_bytes, or of one shard; a group's results are written before the next is loaded, so neither the
    driver nor an executor holds more than a group.
    """
    spark = words.sparkSession
    n_words = words.count()
    parts = [words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))]
    if n_words:
        tries = written(shards(words, n_words, each))
        groups: list[list[int]] = []
        size = 0
        for shard, n_bytes in sorted(map(tuple, tries.select("shard", "n_bytes").collect())):
            if not groups or size + n_bytes > group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(shard)
            size += n_bytes
        for ids in groups:
            rows = tries.where(F.col("shard").between(ids[0], ids[-1])).collect()
            group = spark.sparkContext.broadcast([{k: bytes(r[k]) for k in _KINDS} for r in sorted(rows, key=lambda r: r["shard"])])
            del rows
            parts.append(written(_found(words.repartition(-(-n_words // TASK_WORDS)), group)))
            group.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root for the pairs (word, form): forms followed to the last. A form's n is at least ten times its word's, so a chain of words that occur at
    most so often has at most log10(most / 2) links; each round doubles what is followed."""
    links = max(1, int(math.log10(max(most, 2) / 2)) + 1)
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links)) if links > 1 else 0):
        hop = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = written(found.join(hop, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return found


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of whole texts, misspelled as the contract says.

    A null or empty text has no words; a null id counts as an empty one; repeated rows count as often as they come; a word may be of any length; an empty
    table gives no rows; other columns are not read, whatever their names. Of neighbours with the same n the smallest in code-point order is the form.
    """
    words = written(counted_words(docs, id_col, text_col))
    path = shared_dir(docs.sparkSession)
    near = neighbours(words).withColumn("close", F.col("best_n") >= RATIO * F.col("n"))
    near = written(near.select("word", F.when(F.col("close"), F.col("best")).alias("form"), "n", "n_near", F.when(F.col("close"), F.col("best_n")).alias("form_n")), path)
    most = near.agg(F.max("n")).first()[0] or 0
    last = roots(near.where("form IS NOT NULL").select("word", "form"), most)
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))
