"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel compares words by their subsequences of three and four letters, gaps allowed and the less worth the wider they are, so inserted letters and letters set apart
change it little. Landmarks are words; the machine is trained on sentences of labelled documents. A label says that some sentence of a document is toxic, not which:
a toxic document stands for the words of those sentences that are clearly toxic so far, or for its worst one, clean documents for all of theirs.
A trained machine is linear in the subsequences of its landmarks, so it is folded into one table of weights, and scoring costs a lookup for each subsequence.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, in_steps, table, written

#: Letters of a subsequence lie within so many letters of a word; a skipped letter costs this factor.
SPAN, DECAY = 6, 0.6
#: Bounds of training: labelled documents of each class, words of either kind that a fit takes, landmarks of either kind, rounds.
MOST_DOCUMENTS, MOST_WORDS, LANDMARKS, FIT_ROUNDS = 4000, 20_000, 128, 3
#: Where the probabilities' weights are drawn to, and how strongly.
PRIOR, PRIOR_COST = (-3.0, 5.0, 2.0, 0.0, 0.0), 0.2
#: One document in four of the sample sets the probabilities and isn't fitted.
CALIBRATION = 4
#: Words whose margins a process keeps.
KEPT_WORDS = 500_000
#: Margins count from here to there; most words of any text are below, and then needn't be known exactly.
FLOOR, CEILING = -0.5, 3.0

_LETTERS = re.compile(r"[^\W\d_]+").findall
_BROKEN = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:(?:[^\w\s]|[\d_])++[^\W\d_]++)+").findall
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:\s[^\W\d_]){2,}(?!\w)").findall
_SENTENCE = re.compile(r"[.!?]+(?=\s)|\n")
#: Where the other letters of a subsequence stand, counted from its first.
_GAPS = [p for n in (2, 3) for p in itertools.combinations(range(1, SPAN), n)]
#: Three letters are a number of 18 bits; four are hashed into 20 bits after those.
_THREE, _FOUR = 1 << 18, 1 << 20
_SIZE = _THREE + _FOUR


@functools.lru_cache(KEPT_WORDS // 5)
def _parts(token: str) -> frozenset[str]:
    return frozenset(_LETTERS(token)).union("".join(_LETTERS(w)) for w in _BROKEN(token))


def words_of(text: str) -> set[str]:
    """Lower-case runs of letters; what is left of a run between blanks without its other characters; single letters set apart as one word."""
    text = text.lower()
    tokens = set(text.split())
    found = {t for t in tokens if t.isalpha()}
    found = found.union(*map(_parts, tokens - found))
    found.update("".join(w.split()) for w in _SPACED(text))
    return found


def _letter_codes(text: str) -> np.ndarray:
    """1 to 26 for a-z, 27 to 63 for others; 0 is a word's edge."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 37).astype(np.int32)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length at a time: which of the words, their subsequences' numbers, and how many letters each of those skips (alike for all)."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        block = max(1, (1 << 20) // (int(size) + 2) // len(_GAPS))
        for lo in range(0, len(at), block):
            part = at[lo : lo + block]
            codes = np.zeros((len(part), size + 2), np.int32)
            codes[:, 1:-1] = _letter_codes("".join(words[k] for k in part)).reshape(len(part), size)
            pieces, skips = [], []
            for gaps in _GAPS:
                n = size + 2 - gaps[-1]
                if n > 0:
                    number = codes[:, :n]
                    for g in gaps:
                        number = (number << 6) | codes[:, g : g + n]
                    pieces.append(number if len(gaps) == 2 else _THREE + ((number.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int32))
                    skips.append(np.full(n, gaps[-1] - len(gaps), np.int32))
            if pieces:
                yield part, np.concatenate(pieces, axis=1), np.concatenate(skips)


_WORTH = DECAY ** np.arange(SPAN, dtype=np.float32)


def _runs(numbers: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of equal numbers of a row begins among the sorted entries, the sorted numbers, and the runs' sums of worths."""
    entries = np.sort((numbers << 3) | skips, axis=1)
    ids = entries >> 3
    new = np.ones(ids.shape, bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
    start = np.flatnonzero(new)
    return start, ids.ravel(), np.add.reduceat(_WORTH[entries.ravel() & 7], start)


def merged(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Equal subsequences of a word added up: which words, then for each entry its word's place among them, its number and its value; a word's
    values have the length one."""
    for part, numbers, skips in subsequences(words):
        start, ids, total = _runs(numbers, skips)
        row = start // numbers.shape[1]
        norm = np.sqrt(np.bincount(row, weights=total * total, minlength=len(part)))
        yield part, row, ids[start], total / norm[row]


@dataclass
class Model:
    """weights: of each subsequence; bias; link: of 1, the worst margin, the second worst, log(1 + words above zero), log(1 + words). A model without weights knows only how frequent toxicity is."""

    weights: np.ndarray | None
    bias: float
    link: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """Merging equal subsequences only makes a word's length larger, so that a word whose sum is small enough for the unmerged length is at the floor."""
        out = np.full(len(words), max(FLOOR, self.bias))
        for part, numbers, skips in subsequences(words):
            worth = _WORTH[skips]
            raw = self.weights[numbers] @ worth
            out[part] = FLOOR
            sure = np.flatnonzero(self.bias + np.maximum(raw, 0) / np.sqrt(worth @ worth) > FLOOR)
            if sure.size:
                start, _, total = _runs(numbers[sure], skips)
                norm = np.sqrt(np.bincount(start // numbers.shape[1], weights=total * total, minlength=len(sure)))
                out[part[sure]] = self.bias + raw[sure] / norm
        return np.clip(out, FLOOR, CEILING)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.link, -40, 40)))


class Margins:
    """Margins of words, kept for the next texts: which words are known, and the margins above the floor."""

    def __init__(self, model: Model):
        self.model, self.known, self.above, self.none = model, set(), {}, float(np.clip(model.bias, FLOOR, CEILING))

    def learn(self, *texts: set[str]) -> None:
        """So that the words of all these texts are known."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.above = set(), {}
        new = list(set().union(*texts) - self.known)
        if new:
            found = self.model.margins(new)
            self.known.update(new)
            self.above.update((new[k], float(found[k])) for k in np.flatnonzero(found > FLOOR))

    def of(self, word: str) -> float:
        return self.above.get(word, FLOOR)

    def features(self, words: set[str]) -> tuple[list[float], str | None]:
        found = sorted(((self.above[w], w) for w in self.above.keys() & words), key=lambda x: (-x[0], x[1]))
        values = [m for m, _ in found[:2]] + [FLOOR] * (min(2, len(words)) - len(found[:2])) + [self.none] * (2 - min(2, len(words)))
        return [1.0, *values, float(np.log1p(sum(m > 0 for m, _ in found))), float(np.log1p(len(words)))], found[0][1] if found else None


_KEPT: dict[bytes, Margins] = {}


def margins_of(model: Model) -> Margins:
    """The margins that this process has kept of the model; those of other models are dropped."""
    key = hashlib.sha256(model.weights.tobytes() + repr((model.bias, model.link.tolist())).encode()).digest()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Margins(model)
    return _KEPT[key]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    columns, base = landmark_columns(landmarks)
    return _kernel(words, columns, base)


def landmark_columns(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences that landmarks have, and a row of values for each landmark."""
    entries = [(part[row], ids, values) for part, row, ids, values in merged(landmarks)]
    columns = np.unique(np.concatenate([ids for _, ids, _ in entries]))
    base = np.zeros((len(landmarks), len(columns)), np.float32)
    for who, ids, values in entries:
        base[who, np.searchsorted(columns, ids)] = values
    return columns, base


def _nystroem(marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The landmarks' columns and rows, and the inverse root of their kernel matrix, without directions that carry nothing."""
    columns, base = landmark_columns(marks)
    values, vectors = np.linalg.eigh((base @ base.T).astype(float))
    sound = values > 1e-6 * values[-1]
    return columns, base, vectors[:, sound] / np.sqrt(values[sound])


def _kernel(words: list[str], columns: np.ndarray, base: np.ndarray) -> np.ndarray:
    out, rows = np.zeros((len(words), len(base))), np.ascontiguousarray(base.T)
    for at in range(0, len(words), 500):
        for part, row, ids, values in merged(words[at : at + 500]):
            place = np.searchsorted(columns, ids).clip(max=len(columns) - 1)
            hit = np.flatnonzero(columns[place] == ids)
            if hit.size:
                start = np.flatnonzero(np.append(True, row[hit][1:] != row[hit][:-1]))
                out[at + part[row[hit[start]]]] = np.add.reduceat(rows[place[hit]] * values[hit, None], start, axis=0)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A linear support vector machine with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(50):
        part = x[active] * cost[active, None]
        w = np.linalg.solve(keep + part.T @ x[active], part.T @ y[active])
        new = y * (x @ w) < 1
        if (new == active).all():
            break
        active = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (cost * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + PRIOR_COST * np.eye(len(w)), x.T @ (cost * (y - p)) - PRIOR_COST * (w - prior))
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _apart(words: list[str], n: int, most: float = 0.7) -> list[str]:
    """Words in order without those that are more alike to one taken before."""
    found = [(part[row], ids, values) for part, row, ids, values in merged(words)]
    row, ids, values = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    order = np.argsort(row, kind="stable")
    row, ids, values = row[order], ids[order], values[order]
    taken, near, own = [], np.zeros(len(words)), np.zeros(_SIZE)
    while len(taken) < n and (near <= most).any():
        k = int(np.argmax(near <= most))
        taken.append(words[k])
        mine = slice(*np.searchsorted(row, (k, k + 1)))
        own[ids[mine]] = values[mine]
        near = np.maximum(near, np.bincount(row, weights=values * own[ids], minlength=len(words)))
        own[ids[mine]] = 0
        near[k] = 1.0
    return taken


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic, fits: at most MOST_DOCUMENTS of each class, those with the smallest hashes of doc_id; and how many labels each class has in all.
    Only ids whose crc32 isn't divisible by five; ids with both labels are left out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = written(known)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for c in (0, 1):
        some = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCUMENTS)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = F.broadcast(chosen.withColumn("fits", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATION)) != 0))  # 2 x MOST_DOCUMENTS rows of two numbers
    return written(docs.where("text IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id").repartition(64, "doc_id")), counts


def _counted(sample: DataFrame) -> DataFrame:
    """word, a, b: toxic and clean documents that have the word, of those that fit."""
    schema = "word string, toxic int"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = list(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic] * len(words), pa.int32())], schema=arrow)

    return sample.where("fits").select("text", "toxic").mapInArrow(run, schema).groupBy("word").agg(F.sum("toxic").cast("long").alias("a"), F.sum(1 - F.col("toxic")).cast("long").alias("b"))


def _witnesses(sample: DataFrame, scores) -> DataFrame:
    """word, n: the words of toxic documents' sentences that are clearly above zero, or the worst word of a document without any. scores: broadcast; a call with sentences gives the function from a word to its score."""
    schema = "word string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            texts = [[w for w in map(words_of, _SENTENCE.split(t)) if w] for t in batch.column(0).to_pylist()]
            score, out = scores.value([s for t in texts for s in t]), []
            for sentences in texts:
                scored = [(score(w), w) for s in sentences for w in s]
                out += sorted({w for m, w in scored if m > scores.value.clear}) or ([max(scored)[1]] if scored else [])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], schema=arrow)

    return sample.where("fits AND toxic = 1").select("text").mapInArrow(run, schema).groupBy("word").agg(F.count("*").alias("n"))


@dataclass
class _ByTable:
    """Scores of a first guess: a number for each word that toxic documents have more often."""

    known: dict[str, float]
    clear = 0.0

    def __call__(self, texts: list[set[str]]):
        return lambda word: self.known.get(word, -10.0)


@dataclass
class _ByModel:
    model: Model
    clear = 0.5

    def __call__(self, texts: list[set[str]]):
        margins = margins_of(self.model)
        margins.learn(*texts)
        return margins.of


FEATURES = "doc_id long, toxic int, features array<double>, worst string"


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxic (null if the rows have none), features, worst: for rows with doc_id, toxic, text."""
    arrow, shared = arrow_schema(FEATURES), rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = margins_of(shared.value)
        for batch in in_steps(batches):
            words = [words_of(t) if t else set() for t in batch.column(2).to_pylist()]
            margins.learn(*words)
            found = [margins.features(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([w for _, w in found], pa.string())], schema=arrow)

    return rows.mapInArrow(run, FEATURES)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From a bounded sample of labelled documents (MOST_DOCUMENTS). With one class or none among them, the model is the smoothed frequency of label 1."""
    spark = docs.sparkSession
    sample, counts = labelled(docs, labels)
    n_bad, n_good = counts.get(1, 0), counts.get(0, 0)
    plain = Model(None, 0.0, np.array([np.log((n_bad + 1) / (n_good + 1)), 0, 0, 0, 0]))
    stats = written(_counted(sample))
    fitted = {r["toxic"]: r["count"] for r in sample.where("fits").groupBy("toxic").count().collect()}
    if len(fitted) < 2:
        return plain
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (fitted[1] + 1)) - F.log(b / (fitted[0] + 1))
    guessed = stats.withColumn("sure", odds - 2 * F.sqrt(1 / a + 1 / b) - float(np.log(4)))  # in all likelihood four times as frequent in toxic documents, if above zero
    likely = [(r["word"], r["sure"]) for r in guessed.where("a > b").orderBy(F.desc("sure"), "word").limit(MOST_WORDS).collect()]
    usual = [(r["word"], r["b"]) for r in stats.where("b > 0").orderBy(F.xxhash64("word"), "word").limit(MOST_WORDS).collect()]
    if not likely or not usual:
        return plain
    marks = _apart([w for w, _ in likely[:1000]], LANDMARKS)
    marks += _apart([w for w, _ in usual[:1000] if w not in set(marks)], LANDMARKS)
    columns, base, root = _nystroem(marks)
    scores, hard, model = _ByTable(dict(likely)), {}, plain
    for _ in range(FIT_ROUNDS):
        seen = spark.sparkContext.broadcast(scores)
        bad = [(r["word"], r["n"]) for r in _witnesses(sample, seen).orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()]
        shown = dict(stats.where("b > 0").join(F.broadcast(spark.createDataFrame(bad or [("", 0)], "word string, n long").select("word")), "word").select("word", "b").collect())
        good = dict(usual) | hard | shown
        names = [w for w, _ in bad] + sorted(good)
        y = np.array([1.0] * len(bad) + [-1.0] * len(good))
        cost = np.sqrt(np.array([n for _, n in bad] + [good[w] for w in sorted(good)], float))
        cost *= np.where(y > 0, 1 / max(1e-9, cost[y > 0].sum()), 1 / max(1e-9, cost[y < 0].sum())) * len(y) / 2
        w = _machine(_kernel(names, columns, base) @ root, y, cost)
        weights = np.zeros(_SIZE, np.float32)
        weights[columns] = (root @ w[:-1]) @ base
        model = Model(weights, float(w[-1]), plain.link)
        scores = _ByModel(model)
        worst = _scored(stats.where("b > 0"), model).orderBy(F.desc("margin"), "word").limit(MOST_WORDS // 4).collect()
        hard |= {r["word"]: r["b"] for r in worst}
    rows = _features(sample.where("NOT fits").select("doc_id", "toxic", "text"), model).select("toxic", "features", "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["features"]))
    y = np.array([r["toxic"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(model.weights, model.bias, np.array(PRIOR))
    frequency = np.where(y == 1, n_bad / y.sum(), n_good / (len(y) - y.sum()))
    link = _logistic(np.array([r["features"] for r in rows]), y, frequency / frequency.mean())
    return Model(model.weights, model.bias, link)


def _scored(stats: DataFrame, model: Model) -> DataFrame:
    schema = "word string, b long, margin double"
    arrow, shared = arrow_schema(schema), stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.margins(batch.column(0).to_pylist()))], schema=arrow)

    return stats.select("word", "b").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, worst (the worst word) for each row of docs.

    A null or empty text has no words and gets the score of none; a null id is never learned from and isn't held out; repeated rows get equal scores; a text may be of any
    length; an empty table gives no rows; other columns are not read, whatever their names. Labels other than 0 and 1, of null ids, or both for one id, aren't learned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(rows, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    if model.weights is None:
        score = float(model.probability(np.eye(5)[:1])[0])
        found = rows.select("doc_id", F.lit(score).alias("score"), F.lit(None).cast("string").alias("worst"))
    else:
        x, link = F.col("features"), model.link.tolist()
        sums = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), sum((F.lit(c) * x[k] for k, c in enumerate(link)), F.lit(0.0))))
        found = _features(rows.select("doc_id", F.lit(None).cast("int").alias("toxic"), "text"), model).select("doc_id", (1 / (1 + F.exp(-sums))).alias("score"), "worst")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from labels.toxic."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
