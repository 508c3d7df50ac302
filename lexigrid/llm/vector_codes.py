"""Product quantization in whole numbers, with partial-distance search.

A vector's parts get the numbers of their nearest codebook entries. The search takes a part's positions in the order of the codebook's variance,
the largest first, and drops an entry as soon as its distance so far is over the distance of the best entry known in full. Sums are exact, so the codes don't
depend on how the rows are dealt. A round sends Spark one row for each entry and task; the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, table, written

#: Fixed values of the contract.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Whole numbers beyond this (a component over 65,536 in size) count as this, so that no sum of squares overflows.
FARTHEST = 1 << 26
#: Vectors that are searched in step.
BLOCK = 512


def whole(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v: the vectors without null or non-finite components, in whole numbers."""
    x = F.col("x").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    near = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), c * SCALE))).cast("int"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("x"))
    return rows.where(F.col("x").isNotNull() & sound).select("vec_id", "label", near.alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of x (of equals the first) and its squared distance, by partial distances."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    order = np.argsort(-book.var(axis=0), kind="stable")
    reach = 1 + max(int(np.abs(x).max()), int(np.abs(book).max()))
    kind = np.int32 if 4 * reach * reach * x.shape[1] < 1 << 31 else np.int64
    x, book = x[:, order].astype(kind), np.ascontiguousarray(book[:, order].astype(kind))
    ahead = max(1, x.shape[1] // 4)
    soon = np.zeros((len(x), len(book)), kind)
    for k in range(ahead):
        soon += np.square(x[:, k, None] - book[None, :, k])
    best = np.square(x - book[soon.argmin(axis=1)]).sum(axis=1, dtype=kind)
    row, entry = np.nonzero(soon <= best[:, None])
    so_far = soon[row, entry]
    for k in range(ahead, x.shape[1]):
        so_far += np.square(x[row, k] - book[entry, k])
        stay = so_far <= best[row]
        row, entry, so_far = row[stay], entry[stay], so_far[stay]
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # each row's best entry has stayed
    least = np.minimum.reduceat(so_far, start)
    hit = np.flatnonzero(so_far == least[row])
    return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], least.astype(np.int64)


def _blocks(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        rows = batch.column(column).slice(at, BLOCK)
        yield at, np.asarray(pc.list_flatten(rows), dtype=np.int64).reshape(len(rows), width)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def _sums(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n and the sums s0, s1, ... of the parts that are assigned to the entry."""
    width = books[0].shape[1]
    schema = "part int, entry int, n long, s array<long>"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, len(books[0]), width), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, 0, PARTS * width):
                for p, part in enumerate(_parts(x)):
                    to, _ = nearest(part, books[p])
                    n[p] += np.bincount(to, minlength=len(books[0]))
                    np.add.at(s[p], to, part)
        part, entry = np.nonzero(n)
        cols = [part, entry, n[part, entry], pa.array(s[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return vectors.select("v").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)))


def fit(vectors: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, from its first entries. vectors: v, all of the entries' length. An entry that no part is assigned to stays."""
    books = [b.copy() for b in _parts(first)]
    for _ in range(rounds):
        moved = _sums(vectors, books).collect()  # a row for each entry at most
        for r in moved:
            books[r["part"]][r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error."""
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for at, x in _blocks(batch, 2, PARTS * books[0].shape[1]):
                for p, part in enumerate(_parts(x)):
                    to, error = nearest(part, books[p])
                    codes[at : at + len(x), p] = to
                    errors[at : at + len(x)] += error
            line = codes.tobytes().hex()
            named = [line[k : k + 2 * PARTS] for k in range(0, len(line), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(errors)], schema=arrow)

    return vectors.select("vec_id", "label", "v").mapInArrow(run, schema)


def books_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each vector without null or non-finite components.

    The vector of the smallest id (null is the largest; of equal ids the smallest vector) says how long vectors are. A vector of another length, and every one if
    that length isn't a multiple of four, has a null code and error. Vectors of length zero have the code 00000000. Repeated rows count as often as they come.
    With fewer than 256 vectors there are as many entries. Equal distances go to the lower entry, so of equal entries only the first is used. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    rows = whole(vectors, id_col, vec_col, label_col)
    smallest = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    head = smallest.first()
    width = len(head["v"]) if head else 0
    fitting = F.lit(width % PARTS == 0) & (F.size("v") == width)
    named = rows.where(~fitting).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    hashed = None
    if head and width % PARTS == 0:
        first = smallest.where(fitting).limit(ENTRIES).collect()
        books = fit(rows.where(fitting).select("v"), np.array([r["v"] for r in first], np.int64).reshape(len(first), width))
        named, hashed = encode(rows.where(fitting), books).unionByName(named), books_hash(books)
    named = written(named)
    sums = named.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return named.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(hashed).cast("string").alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound rows of embeddings."""
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round(k: int) -> str:
    """The nearest entries by the codebook k, and the codebook k + 1, both from whole distances."""
    return f""",
near{k} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT a.vec_id, a.label, a.p, a.x, b.e, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d FROM parts a JOIN book{k} b ON a.p = b.p)
  GROUP BY vec_id, label, p)""" + (
        f""",
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS c FROM near{k}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, best.e, i) GROUP BY p, e) m
  ON b.p = m.p AND b.e = m.e)"""
        if k < ROUNDS
        else ""
    )


#: For tables of one length, a multiple of four, without repeated ids.
OP11_SQL = (
    """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, unnest(range(4)) t(p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < 256)"""
    + "".join(map(_round, range(ROUNDS + 1)))
    + f""",
coded AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label),
hashed AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM hashed) AS codebooks_sha256 FROM coded"""
)
