"""Packing by powers of two: a document's ids are cut into pieces whose lengths are its length's binary digits.

Every piece is a sequence of its own, so no sequence crosses documents, nothing is padded, and sequences of one length
make one bucket: a folder of its own, from which a reader takes batches of one shape. Nothing is shuffled: a task reads whole
documents and writes their pieces to the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, in_steps, shared_dir, table
from .tokens import ID, json_encoder, public_file

LONGEST = 1024
KINDS = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long, sequence_id long, offset long"


def binary_pieces(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of each piece, longest first: as often as it fits the longest, then the binary digits of the rest."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    out = [(at, longest) for at in range(0, n - n % longest, longest)]
    at = n - n % longest
    for bit in reversed(range(longest.bit_length() - 1)):
        if n >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, bucket (the power of two), ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Each document's ids are its whole text's, then end_id. A null text counts as empty: one piece that holds end_id.
    A null id is kept. Repeated rows are packed once each. An empty table gives no rows. Very long texts give as many pieces of the longest
    length as they fill. Other columns are not read, whatever their names.
    sequence_id is unique: the task's number times 2**33 and a count.
    """
    binary_pieces(0, longest)
    arrow = arrow_schema(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, seen, tail = json_encoder(vocabulary), TaskContext.get().partitionId() << 33, np.array([end_id], ID).tobytes()
        for batch in in_steps(batches):
            cols: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text or "") + tail
                n = len(ids) // 4
                for start, length in binary_pieces(n, longest):
                    for c, v in zip(cols, (doc, start, length, length.bit_length() - 1, ids[4 * start : 4 * (start + length)], n, seen, 0), strict=True):
                        c.append(v)
                    seen += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, KINDS)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader takes batches of one shape."""
    pieces.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_buckets(spark: SparkSession, path: str, bucket: int | None = None) -> DataFrame:
    """All pieces, or those of one power of two. A table without pieces has no folders: no rows."""
    pieces = spark.read.schema(KINDS).parquet(path)
    return pieces if bucket is None else pieces.where(F.col("bucket") == bucket)


def bucketed(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces of docs as they are read back from their buckets in the shared folder."""
    path = shared_dir(docs.sparkSession)
    write_buckets(pack(docs, vocabulary), path)
    return read_buckets(docs.sparkSession, path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(bucketed(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json")))
