"""Best-fit-decreasing packing of token ids into fixed rows, with a segment tree over the rows' free room.

Each task packs its own documents in blocks of bounded size: a block is sorted by length, longest first, and each segment
goes to the row with the least room that still holds it. Overlong documents are cut into segments of a row's length and a
rest, so nothing is lost. A row has its id matrix line, cumulative segment lengths and the places where positions restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, in_steps, shared_dir, table
from .tokens import json_encoder, public_file

WIDTH = 2048
#: Ids that a task holds before it packs them.
BLOCK = 4_000_000


class Room:
    """Open rows by free room, in a segment tree over 0..width that counts rows below each node."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        at = self.leaves + free
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least `least`, and that room."""
        at, count = self.leaves + least, self.count
        while not count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        free = at - self.leaves
        row = self.rows[free].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return row, free


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of places in lengths; each length is 1 to width. Equal lengths keep their order."""
    room, rows = Room(width), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = room.take(lengths[k])
        if found is None:
            rows.append([])
            found = len(rows) - 1, width
        rows[found[0]].append(k)
        if found[1] > lengths[k]:
            room.put(found[0], found[1] - lengths[k])
    return rows


KINDS = "sequence_id long, n_tokens int, id_bytes int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, starts array<long>"


def id_kind(largest: int) -> np.dtype:
    """The narrowest of 16 and 32 bits that holds every id up to the largest."""
    if not 0 <= largest < 1 << 32:
        raise ValueError(f"no id of 32 bits: {largest}")
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = 50256, block: int = BLOCK) -> DataFrame:
    """A row for each packed sequence: ids as width little-endian numbers of id_bytes bytes (2 if the vocabulary's largest id and end_id
    are below 65,536, else 4), padded with end_id after n_tokens; cu_seqlens from 0 to n_tokens; resets, where a position count
    restarts; and each segment's document and its first id's place there.

    A document's ids are its whole text's, then end_id. A null text counts as empty. A null id is kept. Repeated rows are
    packed once each. An empty table gives no rows. Very long texts become as many segments as they fill. Segments of one length keep the order
    of the rows. Other columns are not read, whatever their names.
    """

    arrow = arrow_schema(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = json_encoder(vocabulary)
        kind = id_kind(max(encoder.largest, end_id))
        held: list[tuple[int | None, int, np.ndarray]] = []
        size, seen = 0, TaskContext.get().partitionId() << 33

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            rows = best_fit_decreasing([len(x[2]) for x in held], width)
            for at in range(0, len(rows), 256):
                cols: list[list] = [[] for _ in arrow]
                for row in rows[at : at + 256]:
                    line, ends = np.full(width, end_id, kind), [0]
                    for k in row:
                        line[ends[-1] : ends[-1] + len(held[k][2])] = held[k][2]
                        ends.append(ends[-1] + len(held[k][2]))
                    for c, v in zip(cols, (seen, ends[-1], kind.itemsize, line.tobytes(), ends, ends[:-1], [held[k][0] for k in row], [held[k][1] for k in row]), strict=True):
                        c.append(v)
                    seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)
            held.clear()

        for batch in in_steps(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(encoder.ids(text or ""), "<u4"), end_id).astype(kind)
                for at in range(0, len(ids), width):
                    held.append((doc, at, ids[at : at + width]))
                size += len(ids)
                if size >= block:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, KINDS)


def write_matrices(packed: DataFrame, path: str) -> None:
    packed.write.parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KINDS).parquet(path)


def positions(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position ids of a row: each segment counts from 0; padding is 0."""
    out = np.zeros(width, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


def op1_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrices to the shared folder and gives, for each row read back, its segments and checksums."""
    path = shared_dir(spark)
    write_matrices(pack(table(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json")), path)
    return read_matrices(spark, path).select("sequence_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), (F.length("ids") / F.col("id_bytes")).cast("int").alias("width"), "cu_seqlens", "resets", "doc_ids", "starts")
