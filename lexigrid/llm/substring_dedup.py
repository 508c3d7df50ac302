"""Repeated passages by Rabin-Karp hashes of every window of a fixed count of words.

1. A task hashes all windows of its documents (two rolling hashes, modulo 2**64 with different bases), in blocks of bounded size. Of the
   windows of a block that share a hash only the first goes on; the others are known to repeat and become local answers. The rest is dealt by
   the second hash to buckets, a Spark partition each, whose number follows the bytes of text, packed as the first hash and eight more bits of the second.
2. In each bucket the hashes are counted: a window whose hash is also held by a smaller document repeats. The answer has one bit a window.
3. The answers meet the documents, which hash their windows again; repeated windows merge into maximal intervals of words, which are removed.

Within its bucket a window is known by 72 bits, with the bucket's number by 72 + log2(buckets): among 1e13 windows in 1e6 buckets one in a hundred such runs is expected
to take two different windows as equal. Words are hashed with two independent 64-bit hashes, so that two words don't meet either.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, in_steps, rounds_of, table

WINDOW = 20
#: Windows that a task holds before it deals them out.
BLOCK = 2_000_000
#: Bytes of text for each bucket: about 2.5 million windows, 25 MB as they are sent.
BUCKET = 16 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_LIMIT = 1 << 14
_NULL_ID = -(1 << 63)


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(_LIMIT, base, np.uint64), np.full(_LIMIT, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_POWERS = [_powers(b) for b in _BASES]


def rolling(words: np.ndarray, window: int, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each window: sum of word * base ** -place in the window, modulo 2**64, from sums of prefixes. others: the words' hashes for the second one."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    out = []
    for (up, down), words in zip(_POWERS, (words, words if others is None else others), strict=True):
        parts = []
        for at in range(0, n, _LIMIT - window):
            part = words[at : at + _LIMIT - 1]
            count = min(_LIMIT - window, n - at)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * down[: len(part)], dtype=np.uint64)))
            parts.append((sums[window : window + count] - sums[:count]) * up[:count])
        out.append(np.concatenate(parts))
    return out[0], out[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def both_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each word's 128-bit XXH3."""
    from xxhash import xxh3_128_digest

    halves = np.frombuffer(b"".join(map(xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def hashed(text: str | None, window: int, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, and of each window its hash, eight more bits and the bucket."""
    words = (text or "").encode().split()
    first, second = both_hashes(words) if len(words) >= window else (np.empty(0, np.uint64),) * 2
    a, b = rolling(first, window, second)
    return words, a, (b >> np.uint64(24)).astype(np.uint8), ((b >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def ranked(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of (h, more), equal ones in the order in which they came; and which of them begin a run of equal ones."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (more[order][1:] != more[order][:-1])).any():  # one hash with different bits: rare
        order = np.lexsort((np.arange(len(h)), more, h))
        same = (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])
    return order, np.concatenate(([True], ~same))


DEALT = "bucket int, local boolean, block long, docs binary, marks binary, sizes binary, data binary, more binary"
PACKED = "part int, bucket int, docs binary, marks binary, blocks binary, sizes binary, data binary"
ANSWER = "k long, th long, answers array<struct<bucket: int, bits: binary>>"


def _deal(window: int, buckets: int, block: int):
    """Rows for the buckets: documents (id, mark of the text, count of hashes) and 8 + 1 bytes a hash, in the documents' order; and local answers."""
    arrow = arrow_schema(DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:2])
            keys, marks = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
            counts = np.array([len(x[2]) for x in held])
            h, more, bucket = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
            doc = np.repeat(np.arange(len(held), dtype=np.int32), counts)
            held.clear()
            # blocks of the same rows send the same windows; copies of a row in other blocks send other ones
            name = int.from_bytes(hashlib.blake2b(keys.tobytes() + marks.tobytes(), digest_size=8).digest(), "little", signed=True)
            # equal rows are one document: the copy's windows start no earlier
            same = np.concatenate(([False], (keys[1:] == keys[:-1]) & (marks[1:] == marks[:-1])))
            first = np.zeros(len(h), bool)
            order, begins = ranked(h, more)
            first[order[begins]] = True
            del order, begins
            edges = np.concatenate(([0], np.cumsum(counts)))
            rows = []
            for k in range(len(keys)):
                own = first[edges[k] : edges[k + 1]]
                if not same[k] and not own.all():
                    rows.append((int((keys[k] * 31 + marks[k]) % buckets), True, name, keys[k : k + 1].tobytes(), marks[k : k + 1].tobytes(), b"", np.packbits(~own).tobytes(), b""))
            first[np.repeat(same, counts)] = False
            at = np.flatnonzero(first)
            at = at[np.argsort(bucket[at], kind="stable")]
            borders = np.searchsorted(bucket[at], np.arange(buckets + 1)) if buckets <= 4 * len(at) + 64 else None
            used = range(buckets) if borders is not None else np.unique(bucket[at]).tolist()
            for b in used:
                lo, hi = (borders[b], borders[b + 1]) if borders is not None else np.searchsorted(bucket[at], (b, b + 1))
                if hi > lo:
                    own = at[lo:hi]
                    which, sizes = np.unique(doc[own], return_counts=True)
                    rows.append((b, False, name, keys[which].tobytes(), marks[which].tobytes(), sizes.astype(np.uint32).tobytes(), h[own].astype("<u8").tobytes(), more[own].tobytes()))
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 512], strict=True), arrow, strict=True)], schema=arrow)

        for batch in in_steps(batches):
            for key, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, h, more, bucket = hashed(text, window, buckets)
                if len(h):
                    held.append((key, mark, h, more, bucket))
                    size += len(h)
                    if size >= block:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return run


def _count(parts: int):
    """For each document of a bucket, a bit for each of its hashes: whether a smaller document has it too. The answers of a bucket are
    packed by the part of the documents that they belong to, so that rows don't grow as documents times buckets."""
    arrow = arrow_schema(PACKED)

    def answers(rows: list[tuple]) -> Iterator[tuple[int, int, int, int, bytes]]:
        """Of one bucket."""
        bucket = rows[0][0]
        keys, marks = (np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in (2, 3))
        sizes = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]).astype(np.int64)
        names = np.repeat(np.array([r[6] for r in rows], np.int64), [len(r[2]) // 8 for r in rows])
        h, more = np.frombuffer(b"".join(r[5] for r in rows), "<u8"), np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
        order = np.lexsort((marks, keys))
        new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (marks[order][1:] != marks[order][:-1])))
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.cumsum(new) - 1
        ranks = np.repeat(rank, sizes)
        order, begins = ranked(h, more)
        starts = np.flatnonzero(begins)
        least = np.minimum.reduceat(ranks[order], starts)
        repeats = np.empty(len(h), bool)
        repeats[order] = ranks[order] > np.repeat(least, np.diff(np.append(starts, len(h))))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        for k in np.flatnonzero(np.add.reduceat(repeats, edges[:-1])).tolist():
            yield int(keys[k]), int(marks[k]), int(names[k]), bucket, np.packbits(repeats[edges[k] : edges[k + 1]]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        out: list[tuple[int, int, int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "local", "docs", "marks", "sizes", "data", "block", "more")), strict=True):
                if row[1]:
                    out.append((int(np.frombuffer(row[2], np.int64)[0]), int(np.frombuffer(row[3], np.int64)[0]), row[6], -1, row[5]))
                else:
                    by.setdefault(row[0], []).append(row)
        while by:
            out += answers(by.popitem()[1])
        packed: dict[tuple[int, int], list[tuple[int, int, int, bytes]]] = {}
        for key, mark, name, bucket, bits in out:
            packed.setdefault(((key * 31 + mark) % parts, bucket), []).append((key, mark, name, bits))
        made = [(part, bucket, *(np.array([x[i] for x in xs], np.int64).tobytes() for i in range(3)), np.array([len(x[3]) for x in xs], np.uint32).tobytes(), b"".join(x[3] for x in xs)) for (part, bucket), xs in packed.items()]
        for i in range(0, len(made), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made[i : i + 512], strict=True), arrow, strict=True)], schema=arrow)

    return run


def _gather():
    """One row a document, with its answers from all buckets. Copies of a row in different blocks have answers for different windows, each
    copy's being complete: those of the smallest block are taken."""
    arrow = arrow_schema(ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[int, list[dict]]] = {}
        for group in batches:
            for bucket, docs, marks, blocks, sizes, data in zip(*(group.column(c).to_pylist() for c in ("bucket", "docs", "marks", "blocks", "sizes", "data")), strict=True):
                at = 0
                for key, mark, name, n in zip(*(np.frombuffer(x, np.int64).tolist() for x in (docs, marks, blocks)), np.frombuffer(sizes, np.uint32).tolist(), strict=True):
                    if (key, mark) not in found or name < found[key, mark][0]:
                        found[key, mark] = (name, [])
                    if name == found[key, mark][0]:
                        found[key, mark][1].append({"bucket": bucket, "bits": data[at : at + n]})
                    at += n
        held = list(found.items())
        for i in range(0, len(held), 512):
            some = held[i : i + 512]
            cols = [[k[0] for k, _ in some], [k[1] for k, _ in some], [a for _, (_, a) in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return run


def removed_windows(h_bucket: np.ndarray, answers: list[tuple[int, bytes]] | None) -> np.ndarray:
    """Whether each window repeats, from a document's answers."""
    n = len(h_bucket)
    out = np.zeros(n, bool)
    if not answers or not n:
        return out
    for bucket, bits in answers:
        if bucket < 0:
            out |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    at = np.flatnonzero(~out)
    at = at[np.argsort(h_bucket[at], kind="stable")]
    ranked = h_bucket[at]
    for bucket, bits in answers:
        if bucket >= 0:
            lo, hi = np.searchsorted(ranked, (bucket, bucket + 1))
            out[at[lo:hi]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def intervals(repeats: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words that repeated windows cover."""
    starts = np.flatnonzero(repeats)
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), (starts[np.append(breaks, len(starts) - 1)] + window).tolist(), strict=True))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the intervals of words, each with the white space up to the next word."""
    raw = text.encode()
    begins = [m.start() for m in _WORD.finditer(raw)]
    begins.append(len(raw))
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : begins[start]])
        at = begins[end]
    out.append(raw[at:])
    return b"".join(out).decode()


OUT = "n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK, bucket_bytes: int = BUCKET, keep: bool = True) -> DataFrame:
    """The rows, with n_words, n_removed, spans (maximal intervals of removed words), kept_sha256 (of the kept words joined by a space)
    and, if keep, kept_text: the text without those words.

    A word goes if it lies in a window whose words also start earlier: in a row of smaller id, or before it in the same text. All
    is judged on the input. Rows of one id with different texts are ordered by a hash of the text; repeated rows (same id, same
    text) count as one and get the same result. A null id counts as the smallest. A null text has no words, and its kept_text is null. A very long text is a block of its own.
    Texts shorter than a window stay. An empty table gives no rows. All columns of docs are kept; new ones replace those of the same name.
    """
    taken = ["n_words", "n_removed", "spans", "kept_sha256"] + ["kept_text"] * keep
    carried = [c for c in docs.columns if c not in taken]
    plain = [c for c in carried if c != text_col]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("__text"), F.struct(*plain).alias("__row"))
    # as many as the texts' bytes ask for, which compressed files don't tell, and as the session has partitions
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(rounds_of(size, bucket_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("k", "th", "__text").mapInArrow(_deal(window, buckets, block), DEALT)
    answers = dealt.repartitionById(buckets, "bucket").mapInArrow(_count(buckets), PACKED).repartitionById(buckets, "part").mapInArrow(_gather(), ANSWER)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    met = rows.join(answers.hint("shuffle_hash"), ["k", "th"], "left").select("__text", "answers", *(F.col("__row")[c].alias(c) for c in plain))
    schema = f"{kinds}, {OUT}" + ", kept_text string" * keep
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            cols: list[list] = [[] for _ in taken]
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found:
                    words, _, _, bucket = hashed(text, window, buckets)
                    spans = intervals(removed_windows(bucket, [(a["bucket"], a["bits"]) for a in found]), window)
                else:
                    words, spans = (text or "").encode().split(), []
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                values = [len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(b" ".join(kept)).hexdigest()]
                if keep:
                    values.append(cut(text, spans) if spans else text)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            own = {c: batch.column(2 + i) for i, c in enumerate(plain)} | {text_col: batch.column(0)}
            made = dict(zip(taken, cols, strict=True))
            yield pa.RecordBatch.from_arrays([own[t.name].cast(t.type) if t.name in own else pa.array(made[t.name], t.type) for t in arrow], schema=arrow)

    return met.mapInArrow(run, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = """
WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n
           FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
win AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS g FROM w),
rep AS (SELECT doc_id, i, word, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM win),
cov AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM rep),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cov GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""
