"""Ogg: pages with checksums, packets by lacing values, logical streams by serial number, times by granule positions.

The writer stores a payload of 8-bit samples as two logical streams, its first and second half, whose pages alternate.
The reader takes any file of Ogg pages: it checks each page's CRC, version and sequence number, puts packets together
over page borders, and keeps streams apart.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, shared_dir, table

RATE = 8000
PACKET = 2048
MAGIC = b"PCM8"
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, most significant bit first, from 0: zlib's on bytes and result turned around."""
    turned = zlib.crc32(data.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(turned.to_bytes(4, "little").translate(_TURNED), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", ogg_crc(head + body)) + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one stream from (packet, granule position at its end), each with the granule position at which it begins."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, begin, flags = bytearray(), bytearray(), -1, 0, FIRST

    def close(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, begin, flags
        out.append((begin, page(serial, len(out), flags | LAST * last, granule, bytes(lacing), bytes(body))))
        begin = max(begin, granule)
        lacing, body, granule, flags = bytearray(), bytearray(), -1, CONTINUED * goes_on

    for k, (packet, at) in enumerate(packets):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        used = 0
        for i, size in enumerate(sizes):
            if len(lacing) == 255:
                close(False, i > 0)
            lacing.append(size)
            body += packet[used : used + size]
            used += size
        granule = at
        if k in (0, len(packets) - 1):  # a stream's first packet has a page of its own
            close(k == len(packets) - 1, False)
    return out


def write_ogg(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The payload as two streams of unsigned 8-bit samples, pages in the order of their times, first pages first."""
    half, streams = len(payload) // 2, []
    for serial, samples in enumerate((payload[:half], payload[half:]), 1):
        head = MAGIC + struct.pack("<BIQ", serial, rate, len(samples))
        packets = [(head, 0)] + [(samples[i : i + packet], min(i + packet, len(samples))) for i in range(0, len(samples), packet)]
        streams.append(pages_of(serial, packets))
    first = [s[0][1] for s in streams]
    rest = sorted(((begin, serial, n, p) for serial, s in enumerate(streams) for n, (begin, p) in enumerate(s[1:])), key=lambda x: x[:3])
    return b"".join(first + [x[3] for x in rest])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of each page that ends a packet
    ends: list[int] = field(default_factory=list)  # packets that had ended by then
    pages: int = 0
    begun: bytearray | None = None
    ended: bool = False


def read_ogg(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number. ValueError: no page where one must begin, a wrong checksum, a page that is missing, or a packet that lacks its start or end."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("the data end within a page")
        mark, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no Ogg page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("the data end within a page")
        if ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError(f"stream {serial}: first page missing or twice")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or s.ended:
            raise ValueError(f"stream {serial}: page {s.pages} is missing")
        if bool(flags & CONTINUED) != (s.begun is not None):
            raise ValueError(f"stream {serial}: a packet lacks its start or end")
        before = len(s.packets)
        for size in lacing:
            s.begun = (s.begun if s.begun is not None else bytearray()) + data[body : body + size]
            body += size
            if size < 255:
                s.packets.append(bytes(s.begun))
                s.begun = None
        if len(s.packets) > before:
            s.granules.append(granule)
            s.ends.append(len(s.packets))
        s.pages += 1
        s.ended = bool(flags & LAST)
        at = end
    if lost := [k for k, s in streams.items() if s.begun is not None or not s.ended]:
        raise ValueError(f"streams {lost} have no last page")
    return streams


def samples_of(stream: Stream) -> tuple[int, int, bytes]:
    """Number, rate and samples of a stream of the writer's; the last granule position must be the count of samples."""
    head = stream.packets[0]
    if head[:4] != MAGIC:
        raise ValueError("not a stream of 8-bit samples")
    number, rate, n = struct.unpack("<BIQ", head[4:])
    samples = b"".join(stream.packets[1:])
    if len(samples) != n or stream.granules[-1] != n:
        raise ValueError("samples are missing")
    return number, rate, samples


def times_of(stream: Stream, rate: int) -> list[float]:
    """The time in seconds at the end of each page that ends a packet."""
    return [g / rate for g in stream.granules]


def payload_of(data: bytes) -> bytes:
    return b"".join(x[2] for x in sorted(samples_of(s) for s in read_ogg(data).values()))


def pad(text: bytes, unit: int = 192) -> bytes:
    """With spaces up to a multiple of unit, one unit at least."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded, as an Ogg file. A null text counts as empty. Null ids and repeated rows
    are kept; an empty table gives no rows; a very long text is one file of many pages; other columns are not read, whatever their names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    return by_rows(rows, lambda: lambda ids, texts: [ids, [len(t) for t in texts], [write_ogg(pad(t)) for t in texts]], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary", 64)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, streams int, pages int, packets int, duration_ms long, last_page_ms array<long>"


def measure(media: bytes) -> tuple:
    streams = read_ogg(media)
    parts = sorted((*samples_of(s), times_of(s, RATE)[-1]) for s in streams.values())
    payload = b"".join(p[2] for p in parts)
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    power, crossings, peak = int((x * x).sum(dtype=np.int64)), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))), int(np.abs(x).max())
    feature = f"rms2={power // len(x)};crossings={crossings};peak={peak};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)}"
    ends = [round(1000 * p[3]) for p in parts]
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature, len(streams), sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()), max(ends), ends


def analyse(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, FEATURES and error of each Ogg file, from what is read back.

    A file that can't be read (a wrong checksum, a lost page, other data) gives null features and says why in error. A null file: all null. Null ids and
    repeated rows are kept, each with its own result; an empty table gives no rows; other columns are not read, whatever their names.
    """
    kind = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, media_bytes long, media_sha256 string, {FEATURES}, error string"

    def measured(file: bytes | None) -> tuple:
        if file is None:
            return (None,) * 10
        try:
            return *measure(file), None
        except (ValueError, IndexError, struct.error) as error:
            return *(None,) * 9, str(error) or type(error).__name__

    def make():
        def run(ids, sizes, files):
            rows = [measured(f) for f in files]
            return [ids, sizes, [None if f is None else len(f) for f in files], [None if f is None else hashlib.sha256(f).hexdigest() for f in files], *zip(*rows, strict=True)]

        return run

    return by_rows(media.select("doc_id", "n_bytes", "media"), make, kind, 64)


def write_media(media: DataFrame, path: str) -> None:
    media.write.option("compression", "zstd").parquet(path)


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores each text as an Ogg file in the shared folder and measures what is read back."""
    media, path = encode(table(spark, sf_dir, "documents")), shared_dir(spark)
    write_media(media, path)
    return analyse(spark.read.schema(media.schema).parquet(path))
