import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lexigrid.llm import bfd_packing, bpe_fst, pow2_packing, tokens

from .helpers import ODD, SCHEMA, sha

TEXTS = ["", " ", "  ", "a  b", "a   b\n  c \n d  ", "\x1c \x1d a", "日本語テキスト 日本語 です", "½ ² Ⅷ ٣ 3٣", "don't we'll I'M 's", "x" * 3000, "é 🙂🙂 👨‍👩‍👧", "\xa0\xa0 a b", "\r\n\r\n a", " \n \n b", "<|endoftext|> a", "аб вг " * 20, "Ab" * 700, "a\tb\t c", "end. Next, word\nline"]


@pytest.fixture(scope="module")
def multi():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_gives_the_librarys_ids(multi):
    encoder, decoder = bpe_fst.codec(multi[0])
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdeéñ .,'\n0129ßЖ") for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in TEXTS + made:
        ids = np.frombuffer(encoder.ids(text), tokens.ID).tolist()
        assert ids == multi[1].encode_ordinary(text), text[:50]
        assert b"".join(decoder.tokens[i] for i in ids).decode() == text
    column = pa.array(TEXTS + made)
    got = encoder.batch(column).to_pylist()
    assert [np.frombuffer(g, tokens.ID).tolist() for g in got] == [multi[1].encode_ordinary(t) for t in TEXTS + made]
    assert decoder.batch(pa.array([*got, None], pa.binary())).to_pylist() == [*TEXTS, *made, None]


@pytest.mark.parametrize("most", [1, 3, 20, 1000])
def test_small_tables_and_unreached_token(most):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258, b"cd": 259, b"abc": 260, b"dd": 261, b"cdd": 262}
    machine, plain = bpe_fst.Transducer(ranks, most), tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(500):
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(4))]
        got = machine.batch(pa.array(texts, pa.string()), longest=9).to_pylist()
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [machine.encode(t.encode()) for t in texts] == [plain.encode_ordinary(t) for t in texts], texts
    assert machine.filled <= most and len(machine.places) <= 2 * most + 2


def test_random_vocabularies():
    rng = random.Random(9)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 290:
            a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
            if set(a + b) <= set(b"abc") and len(a + b) < 9:
                ranks.setdefault(a + b, len(ranks))
        machine, plain = bpe_fst.Transducer(ranks, 50), tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
        for some in (texts[:20], texts[20:]):
            assert [np.frombuffer(g, "<u4").tolist() for g in machine.batch(pa.array(some)).to_pylist()] == [plain.encode_ordinary(t) for t in some], ranks


def test_utf8_stream():
    for data in (b"\xe2\x82", b"\xed\xa0\x80a", b"\xf0\x90\x80", b"\xc0\xaf", b"\xe0\x9f\xbf", b"\xf4\x90\x80\x80", b"\xf1\x80\xe1\x80\xc2b\x80", bytes(range(256)) * 2):
        s = bpe_fst.Utf8Stream()
        assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.close() == data.decode(errors="replace")
    rng = random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC2, 0xE0, 0xE1, 0xED, 0xF0, 0xF4, 0xF5]) for _ in range(8))
        s = bpe_fst.Utf8Stream()
        assert s.feed(data) + s.close() == data.decode(errors="replace")
    data = "aé日🙂z".encode() + b"\xff"
    for cut in range(len(data)):
        s = bpe_fst.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.close() == data.decode(errors="replace")
    s = bpe_fst.Utf8Stream()
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.close() == data.decode(errors="replace")


def test_cached_ids_are_the_tokenizers():
    path = P.path("byte_bpe_50k.json")
    encoder, model = tokens.json_encoder(path), Tokenizer.from_file(path)
    spaces = [" " * 700_000 + "a b", "\n" * 600_000]
    for text in TEXTS + spaces + ["<|endoftext|><|endoftext|>x <|endo"]:
        assert np.frombuffer(encoder.ids(text), tokens.ID).tolist() == model.encode(text, add_special_tokens=False).ids, text[:50]


def test_op10_on_odd_rows(spark, multi):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = bpe_fst.decode(bpe_fst.encode(docs, multi[0]), multi[0]).collect()
    assert len(got) == len(ODD)
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert bpe_fst.encode(docs.limit(0), multi[0]).count() == 0


def test_op10_query_against_the_library(spark, sf, multi):
    from lexigrid.llm.queries import queries

    got = {r.doc_id: r for r in queries()["op10_bpe_fst"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(multi[1].encode_ordinary(d.text), "<u4")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(d.text))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1023, 1024, 1025, 5000])
def test_binary_pieces(n):
    pieces = pow2_packing.binary_pieces(n)
    assert sum(k for _, k in pieces) == n and all(k & (k - 1) == 0 and k <= 1024 for _, k in pieces)
    assert [s for s, _ in pieces] == [sum(k for _, k in pieces[:i]) for i in range(len(pieces))]


def test_op5_query(spark, sf):
    from lexigrid.llm.queries import queries

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = queries()["op5_pow2_packing"](spark, sf).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, at = np.array([*model.encode(d.text, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_op5_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = pow2_packing.pack(docs, P.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in out.collect()} == {r[0] for r in ODD}
    assert out.where("doc_id = 2").first()["doc_tokens"] == 1
    pow2_packing.write_buckets(out, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == out.count()
    assert pow2_packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(3)
    for width in (1, 7, 64):
        lengths = [rng.randrange(1, width + 1) for _ in range(300)]
        free, rows = [], []
        for k in sorted(range(300), key=lambda k: -lengths[k]):
            fit = [i for i, f in enumerate(free) if f >= lengths[k]]
            if fit:
                best = min(free[i] for i in fit)
            else:
                free.append(width)
                best = width
            at = max(i for i, f in enumerate(free) if f == best) if not fit else next(i for i in fit if free[i] == best)
            free[at] -= lengths[k]
            rows.append(at)
        got = bfd_packing.best_fit_decreasing(lengths, width)
        assert sorted(k for r in got for k in r) == list(range(300)) and all(sum(lengths[k] for k in r) <= width for r in got)
        assert sorted(width - sum(lengths[k] for k in r) for r in got) == sorted(free)


def test_op1_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumnsRenamed({"lang": "ids", "source": "sequence_id"})
    path = P.path("byte_bpe_50k.json")
    packed = bfd_packing.pack(docs, path, width=64, block=500)
    bfd_packing.write_matrices(packed, str(tmp_path / "m"))
    parts = []
    for r in bfd_packing.read_matrices(spark, str(tmp_path / "m")).collect():
        line = np.frombuffer(r.ids, "<u2")
        assert len(line) == 64 and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1] and (line[r.n_tokens :] == 50256).all()
        assert bfd_packing.positions(r.cu_seqlens, 64).tolist() == [p for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False) for p in range(b - a)] + [0] * (64 - r.n_tokens)
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts.append((str(doc), start, line[a:b].tolist()))
    encoder, want = tokens.json_encoder(path), []
    for doc, text, *_ in ODD:
        ids = [*np.frombuffer(encoder.ids(text or ""), "<u4").tolist(), 50256]
        want += [(str(doc), at, ids[at : at + 64]) for at in range(0, len(ids), 64)]
    assert sorted(parts) == sorted(want)
    assert bfd_packing.pack(docs.limit(0), path).count() == 0


def test_id_width():
    assert bfd_packing.id_kind(65_535).itemsize == 2 and bfd_packing.id_kind(65_536).itemsize == 4 and bfd_packing.id_kind(70_000).itemsize == 4
    with pytest.raises(ValueError):
        bfd_packing.id_kind(1 << 32)


def test_large_ids_are_whole(spark, monkeypatch):
    class Large:
        largest = 70_000

        def ids(self, text):
            return np.full(len(text), 70_000, "<u4").tobytes()

    from pyspark import TaskContext

    monkeypatch.setattr(bfd_packing, "json_encoder", lambda path: Large())
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)})))
    made = {}

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            made["rows"] = [r for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["abc"]})])) for r in b.to_pylist()]

    bfd_packing.pack(Rows(), "x", width=8, end_id=0)
    (row,) = made["rows"]
    assert row["id_bytes"] == 4 and np.frombuffer(row["ids"], "<u4").tolist() == [70_000] * 3 + [0] * 5


def test_op1_query(spark, sf):
    from lexigrid.llm.queries import queries

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d.doc_id: [*model.encode(d.text, add_special_tokens=False).ids, 50256] for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left, rows = {d: len(x) for d, x in ids.items()}, queries()["op1_bfd_packing"](spark, sf).collect()
    for r in rows:
        line = []
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            line += ids[doc][start : start + b - a]
            left[doc] -= b - a
        assert len(line) == r.n_tokens and r.width == 2048 and r.ids_crc32 == zlib.crc32(np.array(line + [50256] * (2048 - len(line)), "<u2").tobytes())
    assert not any(left.values()) and len({r.sequence_id for r in rows}) == len(rows)


def test_op5_buckets(spark, tmp_path):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumnsRenamed({"lang": "ids", "source": "bucket"})
    path = str(tmp_path / "b")
    pow2_packing.write_buckets(pow2_packing.pack(docs, P.path("byte_bpe_50k.json")), path)
    assert {(r.length, r.n) for r in pow2_packing.read_buckets(spark, path, 3).selectExpr("length", "length(ids) AS n").collect()} <= {(8, 32)}
    empty = str(tmp_path / "e")
    pow2_packing.write_buckets(pow2_packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")), empty)
    assert pow2_packing.read_buckets(spark, empty).count() == 0


def test_op10_on_clashing_names_and_a_long_text(spark, multi):
    rows = [(1, "a b  c " * 200_000, "x"), (2, " " * 5000, "y"), (2, " " * 5000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    assert sorted((r.doc_id, r.text) for r in bpe_fst.decode(bpe_fst.encode(docs, multi[0]), multi[0]).collect()) == sorted(r[:2] for r in rows)
