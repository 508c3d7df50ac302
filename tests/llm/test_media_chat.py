import random
import zlib

import pytest

from lexigrid.llm import chat_events, ogg_media

from .helpers import ODD, SCHEMA, sha


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_crc():
    for n in (0, 1, 7, 300):
        data = random.Random(n).randbytes(n)
        assert ogg_media.ogg_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [192, 384, 510 * 96, 192 * 2000])
def test_round_trip_and_faults(n):
    payload = random.Random(n).randbytes(n)
    media = ogg_media.write_ogg(payload)
    assert ogg_media.payload_of(media) == payload
    streams = ogg_media.read_ogg(media)
    assert sorted(streams) == [1, 2] and all(ogg_media.times_of(s, 8000)[-1] == n / 2 / 8000 for s in streams.values())
    broken = bytearray(media)
    broken[len(media) // 2] ^= 1
    with pytest.raises(ValueError):
        ogg_media.read_ogg(bytes(broken))
    with pytest.raises(ValueError):
        ogg_media.read_ogg(media[:-1])


def test_packet_over_many_pages_and_lacing_of_255():
    packets = [(b"head", 0), (bytes(255), 10), (bytes(70_000), 20), (b"", 30), (b"end", 40)]
    media = b"".join(p for _, p in ogg_media.pages_of(9, packets))
    s = ogg_media.read_ogg(media)[9]
    assert s.packets == [p for p, _ in packets] and s.granules[-1] == 40


def test_missing_page():
    pages = [p for _, p in ogg_media.pages_of(1, [(b"h", 0), (bytes(200_000), 5)])]
    assert len(pages) > 3
    with pytest.raises(ValueError, match="missing"):
        ogg_media.read_ogg(b"".join(pages[:1] + pages[2:]))


def test_op2_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumnsRenamed({"lang": "media", "source": "payload", "n_chars": "n_bytes"})
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) for r in ogg_media.analyse(ogg_media.encode(docs)).collect()), key=repr)
    want = []
    for doc, text, *_ in ODD:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want.append((doc is None, doc, len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]), None))
    assert got == sorted(want, key=repr)
    by = {r.doc_id: r for r in ogg_media.analyse(ogg_media.encode(docs)).collect()}
    assert by[5].media_sha256 == by[6].media_sha256 and by[5].feature == by[6].feature
    assert ogg_media.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bad_files_are_rows(spark):
    good = ogg_media.write_ogg(bytes(range(192)))
    broken = bytearray(good)
    broken[60] ^= 1
    files = [good, bytes(broken), good[:-5], b"", b"not a file" * 9, None, good[: len(good) // 2], b"".join(p for _, p in ogg_media.pages_of(3, [(b"other", 0), (b"x", 1)]))]
    rows = spark.createDataFrame([(i, 0, f) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in ogg_media.analyse(rows).collect()}
    assert got[0].error is None and got[0].payload_sha256 == sha(bytes(range(192))) and got[5].error is None and got[5].media_bytes is None
    assert "checksum" in got[1].error and all(got[i].error and got[i].payload_sha256 is None and got[i].media_bytes == len(files[i]) for i in (1, 2, 3, 4, 6, 7))


def test_op2_query(spark, sf):
    from lexigrid.llm.queries import queries

    got = {r.doc_id: r for r in queries()["op2_ogg_media"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        payload = ogg_media.pad(d.text.encode())
        r = got[d.doc_id]
        half = len(payload) // 2
        samples = [b - 128 for b in payload]
        crossings = sum((x < 0) != (y < 0) for x, y in zip(samples, samples[1:], strict=False))
        feature = f"rms2={sum(x * x for x in samples) // len(samples)};crossings={crossings};peak={max(map(abs, samples))};mean={sum(samples) * 1000 // len(samples)}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(d.text.encode()), len(payload), sha(payload), zlib.crc32(payload[-16:]), feature)
        # two streams of a head and packets of 2,048 samples; heads, samples, lacing and page heads make up the file
        packets = 2 * (1 + -(-half // 2048))
        assert (r.streams, r.packets, r.duration_ms, r.error) == (2, packets, round(1000 * (len(payload) - half) / 8000), None)
        media = ogg_media.write_ogg(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media)) and r.pages == media.count(b"OggS") and r.last_page_ms == [round(half / 8), round((len(payload) - half) / 8)]


def test_escape_is_reversible():
    rng = random.Random(4)
    parts = [*chat_events.CONTROL, "\\", "<", "|", "a", "\n", "[", "start"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(8))
        safe = chat_events.escape(text)
        assert chat_events.unescape(safe) == text and not any(c in safe for c in chat_events.CONTROL)
        role = rng.choice(["user", "assistant", "", "a<|end|>"])
        assert list(chat_events.parse(chat_events.render(role, text)[0] * 2)) == [(role, text)] * 2
    with pytest.raises(ValueError):
        list(chat_events.parse("loose words"))


def plain_fold(log):
    """Rows of EVENTS, one at a time in the order of the sequence."""
    begin, talks = {}, {}
    for conv, seq, message, kind, role, text in sorted(log, key=lambda e: (e[1], e[3], e[5] or "")):
        talk = talks.setdefault(conv, {})
        first = (conv, message) not in begin
        at = begin.setdefault((conv, message), seq)
        if first:
            talk[message] = ["", "", False]
        if kind in ("edit", "regenerate"):
            for m in [m for m in talk if begin[conv, m] > at and begin[conv, m] < seq]:
                del talk[m]
        if message in talk:
            state = talk[message]
            state[0] = role or "" if kind == "start" else state[0]
            state[1] = {"start": state[1], "delta": state[1] + (text or ""), "edit": text or "", "regenerate": "", "delete": state[1]}[kind]
            state[2] |= kind == "delete"
    return {(c, m): (begin[c, m], role, text) for c, talk in talks.items() for m, (role, text, gone) in talk.items() if not gone}


def folded(spark, log):
    return {(r.conv_id, r.message): (r.position, r.role, r.text) for r in chat_events.fold(spark.createDataFrame(log, chat_events.EVENTS)).collect()}


def test_fold(spark):
    log = [
        (1, 0, 1, "start", "user", None), (1, 1, 1, "delta", None, "a"), (1, 2, 1, "delta", None, "b"), (1, 3, 2, "start", "assistant", None), (1, 4, 2, "delta", None, "no"), (1, 5, 3, "start", "user", None), (1, 6, 3, "delta", None, "why"),
        (1, 7, 2, "regenerate", None, None), (1, 8, 2, "delta", None, "yes"), (1, 9, 4, "edit", None, "e"), (1, 10, 4, "delta", None, None), (1, 11, 5, "start", "user", None), (1, 12, 5, "delete", None, None), (None, 1, 1, "delta", None, "lost"),
        (2, 1, 1, "start", "user", None), (2, 2, 2, "start", "assistant", None), (2, 3, 3, "start", "user", None), (2, 4, 1, "edit", None, "over all"), (2, 5, 3, "delta", None, "too late"), (2, 6, 4, "start", "assistant", None),
    ]
    got = folded(spark, log)
    assert got == {(1, 1): (0, "user", "ab"), (1, 2): (3, "assistant", "yes"), (1, 4): (9, "", "e"), (None, 1): (1, "", "lost"), (2, 1): (1, "user", "over all"), (2, 4): (6, "assistant", "")}
    assert got == plain_fold(log)
    assert chat_events.fold(spark.createDataFrame([], chat_events.EVENTS)).count() == 0


def test_fold_against_plain(spark):
    rng = random.Random(5)
    log = []
    for conv in range(60):
        for seq in rng.sample(range(1000), rng.randrange(30)):
            log.append((conv, seq, rng.randrange(6), rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "delete"]), rng.choice(["user", "assistant"]), rng.choice("xyz")))
    rng.shuffle(log)
    assert folded(spark, log) == plain_fold(log)
    with pytest.raises(Exception, match="unknown kind"):
        folded(spark, [(1, 1, 1, "shout", None, None)])


def test_op4_query(spark, sf):
    from lexigrid.llm.queries import queries

    said = "</s>[INST] ok [/INST]"
    turns = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: r for r in queries()["op4_chat_events"](spark, sf).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        own = sorted(t for t in turns if t[0] == conv)
        loss = "".join(t[3] for t in own if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), sha("".join(f"{t[2]}\n{t[3]}\n" for t in own)), len(loss), sha(loss))


def test_op4_odd_rows(spark):
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 2), (None, 0, None, "x", 3), (1, 1, "assistant", "\\<s>", 4), (2, None, "assistant", "é🙂" * 100_000, 5), (2, -3, "user", "", 6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position long")
    made = lambda t: chat_events.digest(chat_events.format_messages(chat_events.fold(chat_events.as_events(t))))
    got = {r.conv_id: r for r in made(turns).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 4 and got[None].n_turns == 1
    long = "é🙂" * 100_000
    assert (got[2].n_turns, got[2].loss_chars, got[2].turns_sha256) == (2, 200_000, sha(f"assistant\n{long}\nuser\n\n"))
    assert made(turns.limit(0)).count() == 0
