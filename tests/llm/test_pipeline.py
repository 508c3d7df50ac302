import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import line_quality, tokens

from .helpers import ODD, SCHEMA, repeats, words
from .test_dedup_quality import plain_quality
from .test_near_dedup import firsts


def left_over(text, kept, removed):
    """The text without removed words and the white space after them; kept are the words that stay, in order."""
    import re

    if not removed:
        return text
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    ends = [s for s, _ in spans[1:]] + [len(text)]
    out, at = text[: spans[0][0]], 0
    stays = [not g for g in kept]
    for (start, _), end, stay in zip(spans, ends, stays, strict=True):
        out += text[start:end] if stay else ""
        at = end
    assert at == len(text)
    return out


def gone(rows, window=20):
    """Of each document, whether each word goes."""
    first, out = set(), {}
    for doc, text in sorted(set(rows)):
        w = words(text)
        out[doc] = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in first:
                out[doc][i : i + window] = [True] * window
            first.add(key)
    return out


def test_run_against_plain(spark, sf):
    rows = sorted((r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    texts: dict = {}
    for d, t, source in rows:
        for line in t.split("\n"):
            texts.setdefault((source, " ".join(line.lower().split())), set()).add(t)
    assert max(len(x) for (_, line), x in texts.items() if line) <= line_quality.LIMIT  # so that only base rules reject here
    rows = [(d, t) for d, t, _ in rows if not plain_quality(t)[5]]
    first = firsts(rows)
    rows = [(d, t) for d, t in rows if d in first]
    left, removed = repeats(rows), gone(rows)
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {d for d, _ in rows}
    encoder = tokens.json_encoder(P.path("byte_bpe_50k.json"))
    for d, t in rows:
        text = left_over(t, removed[d], left[d][1])
        assert words(text) == left[d][2]
        ids = [*np.frombuffer(encoder.ids(text), "<u4").tolist(), 0]
        assert {r.doc_tokens for r in got[d]} == {len(ids)} and sum(r.length for r in got[d]) == len(ids)
        for r in got[d]:
            import zlib

            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert any(left[d][1] for d, _ in rows)


def test_stages_on_odd_rows(spark, sf):
    for docs in (spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.withColumn("n_words", F.lit("x")).withColumn("kept_text", F.lit("y")), sf)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == corpus_pipeline.COLUMNS
            out.count()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(ODD, SCHEMA), sf).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "3", "5", "7", "7", "8", "9", "10", "None"])
