import corpus_pipeline

from .helpers import SCHEMA


def test_stage_removes_lines_above_the_limit(spark, sf):
    def own(i):
        return " ".join(f"own{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(30))

    shared = "Subscribe to our list"
    rows = [(i, f"{own(i)}\n{shared}", "en", "hot", 7) for i in range(60)] + [(100 + i, f"{own(60 + i)}\n{shared}", "en", f"host{i}", 7) for i in range(60)]
    got = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert len(got) == len(rows)
    assert all(got[i].text == own(i) and got[i].n_chars == len(own(i)) for i in range(60))
    assert all(got[100 + i].text == rows[60 + i][1] and got[100 + i].n_chars == 7 for i in range(60))
