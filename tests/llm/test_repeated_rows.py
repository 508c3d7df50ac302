import pytest

from lexigrid.llm import substring_dedup

from .helpers import repeats, sha


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_copies_of_a_row_in_different_blocks(spark, parts):
    shared, own = " ".join(f"s{i}" for i in range(40)), " ".join(f"u{i}" for i in range(80))
    first, copied, other = (1, f"{shared} begin"), (2, f"{shared} {own}"), (3, f"{own} more")
    rows = [first, copied, copied, other]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    want = repeats(rows)
    got = substring_dedup.remove_repeats(df).collect()
    assert len(got) == 4
    for r in got:
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, sha(" ".join(kept))), r.doc_id


def test_blocks_of_the_same_rows(spark):
    row = (1, " ".join(f"w{i % 50}" for i in range(200)))
    df = spark.createDataFrame(spark.sparkContext.parallelize([row] * 3, 3), "doc_id long, text string")
    assert {(r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()} == {repeats([row])[1][:2]}
