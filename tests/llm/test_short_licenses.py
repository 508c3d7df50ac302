import regex

from lexigrid.llm import license_scan


def test_short_names_are_scored(spark):
    model = license_scan.trained()
    short = {"gnu gpl", "gpl v2", "cc by", "cc by-nc", "by-nc 4.0", "cc0 1.0"}
    assert short & set(model.grams)
    texts = ["GNU GPL v2", "CC BY-NC 4.0", "CC0 1.0", "CC BY 4.0", "Prose.\nSee CC BY-NC-SA 4.0"]
    got = {(r.doc_id, r.place): r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {}
    for i, text in enumerate(texts):
        for n, line in enumerate(regex.split(license_scan.BREAK, text)):
            s = model.scores(line)
            if s.argmax() != len(model.families) - 1 and s.max() >= model.threshold:
                want[i, n] = model.families[s.argmax()]
    assert want and {k: r.family for k, r in got.items()} == want
