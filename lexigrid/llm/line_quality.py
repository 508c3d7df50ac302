"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z to lower case, digits to 0, white space to single spaces, trimmed) and hashed. A line that more than `limit`
distinct documents of one host share is removed there; a document that loses over half of its characters is depleted and rejected. Counted by texts instead, copies
of one text count once, so that a copied document isn't rejected for its copies. Distinct (line, document) pairs are counted before lines, so a line that a third of the
documents hold is summed from partial counts; lines meet the counts in a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 50
WINDOW = 8
_GAPS = " \t\n\x0b\x0c\r"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = "[ \\t\\n\\x0b\\f\\r]"
_SYMBOL = "[#*$%&|<>]"


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{_GAP}+"), "")


def _normal(text: Column) -> Column:
    """Of each line, in order; blank lines are empty."""
    plain = F.translate(text, _LETTERS + "0123456789\t\x0b\x0c\r", _LETTERS.lower() + "0" * 10 + " " * 4)
    single = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)
    return F.transform(F.split(single, "\n"), lambda x: F.btrim(x))


def normal_lines(text: Column) -> Column:
    return F.filter(_normal(text), lambda x: x != "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in words; words is evaluated once."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("at"))
        total = F.aggregate(_let(ranked, places), start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["at"])).alias("n"), i.alias("at")))["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total)

    def hashes(h: Column) -> Column:
        n = F.size(h) - (window - 1)
        return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(h[i + k] for k in range(window)))))

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(_let(word_hashes, hashes), covered)


def _key(host: Column, line: Column) -> Column:
    return F.xxhash64(host.isNull(), host, line)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: int = LIMIT, count: str = "documents") -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, kept_chars, depleted, kept
    and kept_text (the text without the removed lines, which has kept_chars characters; null for a null text).

    base_failed: under 20 words, or over 30 % of the words in 8-word windows that occur twice. count: what a line's limit counts, distinct `documents`
    (by id and text) or distinct `texts`. A null text has no words. Rows without a host form one host. Repeated rows get the same verdict and count as one
    document. A line that stands `limit` times stays; one more removes it. An empty table gives no rows. All columns are kept; new ones replace those of the same name.
    """
    if count not in ("documents", "texts"):
        raise ValueError("count must be documents or texts")
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", "kept_chars", "depleted", "kept", "kept_text"]
    # names of this function's own, so that no column of docs can clash with them
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    docs, carried = docs.toDF(*own.values()), [own[c] for c in own if c not in made]
    whole, host = F.col(own[text_col]), F.col(own[host_col])
    text = F.coalesce(whole, F.lit(""))
    ids = [F.col(own[id_col]).isNull(), F.col(own[id_col])] if count == "documents" else []
    mark = F.xxhash64(host.isNull(), host, text, *ids).alias("__th")

    lines = docs.select(mark, host.alias("__host"), F.array_distinct(normal_lines(text)).alias("__lines"))
    held = lines.select("__th", F.explode("__lines").alias("line"), "__host").select("__th", _key(F.col("__host"), F.col("line")).alias("key")).distinct()
    often = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key")
    hit = held.join(often, "key").groupBy("__th").agg(F.collect_list("key").alias("__often"))

    both = F.zip_with(F.split(text, "\n"), _normal(text), lambda x, y: F.struct(x.alias("raw"), y.alias("line")))
    base = docs.select(*carried, mark, words_of(text).alias("__words"), F.filter(both, lambda x: x["line"] != "").alias("__both"))
    raw = F.transform("__both", lambda x: x["raw"])
    base = base.select(
        *carried,
        "__th",
        F.size("__words").cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(_GAP))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("__both") - F.size(F.array_distinct(raw))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.length(text).alias("__length"),
        F.transform("__both", lambda x: F.struct(_key(host, x["line"]).alias("key"), F.length(F.replace(x["line"], F.lit(" "), F.lit(""))).alias("n"), (F.length(x["raw"]) + 1).alias("raw"))).alias("__keys"),
    )
    met = base.join(hit, "__th", "left")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("raw"))
    more = F.aggregate("__keys", none, lambda acc, x: F.when(F.array_contains("__often", x["key"]), F.struct((acc["n"] + x["n"]).alias("n"), (acc["raw"] + x["raw"]).alias("raw"))).otherwise(acc))
    met = met.withColumn("__gone", F.when(F.col("__often").isNull(), none).otherwise(more))
    gone, left = F.col("__gone.n"), F.greatest(F.col("__length") - F.col("__gone.raw"), F.lit(0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    met = met.withColumn("removed_chars", gone).withColumn("base_failed", failed).withColumn("depleted", F.col("removed_chars") * 2 > F.col("word_chars"))
    stays = F.filter(F.split(whole, "\n"), lambda x: F.size(F.filter(F.transform(normal_lines(x), lambda y: _key(host, y)), lambda y: F.array_contains("__often", y))) == 0)
    kept_text = F.when(F.col("__often").isNull(), whole).otherwise(F.array_join(stays, "\n"))
    kept = ~F.col("base_failed") & ~F.col("depleted")
    out = met.select(*carried, *made[:6], "removed_chars", left.alias("kept_chars"), "depleted", kept.alias("kept"), kept_text.alias("kept_text"))
    return out.toDF(*(c for c in own if c not in made), *made)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars", "kept_chars")


#: The verdict for every row of a view named docs; {limit} as LIMIT; {what}: what a line's limit counts.
VERDICT_SQL = """
d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n
      FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
win AS (SELECT r, i, n, word, CASE WHEN i + 7 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS g FROM w),
rep AS (SELECT r, i, length(word) AS c, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS again FROM win),
cov AS (SELECT r, c, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM rep),
ws AS (SELECT r, count(*) AS n_words, sum(c)::BIGINT AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM cov GROUP BY r),
raw AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
lines AS (SELECT r, i, source, doc_id, t, trim(regexp_replace(l, ' +', ' ', 'g'), ' ') AS l FROM (
      SELECT r, source, doc_id, t, unnest(range(len(string_split(t, chr(10))))) AS i, unnest(string_split(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789' || chr(9) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz0000000000    '), chr(10))) AS l FROM d)),
often AS (SELECT source, l FROM lines WHERE l <> '' GROUP BY source, l HAVING count(DISTINCT {what}) > {limit}),
gone AS (SELECT r, sum(length(replace(lines.l, ' ', '')))::BIGINT AS removed_chars FROM lines JOIN often ON lines.l = often.l AND lines.source IS NOT DISTINCT FROM often.source GROUP BY r),
raws AS (SELECT r, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
stay AS (SELECT raws.r, string_agg(x, chr(10) ORDER BY raws.i) AS kept_text FROM raws JOIN lines ON raws.r = lines.r AND raws.i = lines.i LEFT JOIN often ON lines.l = often.l AND lines.source IS NOT DISTINCT FROM often.source WHERE often.l IS NULL GROUP BY raws.r),
verdict AS (SELECT d.r, d.doc_id, coalesce(kept_text, '') AS kept_text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      coalesce(n_words, 0) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * coalesce(n_words, 0) AS base_failed, coalesce(removed_chars, 0) AS removed_chars
      FROM d LEFT JOIN ws USING (r) LEFT JOIN raw USING (r) LEFT JOIN gone USING (r) LEFT JOIN stay USING (r))
"""

OP7_SQL = f"WITH {VERDICT_SQL.format(docs='documents', limit=LIMIT, what='(doc_id, t)')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_chars * 2 <= word_chars AS kept, removed_chars, CAST(length(kept_text) AS BIGINT) AS kept_chars FROM verdict"
