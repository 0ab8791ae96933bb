"""Quality rules: text statistics and a hashed n-gram likelihood ratio, in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE_RX, words_of

#: Buckets of the hashed n-grams (fixed: the ratio table has one number for each).
BUCKETS = 4096
#: A text is kept at this mean log-likelihood ratio per n-gram or more. Not derived, but looked at: on
#: sf0.1, of labelled texts that pass the base rules, 99.7 % of quality 1 and none of quality 0 reach it
#: (0: 97.2 % and none; -0.03: all and 1.4 %). The ratio is counted from the same texts of quality 1.
THRESHOLD = -0.015
#: Trusted ids up to this number (some 50 MB) are broadcast.
MOST_BROADCAST = 1_000_000
SYMBOLS_RX = r"[^#*$%&|<>]+"


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE_RX))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    return out.select(
        "doc_id",
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS_RX, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )


def _n_repeat_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in 3-word windows found twice or more.

    Each window is one long: its hash above, its place in the low bits, as many as the text needs.
    Sorted, equal windows are neighbours; the places of those found again are sorted, and each
    covers three words or as many as lie before the next. Of a hash 64 less log2(n) bits are left:
    in a text of 20,000 words different windows are taken for equal once in about 3 million texts.
    """
    n = F.size("h")
    bits = F.coalesce(F.ceil(F.log2(n.cast("double") + 1)).cast("int"), F.lit(1))
    rows = rows.withColumn("bits", bits)
    cleared = lambda x: F.call_function("shiftleft", F.call_function("shiftrightunsigned", x, F.col("bits")), F.col("bits"))
    window = lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
    packed = F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: cleared(window(i)).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("s", F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    key = lambda x: F.call_function("shiftright", x, F.col("bits"))
    equals = lambda x, y: F.coalesce(key(x) == key(y), F.lit(False))
    rows = rows.withColumn("f", F.filter("s", lambda x, i: equals(x, F.get("s", i - 1)) | equals(x, F.get("s", i + 1))))
    places = F.sort_array(F.transform("f", lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)))
    rows = rows.withColumn("p", places)
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("p", i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.when(F.size("p") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("s", "f", "p", "bits")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS).cast("long")).cast("int")


def _ngrams(h: str) -> Column:
    """Buckets of the words and of the word pairs of a text, from the hashes of its words."""
    pair = lambda x, i: _bucket(F.xxhash64(x, F.get(F.col(h), i + 1)))
    return F.concat(F.transform(h, _bucket), F.transform(F.slice(F.col(h), 1, F.greatest(F.size(h) - 1, F.lit(0))), pair))


def ratio_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(p_target / p_raw) of each bucket: target are texts of quality 1, raw are all texts.

    The raw counts cover every document, the target every one that is labelled 1 and never 0. Up to
    MOST_BROADCAST trusted ids go to every task, so that no text is moved; with more of them texts and
    ids are joined in a shuffle, which gives the same counts. Only the BUCKETS sums come to the driver. Add-one smoothing; without trusted texts every ratio is 0.
    """
    trusted = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    trusted = trusted.select("doc_id", F.lit(1).alias("target"))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    few = trusted.count() <= MOST_BROADCAST
    flagged = slim.join(F.broadcast(trusted) if few else trusted, "doc_id", "left")
    h = flagged.select("target", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    sums = h.select("target", F.explode(_ngrams("h")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("target"))
    target, raw = [1] * BUCKETS, [1] * BUCKETS
    for r in sums.collect():  # at most BUCKETS rows
        target[r.b], raw[r.b] = r.target + 1, r.raw + 1
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    a, b = math.log(sum(target)), math.log(sum(raw))
    return [round(math.log(t) - a - math.log(r) + b, 6) for t, r in zip(target, raw)]


def quality(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept).

    ``score`` is the sum of the ratios of a text's words and word pairs, divided by their number;
    a text is kept if no base rule fails and the score is at ``threshold`` or above. Base rules:
    fewer than 50 words, or more than half of them in repeated 3-word windows. The same text gets
    the same verdict in every run.

    Null and empty texts have no words, fail and score 0; a null id stays null; repeated rows are
    judged each; an empty table gives no rows; other columns are not read. A text is handled within
    its row, by sorting arrays of longs, however long it is.
    """
    rows = _n_repeat_words(_prepared(docs, id_col, text_col))
    held = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    n = F.size("h").cast("long")
    grams = F.greatest(2 * n - 1, F.lit(1).cast("long"))
    total = F.aggregate(_ngrams("h"), F.lit(0.0), lambda a, b: a + F.coalesce(F.get(held, b), F.lit(0.0)))
    rows = rows.withColumns({"n_words": n, "score": total / grams})
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(float(threshold)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", kept.alias("kept"))
