from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash

from decklattice.llm import quality as q

SCHEMA = "doc_id long, text string, kept string"


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x\x0by\x1cz\u00a0w é\u2028ü", "line\nline\n\n \nline \nother", "#*$ %&| <>", "w " * 30000]
    for _ in range(150):
        words = [rng.choice("ab cd éf g#h ij".split()) for _ in range(rng.randint(0, 200))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for w in words))
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(text, ratios):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    pair = lambda a, b: signed(xxhash.xxh64_intdigest((b % 2**64).to_bytes(8, "little"), xxhash.xxh64_intdigest((a % 2**64).to_bytes(8, "little"), 42)))
    grams = h + [pair(a, b) for a, b in zip(h, h[1:])]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    score = sum(ratios[g % q.BUCKETS] for g in grams) / max(1, len(grams))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, score


def test_every_text_equals_brute_force(spark):
    rows = [(None if i == 4 else i // 2, t, "x") for i, t in enumerate(texts())]
    ratios = [((i * 37) % 101 - 50) / 100 for i in range(q.BUCKETS)]
    got = q.quality(spark.createDataFrame(rows, SCHEMA), ratios, threshold=0.01).collect()
    key = lambda r: (str(r[0]), *r[1:7], round(r[7], 9), r[8])
    want = [(d, *b, not b[5] and b[6] >= 0.01) for d, t, _ in rows for b in [brute(t, ratios)]]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_ratios_tell_trusted_from_raw(spark):
    docs = [(i, "good fine words " * 30 if i % 2 else "bad junk ### " * 30, "x") for i in range(40)]
    labels = [(i, i % 2) for i in range(20)] + [(1, 0), (None, 1)]
    frame = spark.createDataFrame(docs, SCHEMA)
    ratios = q.ratio_table(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    score = {r.doc_id: r.score for r in q.quality(frame, ratios).collect()}
    assert min(score[i] for i in range(1, 40, 2)) > max(score[i] for i in range(0, 40, 2)) + 0.1
    none = q.ratio_table(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert set(none) == {0.0}


def test_empty_table(spark):
    assert q.quality(spark.createDataFrame([], SCHEMA), [0.0] * q.BUCKETS).count() == 0


def test_no_python_in_the_plan(spark):
    frame = q.quality(spark.createDataFrame([(1, "a b", "x")], SCHEMA), [0.0] * q.BUCKETS)
    assert "Python" not in (plan := frame._jdf.queryExecution().toString()) and "Arrow" not in plan
    assert pytest.approx(0.0) == frame.collect()[0].score


def test_every_trusted_text_counts(spark):
    docs = spark.range(20_400).selectExpr("id AS doc_id", "concat('w', id) AS text")
    assert set(q.ratio_table(docs, docs.selectExpr("doc_id", "1 AS quality"))) == {0.0}


def test_counts_are_the_same_with_and_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 150, t, "x") for i, t in enumerate(texts())] + [(None, "a b c", "x")], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(0, 0), (None, 1)], "doc_id long, quality int")
    few = q.ratio_table(docs, labels)
    monkeypatch.setattr(q, "MOST_BROADCAST", 0)
    assert q.ratio_table(docs, labels) == few and any(few)
