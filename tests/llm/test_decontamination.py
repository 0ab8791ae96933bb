from __future__ import annotations

import random

import numpy as np
import pytest

from decklattice.llm import decontamination as d

SCHEMA = "doc_id long, text string, item_id string"


def plain_score(a, b):
    rows, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        assert d.align(a, b) == plain_score(a.tolist(), b.tolist())


def make():
    rng = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: [rng.choice(words[:80]) if rng.random() < 0.7 else rng.choice(words) for _ in range(n)]
    items = [text(rng.randint(15, 50)) for _ in range(30)]
    docs = []
    for i in range(200):
        w = text(rng.randint(0, 300))
        if i % 3 == 0:
            own = list(items[i % 30])
            for k in range(9, len(own), 10):
                own[k] = rng.choice(["changed", own[k]])
            at = rng.randint(0, len(w))
            w[at:at] = own
        docs.append((i, ("%s, " if i % 2 else "%s ") * len(w) % tuple(w), "x"))
    return docs, [(k, " ".join(x).upper() + ".") for k, x in enumerate(items)]


def test_documents_equal_alignment_with_every_item(spark):
    docs, items = make()
    got = {r.doc_id: r for r in d.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = lambda t: d._WORDS(t.lower())
    for i, text, _ in docs:
        best = max(plain_score(split(t), split(text)) / len(split(t)) for _, t in items) if i % 10 == 0 or i % 3 == 0 and i < 60 else None
        if best is not None:
            assert got[i].contaminated == (best >= 0.5)
            if best >= 0.5:
                assert got[i].score == pytest.approx(best)
    assert sum(r.contaminated for r in got.values()) == 67


def test_common_passages_long_texts_and_blocks(spark, monkeypatch):
    docs, items = make()
    shared = [(1000 + i, items[0][1], "x") for i in range(300)] + [(5000, "z " * 100_000 + items[1][1] + " z" * 100_000, "x"), (6000, None, "x"), (None, "", "x")]
    frame, bench = spark.createDataFrame(docs + shared, SCHEMA), spark.createDataFrame([*items, (99, None), (98, "too few words")], "item_id long, text string")
    one = sorted(map(str, d.contamination(frame, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 500)
    assert sorted(map(str, d.contamination(frame, bench).collect())) == one
    kept = d.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(docs) - 67 + 2


def test_empty_tables(spark):
    docs, items = make()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    out = d.contamination(spark.createDataFrame(docs[:5], SCHEMA), bench.limit(0)).collect()
    assert len(out) == 5 and all(r.score == 0 and r.item_id is None for r in out)


def test_short_items_count_word_for_word(spark):
    from decklattice.llm import decontamination

    benchmark = spark.createDataFrame([(1, "Seven red foxes, at dawn")], "item_id long, text string")
    texts = ["we saw seven red foxes at dawn again", "we saw seven red foxes at noon", "seven red foxes", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.score) for r in decontamination.contamination(docs, benchmark).collect()}
    assert got == {0: (True, 1.0), 1: (False, 0.0), 2: (False, 0.0), 3: (False, 0.0)}


def test_ids_of_any_type(spark, monkeypatch):
    docs, items = make()
    frame = spark.createDataFrame([("d%d" % i, t) for i, t, _ in docs[:40]], "doc_id string, text string")
    bench = spark.createDataFrame([("item-%03d" % k, t) for k, t in items], "item_id string, text string")
    one = sorted(map(str, d.contamination(frame, bench).collect()))
    assert any("item-" in r for r in one)
    monkeypatch.setattr(d, "BLOCK_CHARS", 700)
    assert sorted(map(str, d.contamination(frame, bench).collect())) == one


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_edited_items_are_found(spark, share):
    """Every tenth, fifth or third word or so of an item changed, left out or doubled, in 150 texts."""
    rng = random.Random(int(share * 100))
    words = ["w%d" % i for i in range(3000)]
    items = [[rng.choice(words) for _ in range(rng.randint(25, 60))] for _ in range(150)]
    docs, want = [], []
    for k, item in enumerate(items):
        own = []
        for w in item:
            r = rng.random()
            own += [w] if r >= share else [[rng.choice(words)], [], [w, w]][int(3 * r / share)]
        text = [rng.choice(words) for _ in range(100)] + own + [rng.choice(words) for _ in range(100)]
        docs.append((k, " ".join(text)))
        want.append(plain_score(item, text[90 : 110 + len(own)]) / len(item))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.score for r in d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    due = [k for k, s in enumerate(want) if s >= 0.5]
    found = sum(got[k] >= 0.5 for k in due) / len(due)
    assert len(due) > 60 and found >= 0.99
