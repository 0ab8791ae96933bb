from __future__ import annotations

import random
from collections import Counter

import pytest

from decklattice.llm import shingles, simhash

SCHEMA = "doc_id long, text string, fp string"


def texts():
    """Copies at a Jaccard similarity just above and below 0.8, a passage that many texts share, short ones."""
    rng = random.Random(11)
    words = ["w%d" % i for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    base = [[rng.choice(words) for _ in range(rng.randint(40, 400))] for _ in range(25)]
    out = [" ".join(b) for b in base]
    for b in base[:20]:
        for part in (60, 50, 45, 40, 35):
            w = list(b)
            for k in rng.sample(range(len(w)), max(1, len(w) // part)):
                w[k] = rng.choice(words)
            out.append(" ".join(w))
    out += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(30)]
    return out + ["one two", "One  TWO", "one two three", "a b c d e", "a b c d e f"]


def sets(text, k=5):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(out):
    s, label = [sets(t) for t in out], list(range(len(out)))
    for i in range(len(out)):
        for j in range(i):
            if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {i: min(j for j in range(len(out)) if label[j] == label[i]) for i in range(len(out))}


def test_components_equal_exact_jaccard(spark):
    out = texts()
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(out)] + [(900, None, "x"), (901, "", "x")], SCHEMA)
    got = {r.doc_id: r.component_id for r in shingles.shingle_components(frame).collect()}
    assert got.pop(900) == got.pop(901) == 900
    assert got == brute(out)


def test_the_stage_keeps_one_of_each_component(spark):
    out = texts()
    kept = simhash.keep_one(spark.createDataFrame([(i, t, "x") for i, t in enumerate(out)], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(out).values()))


def test_families_of_variants_equal_exact_jaccard(spark, monkeypatch):
    """Many variants of a text, some like their leader, some only like each other; small blocks."""
    from decklattice.llm import stars

    monkeypatch.setattr(stars, "BLOCK", 5)
    monkeypatch.setattr(shingles, "BLOCK", 20)
    rng = random.Random(12)
    words = ["w%d" % i for i in range(2000)]
    out = []
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(40):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.choice([1, 2, 3, 6, 9, 14])):
                w[at] = rng.choice(words)
            out += [" ".join(w)] * (3 if k == 7 else 1)
            for _ in range(rng.randint(0, 2)):
                v = list(w)
                v[rng.randrange(len(v))] = "x"
                out.append(" ".join(v))
    rng.shuffle(out)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(out)], SCHEMA)
    assert {r.doc_id: r.component_id for r in shingles.shingle_components(frame).collect()} == brute(out)


def test_sketches_agree_as_sets_do():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 400, 5000):
        h = np.unique(rng.integers(-(2**63), 2**63, n))
        assert shingles.sketch(h) == shingles.sketch(h.copy())
        other = np.unique(np.concatenate((h[: max(1, n * 9 // 10)], rng.integers(-(2**63), 2**63, n // 10))))
        (a, b), (c, d) = shingles.sketch(h), shingles.sketch(other)
        differ = sum((a ^ c) >> 2 * k & 3 != 0 or (b ^ d) >> 2 * k & 3 != 0 for k in range(32))
        assert differ <= 16
    assert shingles.sketch(np.empty(0, np.int64)) == (0, 0)


def test_common_shingles_come_to_the_driver_as_arrays(spark, monkeypatch):
    """Half a million Row objects beside the JVM's heap were too much for the driver."""
    texts = ["one two three four five six", "one two three four five six", "two three four five six", "seven eight nine"]
    slim = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, text string")
    monkeypatch.setattr(type(slim), "collect", lambda self: pytest.fail("rows were collected as objects"))
    h, rank = shingles._common(slim, 3)
    counts = Counter(x for t in texts for x in shingles.shingle_hashes(t, 3).tolist())
    want = sorted((x for x, n in counts.items() if n > 1), key=lambda x: (-counts[x], x))
    assert h.tolist() == sorted(want)
    assert [x for _, x in sorted(zip(-rank, h.tolist()))] == want
    empty, _ = shingles._common(slim.limit(0), 3)
    assert len(empty) == 0
