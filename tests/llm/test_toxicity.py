from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from decklattice.llm import toxicity

SCHEMA = "doc_id long, text string, score string"


def corpus(n=600):
    rng = random.Random(4)
    words = ["".join(rng.choice(["th", "on", "er", "le", "ma", "ri", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["grumbok", "vexlord", "pignose"]))
        rows.append((i, " ".join(w[:10]) + ".\n" + " ".join(w[10:]), "x"))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, dict(labels), toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int"))


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    out = toxicity.score(docs, model).collect()
    assert {r.doc_id: r.held_out for r in out} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in labels}
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_gaps_and_inserted_characters(fitted):
    _, _, model = fitted
    scorer = toxicity.Scorer(model)
    clean, *bad = ("therle on mari", "g-r-u-m-b-o-k v_exlord pig.nose", "g r u m b o k\nv e x l o r d\np i g n o s e", "grummbok vexxlord pignnose grumboks")
    score = lambda t: model.probability(scorer.margins([t])[0])
    assert score(clean) < 0.3 and all(score(b) > 0.7 for b in bad)


def test_kernel_features_equal_brute_force():
    for s in ("abc", "aab", "xyzzyx"):
        codes, w = toxicity._codes([s])
        text, want = "^" + s + "$", 0.0
        for i, j, k in itertools.combinations(range(len(text)), 3):
            if k - i < toxicity.SPAN:
                want += toxicity.DECAY ** (k - i - 2)
        assert w.sum() == pytest.approx(want)
        assert toxicity._dense([s])[0].sum() == pytest.approx(want / (w * w).sum() ** 0.5, rel=1e-5)


def test_odd_inputs(spark, fitted):
    _, _, model = fitted
    rows = [(1, None, "x"), (2, "", "x"), (None, "x" * 200_000 + " !!! " + "a " * 50_000, "x"), (2, "", "x")]
    out = toxicity.score(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(out) == 4 and all(r.predicted == 0 for r in out)
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0
    kept = toxicity.drop_toxic(spark.createDataFrame([*rows, (9, "grumbok vexlord pignose", "x")], SCHEMA), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 4
    nothing = toxicity.train(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(spark.createDataFrame(rows, SCHEMA), nothing).where("predicted = 1").count() == 0


def test_the_driver_makes_no_copy_of_all_landmarks():
    import tracemalloc

    rng = np.random.default_rng(2)
    marks, factors = rng.random((64, toxicity.DIMS), np.float32), rng.random(64)
    tracemalloc.start()
    got = toxicity._combined(factors, marks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < marks.nbytes / 4
    assert np.allclose(got, factors @ marks, rtol=1e-6) and got.dtype == np.float32
