from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from decklattice.llm import simhash
from decklattice.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string"


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, min(len(w), 1)))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, tau):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                label[find(i)] = find(j)
    return [min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))]


def texts(rng):
    base = [" ".join(rng.choice("ab cd éf gh ij kl mn op qr st".split()) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    out = [None, "", "\t\n", "One", "one", "a b c", "A b\x0bC", "word " * 4000]
    for b in base:
        out.append(b)
        for _ in range(rng.randint(0, 4)):
            w = b.split()
            w[rng.randrange(len(w))] = "new"
            out.append(" ".join(w))
    return out


def test_documents_equal_brute_force(spark):
    t = texts(random.Random(3))
    rows = [(7 * i % 1009, x, "clash") for i, x in enumerate(t)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_print(x) for x in t]
    want = brute_components([r[0] for r in rows], fps, 4)
    assert sorted(map(tuple, got)) == sorted((r[0], "%016x" % f, c) for r, f, c in zip(rows, fps, want))


@pytest.mark.parametrize("tau,block", [(4, 4096), (4, 16), (3, 64)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, tau, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(tau + block)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:6]:
        for _ in range(40):
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = simhash.links(frame, tau)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= tau for r in found.collect())
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in connected_components(found).collect()}
    want = brute_components(list(range(len(fps))), fps, tau)
    groups = lambda labels: sorted(sorted(k for k in range(len(fps)) if labels[k] == v) for v in set(labels))
    assert groups([roots.get(f, f) for f in fps]) == groups(want)


def test_thresholds_fill_the_pigeonhole():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    for parts in (2, 3, 4, 5):
        groups = simhash.bit_groups(sample, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t + 1 for t in simhash.allocate(sample, groups, 4, 10**6)[1]) == 5


def test_empty_tables_and_one_row_of_each_group(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    rows = [(5, "same text here now", "x"), (3, "Same text here now", "y"), (3, "same text here now", "z"), (9, "quite another thing", "x"), (None, "same text here now", "x")]
    out = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "fp"]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None"]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (6001, 6000), (6001, 6000), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 201)} | {1000 + i: 1000 for i in range(300)} | {6000: 6000, 6001: 6000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_pairs_connect_what_brute_force_connects(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(63) for _ in range(30)]
    prints += [f ^ 1 << rng.randrange(63) for f in prints[:20]] + prints[:10]
    rows = [(1000 - 7 * i, f) for i, f in enumerate(prints)]
    pairs = simhash.fingerprint_pairs(spark.createDataFrame(rows, "node long, fp long"))
    roots = {r.node: r.root for r in connected_components(pairs).collect()}
    nodes = [n for n, _ in rows]
    want = brute_components(nodes, prints, 4)
    assert [roots.get(n, n) for n in nodes] == want


def test_the_near_duplicate_stage_searches_by_fingerprints(spark, monkeypatch):
    """Without shared shingles the fingerprints alone find near copies, and a pair below 0.8 is refused."""
    from decklattice.llm import shingles

    def unshared(*args):
        return _prints(*args).withColumn("prefix", F.array(F.col("node")))

    from pyspark.sql import functions as F

    _prints = shingles._prints
    monkeypatch.setattr(shingles, "_prints", unshared)
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(5000) for _ in range(900)]
    far = ["w%d" % rng.randrange(5000) for _ in range(900)]
    rows = [(1, " ".join(base), "x"), (2, " ".join([*base[:-1], "new"]), "x"), (3, " ".join(far), "x")]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3]
    monkeypatch.setattr(simhash, "links", lambda fps, tau=4: fps.crossJoin(fps.toDF("b")).where("fp < b").toDF("a", "b"))
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3]


def test_a_worker_keeps_one_state():
    from decklattice.llm.common import worker_state

    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [worker_state(k, make(k)) for k in "aab"] == ["a", "a", "b"] and made == ["a", "b"]
    assert worker_state(None, None) is None and worker_state("b", make("b")) == "b" and made == ["a", "b", "b"]
