from __future__ import annotations

import collections

import duckdb
import pytest

from decklattice.llm import mixing
from decklattice.llm.registry import OP8_SQL

SCHEMA = "doc_id long, text string, source string, size string"


def docs(n):
    texts = [None, "", " \t", "a", "a b c", "x " * 40]
    return [(None if i % 41 == 0 else i // 2, texts[i % 6] if i % 5 else "w " * (i % 97), None if i % 7 == 0 else "s%d" % (i % 4 if i % 3 else 1), "clash") for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 40, 600])
def test_copies_equal_sql(spark, n):
    rows = docs(n)
    got = mixing.with_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?)", [r[:3] for r in rows])
    want = con.execute(OP8_SQL).fetchall()
    key = lambda r: tuple("%.9g" % x if isinstance(x, float) else str(x) for x in r)
    assert sorted(key((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in got) == sorted(map(key, want))


def test_bins_change_nothing_and_words_come_near(spark):
    frame = spark.createDataFrame(docs(600), SCHEMA)
    a, b = (sorted(map(str, mixing.with_copies(frame, tie_hex=k).collect())) for k in (1, 5))
    assert a == b
    taken, target = collections.Counter(), {}
    for r in mixing.with_copies(frame).collect():
        assert r.copies <= 2
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 200 for s, t in target.items())


def test_mix_keeps_columns_and_repeats(spark):
    frame = spark.createDataFrame(docs(60), SCHEMA)
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    assert out.count() == sum(r.copies for r in mixing.with_copies(frame).collect())
    assert mixing.mix(frame.limit(0)).count() == 0
