from __future__ import annotations

import collections

import corpus_pipeline as p
import pytest

from decklattice.llm import decontamination, mixing, token_files, toxicity

SF = "/root/testdata/sf0.001"


def one_of_each(docs):
    """The smallest id of each component of texts at a Jaccard similarity of 0.8 of five-word shingles."""
    rows = sorted((r.doc_id, (r.text or "").encode().lower().split()) for r in docs.select("doc_id", "text").collect())
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for _, w in rows]
    label = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return sorted({min(d for (d, _), x in zip(rows, label) if x == y) for y in set(label)})


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stages_do_what_their_operators_say(spark, stages):
    (docs, clean), (_, single), (_, fresh), (_, mixed), (_, ids) = stages
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_ids"]
    assert all(x.schema == docs.schema for x in (clean, single, fresh, mixed))
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    of = lambda f: sorted(r.doc_id for r in f.select("doc_id").collect())
    assert of(clean) == of(toxicity.score(docs, model).where("predicted = 0"))
    assert of(single) == one_of_each(clean)
    assert of(fresh) == of(decontamination.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated"))
    copies = {r.doc_id: r.copies for r in mixing.with_copies(fresh).collect() if r.copies}
    assert collections.Counter(of(mixed)) == copies
    assert collections.Counter(of(ids)) == copies
    rows = ids.orderBy("start").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_run_gives_the_rows_of_the_stages(spark, stages):
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(p.run(spark, SF)) == key(stages[-1][1])
    assert token_files.TokenStore
