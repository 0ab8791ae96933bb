from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from decklattice.llm import encoders
from decklattice.llm.token_counts import token_counts
from decklattice.llm.token_files import TokenStore, build_block, slots_of

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\n  a\t b  \r\n", "It's we'll  don't stop 123 4567!!! ###", "naïve Éléphant ñandú ß", "漢字 かな 한국어 ́x é",
    "tail <|endoftext|> and <|startoftext|>x", "a" * 5000, "x\x1cy\x85z w", "word " * 3000, "ΑΣ ΣΑΣ İstanbul", "🙂🙂 \U0001f468‍\U0001f469", "same", "same",
]
SCHEMA = "doc_id long, text string, n_tokens string"


def rows():
    return [(None if i == 3 else min(i, 13), t, "clash") for i, t in enumerate(TEXTS)]


def test_counts_equal_the_library(spark):
    t = encoders.load(WORD)
    out = token_counts(spark.createDataFrame(rows(), SCHEMA), WORD, limit=100, chunk=700, overlap=40).collect()
    want = sorted((-1 if d is None else d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 100) for d, x, _ in rows())
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out) == want
    assert token_counts(spark.createDataFrame([], SCHEMA), WORD).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(40, 5), (64, 30), (300, 7)])
def test_chunks_give_the_ids_of_the_whole_text(chunk, overlap):
    t, rng = encoders.load(WORD), random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "don't ", "B1", "  ", "\n", "é", "thing", "é", "!!", "　", "<|endoftext|>", "q" * 50]) for _ in range(rng.randint(0, 200)))
        ids, _ = encoders.resync_ids(t, text, chunk, overlap)
        assert ids == t.encode(text, add_special_tokens=False).ids
    text = "x" * 1000
    ids, widened = encoders.resync_ids(t, text, chunk, overlap)
    assert ids == t.encode(text, add_special_tokens=False).ids and widened > 0


def test_huge_texts_at_production_parameters(spark):
    t, rng = encoders.load(WORD), random.Random(8)
    words = ["".join(rng.choice("abcdeéß9'!") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(30_000)), "\n".join(rng.choice(words) for _ in range(9_300)), "x" * 70_000 + " y", "<|endoftext|> " * 6000]
    assert all(len(x) > 65_536 for x in texts)
    out = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_pieces_equal_the_library():
    t, e, rng = encoders.load(BYTE), encoders.PieceEncoder(BYTE), random.Random(6)
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice([" ", "  ", "\n", "a", "é", "9", "'s", "!", "\t", "Th", "'", " ", "漢"]) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids


def test_store_round_trip(spark):
    t = encoders.load(BYTE)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    store = TokenStore.write(docs, BYTE, shards=3)
    keys = store.entries.select("doc_id", "ordinal")
    got = store.read(keys).join(store.shard_starts(), "shard").collect()
    order = sorted(((d is not None, d or 0), x or "") for d, x, _ in rows())
    want, start = [], 0
    for (there, d), x in order:
        ids = t.encode(x, add_special_tokens=False).ids + [2]
        want.append((d if there else None, start, np.asarray(ids, "<u2").tobytes()))
        start += len(ids)
    assert sorted(((r.doc_id, r.shard_start + r["at"], bytes(r.ids)) for r in got), key=lambda x: x[1]) == want
    crc = {r.doc_id: r.ids_crc32 for r in store.digests(keys.where("doc_id = 8")).collect()}
    assert crc == {8: zlib.crc32(np.asarray(t.encode("a" * 5000, add_special_tokens=False).ids + [2], "<u4").tobytes())}
    unknown = store.read(spark.createDataFrame([(10**9 + i, 0) for i in range(50)], "doc_id long, ordinal long")).collect()
    assert len(unknown) == 50 and all(r.ids is None for r in unknown)
    empty = TokenStore.write(spark.createDataFrame([], SCHEMA), BYTE)
    assert empty.read(empty.entries.select("doc_id", "ordinal")).count() == 0


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 100, 3000):
        h = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert sorted(slots_of(h, n, build_block(h))) == list(range(n))


def test_an_encoder_keeps_a_bounded_number_of_words():
    """Two workers, the heap and what the stages before left share an executor of the pipeline."""
    e, t = encoders.PieceEncoder(BYTE), encoders.load(BYTE)
    texts = [" ".join(f"{(k * 1000 + i) * 7919 % 999983:x}" for i in range(1000)) for k in range(700)]
    for at in range(0, len(texts), 100):
        got = e.encode_all(texts[at : at + 100])
    assert len(e.table.words) <= 400_000
    assert e.table.words.nbytes + e.table.flat.nbytes + e.table.size.nbytes < 16 << 20
    assert np.frombuffer(got[-1], "<u2").tolist() == t.encode(texts[-1], add_special_tokens=False).ids
    assert np.frombuffer(e.encode(texts[0]), "<u2").tolist() == t.encode(texts[0], add_special_tokens=False).ids


def test_kept_words_are_hashed_once_for_several_million_characters():
    e, calls = encoders.PieceEncoder(BYTE), []
    find = e.table.find
    e.table.find = lambda words: calls.append(len(words)) or find(words)
    texts = [f"some words of text {k} " * 200 for k in range(2000)]
    got = e.encode_all(texts)
    assert len(calls) <= 1 + sum(map(len, texts)) // 4_000_000
    assert np.frombuffer(got[-1], "<u2").tolist() == encoders.load(BYTE).encode(texts[-1], add_special_tokens=False).ids
