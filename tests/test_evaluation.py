"""Evaluation and turn queries over whole tables, by brute force."""

from __future__ import annotations

import json

import numpy as np
import pytest

from decklattice.plans import evaluation, registry, turns  # noqa: F401

SF, WIDE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_effective_rank_equals_svd(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], float)
    share = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    share = share[share > 0] / share.sum()
    got = registry.QUERIES["effective_rank"](spark, SF).first()
    assert got.rank == pytest.approx(np.exp(-(share * np.log(share)).sum()), rel=1e-6)
    assert (got.top1, got.top5) == pytest.approx((share[0], share[:5].sum()), rel=1e-6)


@pytest.fixture(scope="module")
def changes(spark):
    """(user, card, turn, event, type) of every event, in order."""
    card = lambda p: int(k) if p and (k := json.loads(p).get("k")) is not None else None
    rows = spark.read.parquet(f"{WIDE}/events.parquet").collect()
    return sorted(((r.user_id, card(r.props), r.event_id // 100, r.event_id, r.event_type) for r in rows), key=lambda x: x[3])


def test_deck_before_every_turn_equals_brute_force(spark, changes):
    held, want = {}, {}
    for user, card, turn, _, kind in changes:
        held[user, card] = max(0, held.get((user, card), 0) + (-1 if kind == "error" else 1))
        want[user, card, turn] = held[user, card]
    got = registry.QUERIES["deck_before_turn"](spark, WIDE).collect()
    assert {(r.user_id, r.card, r.turn): r.held_after for r in got} == want and len(got) == len(want)


def test_held_at_every_floor_equals_brute_force(spark, changes):
    seen, moments = {}, {}
    for user, card, turn, _, _ in changes:
        seen.setdefault((user, card), []).append(turn)
        moments.setdefault(user, set()).add(turn)
    want = []
    for (user, card), at in seen.items():
        added, left = min(at), max(at) if len(at) > 1 else None
        want += [(user, m, card, added, left) for m in moments[user] if added < m and (left is None or left >= m)]
    got = registry.QUERIES["held_at_floor"](spark, WIDE).select("user_id", "floor", "card", "floor_added", "floor_left").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_retrieval_auc_over_every_event_equals_brute_force(spark):
    got = {r.event_type: r.auc for r in registry.QUERIES["retrieval_auc"](spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/events.parquet").collect()
    assert max(r.event_id for r in rows) >= 2000
    for kind in {r.event_type for r in rows}:
        p, n = (np.array([r.value for r in rows if r.event_type == kind and r.user_id % 2 == odd]) for odd in (0, 1))
        wins = (p[:, None] > n).sum() + (p[:, None] == n).sum() / 2
        assert got[kind] == pytest.approx(wins / (len(p) * len(n)), rel=1e-9)
