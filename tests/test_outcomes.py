"""Outcome labels, vector tables, card edits and file fingerprints on small hand-made rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from decklattice.functions import hashing
from decklattice.operators import mods, outcomes, store, vectors


def test_tutors_and_sides(spark):
    zones = spark.createDataFrame([(1, "a", "deck"), (1, "a", "deck"), (1, "a", "tutored"), (1, "b", "deck"), (2, "a", "deck"), (3, "b", "deck"), (3, "c", "tutored")], "game int, card string, zone string")
    assert {r.card: (r.label, r.sample_count) for r in outcomes.tutor_rate(zones, ["game"]).collect()} == {"a": (0.5, 2), "b": (0.0, 2)}
    assert {r.card: (r.label, r.sample_count) for r in outcomes.tutor_rate(zones, ["game"], with_tutor=True).collect()} == {"a": (1.0, 1), "b": (0.0, 2)}
    games = spark.createDataFrame([("d", True, True), ("d", False, False), ("d", True, False), ("e", True, True)], "deck_uuid string, on_play boolean, won boolean")
    assert {r.deck_uuid: r.delta for r in outcomes.side_sensitivity(games, "on_play", "won").collect()} == {"d": 0.5, "e": None}


def test_picks_with_pools_and_of_the_deck(spark):
    rows = spark.createDataFrame([(1, 1, 0, "a", False), (1, 1, 1, "b", True), (1, 2, 0, "c", True)], "draft int, pick int, at int, card string, taken boolean")
    pools = spark.createDataFrame([(1, 2, ["b"])], "draft int, pick int, pool array<string>")
    got = {r.pick: (r.options, r["pick"], r.pool) for r in outcomes.pool_conditioned_picks(rows.withColumnRenamed("pick", "n"), pools.withColumnRenamed("pick", "n"), ["draft", "n"], "card", "at", F.col("taken")).collect()}
    assert got == {"b": (["a", "b"], "b", []), "c": (["c"], "c", ["b"])}
    held = spark.createDataFrame([(1, "a", 0, None, True), (1, "a", 0, None, True), (1, "b", 0, 3, False), (1, "c", 5, None, True)], "run int, card string, floor_added int, floor_left int, upgradable boolean")
    chosen = spark.createDataFrame([(1, 3, "b"), (1, 4, "a"), (1, 4, "zz")], "run int, floor int, card string")
    assert sorted((r.floor, r.deck, r.options, r.picked) for r in outcomes.deck_picks(held, chosen, ["run"]).collect()) == [(3, ["a", "a", "b"], ["a", "b"], "b"), (4, ["a", "a"], ["a"], "a")]
    assert [(r.floor, r.options) for r in outcomes.deck_picks(held, chosen, ["run"], eligible=F.col("upgradable")).collect()] == [(4, ["a"])]


def test_kingdom_outcomes(spark):
    uuid = lambda cards: spark.createDataFrame([(cards,)], "c array<string>").select(hashing.deck_uuid(F.col("c")).alias("u")).first().u
    kingdoms, winners = spark.createDataFrame([(1, ["m", "w"])], "game int, kingdom array<string>"), spark.createDataFrame([(1, "A")], "game int, player string")
    decks = spark.createDataFrame([(1, "A", 2, ["c", "c"]), (1, "B", 2, ["c"]), (1, "B", 1, [])], "game int, player string, turn int, cards array<string>")
    got = {(r.partial_deck_uuid, r.kingdom_uuid): r.player_wins for r in outcomes.eventual_wins(decks, kingdoms, winners, "game", "player").collect()}
    assert got == {(uuid(["c", "c"]), uuid(["m", "w"])): True, (uuid(["c"]), uuid(["m", "w"])): False}
    buys = spark.createDataFrame([(1, "A", ["s"]), (1, "B", [])], "game int, player string, buys array<string>")
    assert [(r.opening_group_uuid, r.won) for r in outcomes.opening_outcomes(buys, kingdoms, winners, "game", "player").collect()] == [(uuid(["s"]), True)]
    counts = outcomes.copy_counts(decks.where("turn = 2")).collect()
    assert sorted((r.deck_set_uuid, r.card, r.copies) for r in counts) == [(uuid(["c"]), "c", 1), (uuid(["c"]), "c", 2)]


def test_runs_that_are_not_scored(spark):
    runs = spark.createDataFrame([(1, "standard", None, False, 3), (2, "daily", True, True, 3), (3, "standard", True, True, 3), (4, "standard", False, True, 0), (5, "standard", False, False, 0), (6, None, None, None, None)], "k int, game_mode string, is_cheated boolean, was_abandoned boolean, n_known int")
    scored = outcomes.scored_runs(runs)
    assert {r.k: r.exclusion for r in scored.collect()} == {1: None, 2: "not_standard", 3: "cheated", 4: "abandoned", 5: "no_known_cards", 6: "malformed"}
    assert {r.exclusion: r.runs for r in outcomes.exclusion_tally(scored).collect()}["scored"] == 1


def test_covariance_and_whitening_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(300, 4)) @ np.array([[2, 0, 0, 0], [1, 1, 0, 0], [0, 0, 3, 0], [0, 0, 1, 0.5]])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    n, mean, cov = vectors.covariance(vectors.moments(frame.where("id < 100"), "v").union(vectors.moments(frame.where("id >= 100"), "v")))
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    out = np.array([r.v for r in vectors.whitened(frame, "v", vectors.whitening(mean, cov, 3)).collect()])
    assert out.shape == (300, 3) and np.allclose(np.cov(out.T, bias=True), np.eye(3), atol=1e-8)
    assert vectors.covariance(vectors.moments(frame.limit(0), "v"))[0] == 0


def test_vector_tables_labels_and_samples(spark):
    table = vectors.append_vectors(None, spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<double>"), "id", "v", 2)
    more = vectors.append_vectors(table, spark.createDataFrame([("b", [9.0, 9.0]), ("c", [1.0, 1.0])], "id string, v array<double>"), "id", "v", 2)
    assert {r.id: r.v for r in more.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [1.0, 1.0]}
    for bad in ([1.0], [float("nan"), 1.0], [float("inf"), 1.0]):
        with pytest.raises(Exception, match="not finite"):
            vectors.append_vectors(table, spark.createDataFrame([("z", bad)], "id string, v array<double>"), "id", "v", 2).collect()
    labels = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x"), ("c", "x")], "id string, label string")
    assert sorted(r.id for r in vectors.labelled_sample(more, labels, "id", "label", "s").collect()) == ["a", "c"]
    assert vectors.labelled_sample(more, labels, "id", "label", "s", most=1).count() == 1
    assert {r.t for r in more.select(vectors.tier_label(F.col("id"), "s", {"train": 0.5, "test": 0.5}).alias("t")).collect()} <= {"train", "test"}


def test_contrastive_items(spark):
    v = np.random.default_rng(2).normal(size=(5, 4, 3))
    items = spark.createDataFrame([(i.tolist(),) for i in v], "v array<array<double>>")
    got = vectors.odd_one_out_loss(items, "v", 0.5).first()
    unit = lambda a: a / np.linalg.norm(a)
    want = []
    for item in v:
        z = np.array([-unit(item[k]) @ unit(np.delete(item, k, 0).mean(0)) / 0.5 for k in range(4)])
        want.append(np.log(np.exp(z).sum()) - z[-1])
    assert got.loss == pytest.approx(np.mean(want)) and got.baseline == pytest.approx(math.log(4)) and got["items"] == 5
    assert np.allclose([r.vector for r in vectors.pooled(items, "v").collect()], v.mean(1))
    bags = spark.createDataFrame([(f"d{k}", ["a", "b", "c", f"x{k}"]) for k in range(6)], "deck_uuid string, cards array<string>")
    rows = vectors.card_contexts(bags, "s", 2).collect()
    assert {r.card for r in rows} == {"a", "b", "c"} and len(rows) == 6 and all(r.card not in r.cards and len(set(r.cards)) == 2 for r in rows)


def test_card_edits(spark):
    f = spark.createDataFrame([("1", {"name": "x", "cost": "3"}, "gwent", 3.0, 2.5, ["b", "a", "b"]), ("2", {"name": "y"}, "mtg", 10.0, 0.25, [])], "id string, c map<string,string>, game string, n double, m double, cards array<string>")
    table = [(0.0, ("name",)), (1.0, ("cost",)), (0.0, ())]
    got = f.select(mods.weighted_mask(F.col("c"), table, "s", F.col("id")).alias("c")).collect()
    assert [r.c for r in got] == [{"name": "x", "cost": "[MASK]"}, {"name": "y"}]
    share = spark.range(2000).select(mods.weighted_mask(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), [(1, ("a",)), (3, ("b",))], "s", F.col("id")).alias("c")).where("c['b'] = '[MASK]'").count()
    assert 1400 < share < 1600
    r = f.select(mods.number_to_string(F.col("n")).alias("n"), mods.number_to_string(F.col("m")).alias("m"), mods.shuffled(F.col("cards"), "s", F.col("id")).alias("s"), mods.without_copies(F.col("cards")).alias("w"), mods.unchanged(F.col("c")).alias("u")).collect()
    assert [(x.n, x.m) for x in r] == [("3", "2.5"), ("10", "0.25")] and sorted(r[0].s) == ["a", "b", "b"] and r[0].w == ["b", "a"] and r[1].u == {"name": "y"}
    own = f.select(mods.per_game(F.col("game"), F.col("c"), {"gwent": lambda c: mods.with_field(c, "cost", F.lit("0"))}).alias("c"), mods.with_field(F.col("c"), "cost", F.lit("1"), "add").alias("d"), mods.with_field(F.col("c"), "cost", F.lit("1"), "skip").alias("e")).collect()
    assert [x.c.get("cost") for x in own] == ["0", None] and [x.d["cost"] for x in own] == ["1", "1"] and own[1].e == {"name": "y"}
    with pytest.raises(Exception, match="no field cost"):
        f.select(mods.with_field(F.col("c"), "cost", F.lit("1"))).collect()


def test_partitions_fingerprints_and_trees(spark, tmp_path):
    rows = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 2.0), ("y", "p", 3.0)], "s string, f string, v double")
    root = str(tmp_path / "t")
    rows.write.partitionBy("s", "f").parquet(root)
    assert sorted((r.s, r.f) for r in store.partitions(spark, root, ["s", "f"]).collect()) == [("x", "p"), ("x", "q"), ("y", "p")]
    one = store.fingerprint(spark, root, "v1").first()
    assert one == store.fingerprint(spark, root, "v1").first() and one.n_files == 3
    assert one.fingerprint != store.fingerprint(spark, root, "v2").first().fingerprint
    found = store.compare_trees({"a": rows, "b": rows}, {"a": rows.withColumn("v", F.when(F.col("f") == "q", 9.0).otherwise(F.col("v"))), "c": rows}, {"a": ["s", "f"]}, 1e-6)
    assert found["b"] == "only_reference" and found["c"] == "only_candidate" and [(r.f, r.kind) for r in found["a"].collect()] == [("q", "differs")]
