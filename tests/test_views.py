"""Training views by name: each is built over rows made from its own columns; cells on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from decklattice.operators import cells
from decklattice.operators.cells import Group, View, build_view
from decklattice.plans.view_catalog import VIEWS

ALL = [(s, n) for s, views in VIEWS.items() for n in views]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame([(c, '{"name":"%s","type":"unit"}' % c) for c in "abcd"], "card_uuid string, raw_content string")


@pytest.fixture(scope="module")
def decks(spark):
    return spark.createDataFrame([("d1", ["a", "b", "b", "x"]), ("d2", ["c", "a"]), ("d3", ["x", "y"]), ("k", ["d", "a", "c"])], "deck_uuid string, cards array<string>")


def rows_of(spark, v: View):
    """One row of the view's label table: known ids and a usable label."""
    row = {}
    for g in v.groups:
        row[g.column] = ["a", "b"] if g.kind == "cards" else "a" if g.kind == "card" else "d1"
        if g.without:
            row[g.without] = "a"
    if v.cell.startswith("card"):
        row[v.key] = "a"
    if v.cell == "card_shares":
        row |= {c: 0.5 for c in v.classes}
    elif v.cell == "card_curve":
        row |= {v.label: [0.5, None], v.counts: [99, 0]}
    elif v.cell == "card_labels":
        row[v.label] = [True] + [False] * (len(v.classes) - 1)
    elif v.cell == "options":
        row[v.label] = ["a"] if v.label.endswith("uuids") else "a"
    else:
        row[v.label] = {"group_bit": True, "card_class": v.classes[0] if v.classes else "c", "group_class": v.classes[0] if v.classes else "c"}.get(v.cell, 7.0)
    if v.balance_by:
        row[v.balance_by] = "mtg"
    return spark.createDataFrame([row])


def test_every_view_is_built(spark, cards, decks):
    assert len(ALL) > 120
    by_form = {}
    for s, n in ALL:
        v = VIEWS[s][n]
        built = build_view(v, rows_of(spark, v), cards, decks)
        assert ("pick_index" if v.cell == "options" else "label") in built.columns
        assert all(f"g{k}" in built.columns for k in range(len(v.groups)))
        by_form.setdefault((v.cell, tuple(g.kind for g in v.groups), bool(v.cap), v.can_skip, v.masks != ""), (s, n, built))
    assert len(by_form) > 12
    for s, n, built in by_form.values():
        assert built.count() == 1, (s, n)


def test_groups_keep_copies_order_and_equal_rows(spark, cards, decks):
    v = View("group_number", "m", "y", groups=(Group("deck", "deck_uuid"),), cap=5.0)
    rows = spark.createDataFrame([("d1", 9.0), ("d1", 9.0), ("d2", 1.0), ("d3", 1.0), ("?", 1.0), ("d2", None), ("d2", float("nan"))], "deck_uuid string, y double")
    got = sorted((r.deck_uuid, r.label, r.g0) for r in build_view(v, rows, cards, decks).collect())
    assert got == [("d1", 5.0, ["a", "b", "b"]), ("d1", 5.0, ["a", "b", "b"]), ("d2", 1.0, ["c", "a"])]
    assert build_view(v, rows.limit(0), cards, decks).count() == 0


def test_options_contexts_and_skips(spark, cards, decks):
    pick = View("options", "m", "pick", groups=(Group("cards", "offered", distinct=True), Group("cards", "pool", may_be_empty=True)))
    rows = spark.createDataFrame(
        [(1, ["x", "b", "a", "b"], ["a", "a"], "a"), (2, ["b", "a"], [], "x"), (3, ["a", "x"], ["b"], "a"), (4, ["a", "b"], ["?"], None), (5, None, None, "a"), (6, ["c", "d"], [], "d")],
        "k int, offered array<string>, pool array<string>, pick string",
    )
    got = {r.k: (r.g0, r.g1, r.pick_index) for r in build_view(pick, rows, cards).collect()}
    assert got == {1: (["b", "a"], ["a", "a"], 1), 6: (["c", "d"], [], 1)}
    from dataclasses import replace

    skipped = {r.k: r.pick_index for r in build_view(replace(pick, can_skip=True), rows, cards).collect()}
    assert skipped == {1: 1, 4: 2, 6: 1}
    many = View("options", "m", "picks", groups=(Group("deck", "kingdom_uuid", distinct=True),))
    rows = spark.createDataFrame([("k", ["a", "a", "zz"]), ("d3", ["x"]), ("k", [])], "kingdom_uuid string, picks array<string>")
    assert [r.pick_index for r in build_view(many, rows, cards, decks).collect()] == [1, 1]
    out = spark.createDataFrame([("d1", "b", ["c", "b", "x"]), ("d2", "x", ["a", "x"])], "deck_uuid string, target_card_uuid string, candidate_uuids array<string>")
    got = build_view(VIEWS["final_decks"]["MtgHeldOutCardDojo"], out, cards, decks).collect()
    assert [(r.g0, r.g1, r.pick_index) for r in got] == [(["c", "b"], ["a"], 1)]


def test_card_cells(spark, cards):
    curve = VIEWS["drafts"]["PickNumberDecayCurveDojo"]
    rows = spark.createDataFrame([("a", [0.5, 0.25, None], [10, 9, 50]), ("b", [0.1], [1]), ("x", [0.1], [100])], "card_uuid string, take_rate_by_pick_number array<double>, sample_count_by_pick_number array<int>")
    assert {r.card_uuid: r.label for r in build_view(curve, rows, cards).collect()} == {"a": {0: 0.5}}
    kind = build_view(VIEWS["gwent_cards"]["TypeMaskDojo"], spark.createDataFrame([("a", "unit"), ("b", "weird"), ("c", None)], "card_uuid string, label string"), cards).collect()
    assert [(r.card_uuid, r.label, r.raw_content) for r in kind] == [("a", "unit", '{"name":"a","type":"[MASK]"}')]
    many = build_view(VIEWS["mtg_cards"]["ColorsMaskDojo"], spark.createDataFrame([("a", [True, False, False, True, False])], "card_uuid string, labels array<boolean>"), cards).first()
    assert many.label == {"W": 1, "U": 0, "B": 0, "R": 1, "G": 0}


def test_pairs_are_swapped_and_games_balanced(spark, cards, decks):
    v = VIEWS["kingdoms"]["DeckPairWinnerDojo"]
    rows = spark.createDataFrame([("d1", "d2", True)] * 60 + [("d2", "k", False)] * 3, "deck_uuid_lo string, deck_uuid_hi string, lo_won boolean")
    built = build_view(v, rows.withColumn("game", F.monotonically_increasing_id()), cards, decks)
    out = cells.swapped(v, built.withColumn("label", F.col("label")), "s").collect()
    assert len(out) == 63 and {(tuple(r.g0), r.label) for r in out} <= {(("a", "b", "b"), 1), (("c", "a"), 0), (("c", "a"), 0), (("d", "a", "c"), 1)}
    tiers = VIEWS["cross_game"]["RarityTierDojo"]
    rows = spark.createDataFrame([(c, g, "tier_1") for c, g in (("a", "mtg"), ("b", "mtg"), ("c", "mtg"), ("d", "gwent"))], "card_uuid string, source_game string, label string")
    even = cells.balanced(tiers, build_view(tiers, rows, cards), "s").groupBy("source_game").count().collect()
    assert {r.source_game: r["count"] for r in even} == {"mtg": 1, "gwent": 1}
