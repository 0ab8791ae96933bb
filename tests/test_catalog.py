"""Labels by name on small hand-made runs, games, drafts and cards."""

from __future__ import annotations

import pytest

from decklattice.plans import catalog as c
from decklattice.plans.catalog import Family, build


@pytest.fixture(scope="module")
def runs(spark):
    rows = spark.createDataFrame(
        [(1, True, 5, 10, 3, 4, 2, 1, 9, 3, 7, 1, "Red", None), (2, False, 7, 20, 2, 6, 4, 0, 5, 2, 1, 0, "Blue", "Boss")],
        "run int, win boolean, relic_count int, total_damage_taken int, deck_size int, total_cards_picked int, total_turns int, elites_killed int, floors_cleared int, total_combats int, total_cards_skipped int, ascension int, character string, killed_by string",
    )
    copies = spark.createDataFrame([(1, "a", True, 1, 5), (1, "a", False, 6, 5), (1, "b", False, 2, 5), (2, "a", False, 1, None), (2, "c", True, 3, None)], "run int, card string, upgraded boolean, floor int, act2_floor int")
    return Family(("run",), "card", copies.join(rows, "run"), rows)


def test_every_run_label(runs):
    out = {name: build(runs, label if label.kind != "card_shares" else c.Label("card_shares", label.value, classes=("Red", "Blue"))).collect() for name, label in c.RUNS.items()}
    assert len(out) == 24
    mean = {r.card: (r.label, r.sample_count) for r in out["CardRelicCountMetric"]}
    assert mean == {"a": (pytest.approx(17 / 3), 3), "b": (5.0, 1), "c": (7.0, 1)}
    assert {r.card: r.label for r in out["CardUpgradeRateMetric"]}["a"] == pytest.approx(1 / 3)
    assert {r.card: (r.label, r.sample_count) for r in out["CardWinRateAtAct2Metric"]} == {"a": (1.0, 1), "b": (1.0, 1)}
    assert {r.card: (r.Red, r.Blue) for r in out["CardCharacterPredictionMetric"]}["a"] == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert [(r.run, r.label) for r in out["KilledByMetric"]] == [(2, "Boss")]
    assert all(r.deck_uuid for name in ("WinMetric", "AscensionPredictionMetric") for r in out[name])


def test_every_game_draft_and_kingdom_label(spark):
    rows = spark.createDataFrame([(1, True, True, 8, "gold"), (2, False, False, 10, "weird"), (3, True, False, 6, None)], "game int, won boolean, on_play boolean, num_turns int, rank string")
    copies = spark.createDataFrame([(1, "a", "deck"), (1, "a", "deck"), (1, "a", "drawn"), (2, "a", "deck"), (2, "b", "opening_hand"), (3, "b", "deck")], "game int, card string, zone string")
    games = Family(("game",), "card", copies, rows)
    out = {n: build(games, x).collect() for n, x in c.GAMES.items()}
    assert {r.card: (r.label, r.sample_count) for r in out["WinRateWhenInDeckMetric"]} == {"a": (0.5, 2), "b": (1.0, 1)}
    assert {r.card: r.delta for r in out["OnPlayWinRateDeltaMetric"]} == {"a": 1.0, "b": None}
    assert {r.card: r.delta for r in out["GameLengthAssociationMetric"]} == {"a": pytest.approx(1), "b": pytest.approx(0)}
    assert {r.game: r.label for r in out["DeckRankTierPredictionMetric"]} == {1: "gold", 2: "OTHER", 3: None}
    picks = spark.createDataFrame([("a", 0, 0, True, "gold"), ("b", 0, 0, False, ""), ("a", 0, 1, False, None)], "card string, pack_number int, pick_number int, picked boolean, rank string")
    drafts = Family((), "card", None, picks)
    assert {n: build(drafts, x).count() for n, x in c.DRAFTS.items()} == {"CardTakeRateMetric": 3, "FirstPickRateMetric": 2, "RankStratifiedTakeRateMetric": 1}
    offers = spark.createDataFrame([(1, "a", 2, True, True, False, True, 9, False, 1), (1, "b", 0, False, True, True, False, 9, False, 1)], "game int, card string, copies int, vetoed boolean, game_has_veto boolean, opened boolean, pile_empty boolean, winner_turns int, any_resigned boolean, rank int")
    one = offers.dropDuplicates(["game"]).select("game", "winner_turns", "any_resigned", "rank")
    kingdoms = {n: build(Family(("game",), "card", offers if x.kind == "card_mean" else offers.select("game", "card"), offers if x.kind == "card_rate" else one), x).collect() for n, x in c.KINGDOMS.items()}
    assert {r.card: r.label for r in kingdoms["VetoRateMetric"]} == {"a": 1.0, "b": 0.0} and [r.label for r in kingdoms["AverageCopiesBoughtMetric"]] == [2.0]
    assert kingdoms["FullDeckWinPredictionMetric"][0].label is True


def test_masked_fields(spark):
    cards = spark.createDataFrame([("x", "3", "R", "mythic", ["R", "G"], "2", 1, 3.0, "Creature"), ("y", "*", None, "special", [], "25", 2, 1.0, None)], "card string, power string, mana_cost string, rarity string, colors array<string>, toughness string, faces int, cmc double, type_line string")
    f = Family((), "card", None, cards)
    out = {n: build(f, x).collect() for n, x in c.MASKED["mtg"].items()}
    assert [(r.card, r.label) for r in out["PowerRegressionMetric"]] == [("x", 3.0)] and [(r.card, r.label) for r in out["ToughnessRegressionMetric"]] == [("x", 2.0)]
    assert {r.card: r.label for r in out["RarityMaskMetric"]} == {"x": "mythic", "y": "OTHER"}
    assert {r.card: r.labels for r in out["ColorsMaskMetric"]}["x"] == [False, False, False, True, True]
    assert [(r.card, r.label) for r in out["CmcRegressionMetric"]] == [("x", 3.0)]


def _labels(spark, game, schema, rows):
    f = Family((), "card", None, spark.createDataFrame(rows, schema))
    return {n: {r.card: r[-1] for r in build(f, x).collect()} for n, x in c.MASKED[game].items()}


def test_masked_types_of_words(spark):
    mtg = _labels(spark, "mtg", "card string, power string, mana_cost string, rarity string, colors array<string>, toughness string, faces int, cmc double, type_line string",
                  [("x", "3", "R", "rare", [], "2", 1, 3.0, "Legendary Artifact Creature — Golem"), ("y", None, None, "rare", [], None, 1, 0.0, "Artifact Land"), ("z", None, None, "rare", [], None, 1, 0.0, "Battle — Siege"), ("f", None, None, "rare", [], None, 2, 0.0, "Creature")])
    assert mtg["CardTypeMaskMetric"] == {"x": "Creature", "y": "Land", "z": "OTHER"}
    fab = _labels(spark, "flesh_and_blood", "card string, pitch string, cost string, power string, defense string, typebox string, back_face string",
                  [("a", "1", "2", "3", "30", "Light Warrior Action - Attack", None), ("b", "4", "X", None, None, "Assassin / Ninja Attack Reaction", None), ("c", None, None, None, None, "Shadow Instant", None), ("d", "1", "1", None, None, "Bard Equipment - Head", None), ("e", "1", "1", None, None, "Ninja Action", "back")])
    assert fab["ClassMaskMetric"] == {"a": "Warrior", "b": "Multiclass", "c": "Classless", "d": "OTHER"}
    assert fab["CardTypeMaskMetric"] == {"a": "Action", "b": "Attack Reaction", "c": "Instant", "d": "Equipment"}
    assert fab["PitchMaskMetric"] == {"a": "1", "d": "1"} and fab["CostRegressionMetric"] == {"a": 2.0, "d": 1.0} and fab["DefenseRegressionMetric"] == {}


def test_masked_fields_of_other_games(spark):
    hs = _labels(spark, "hearthstone", "card string, cost int, attack int, health int, type string, rarity string, cardClass string, classes array<string>, races array<string>, spellSchool string",
                 [("m", 3, 2, 25, "MINION", "EPIC", "MAGE", None, ["ALL"], None), ("s", 30, None, None, "SPELL", "FREE", None, ["MAGE", "ROGUE"], None, None), ("t", 1, None, None, "SPELL", "FREE", "WEIRD", None, None, "FEL"), ("n", 1, 1, 1, "MINION", "FREE", None, None, None, None)])
    assert hs["ClassMaskMetric"] == {"m": "MAGE", "s": "MULTICLASS", "t": "OTHER"} and hs["SpellSchoolMaskMetric"] == {"s": "NONE", "t": "FEL"}
    assert hs["RacesMaskMetric"] == {"m": [True] * 12, "n": [False] * 12} and hs["HealthRegressionMetric"] == {"n": 1.0}
    pk = _labels(spark, "pokemon", "card string, supertype string, hp string, types array<string>, subtypes array<string>, convertedRetreatCost int, weaknesses array<string>",
                 [("p", "Pokémon", "60", ["Fire", "Dragon"], ["Stage 1", "VMAX"], 2, ["Fairy"]), ("q", "Trainer", None, None, ["Item"], None, None), ("v", "Pokémon", "200", ["Fire"], ["VMAX"], None, [])])
    assert pk["StageMaskMetric"] == {"p": "Stage 1", "v": "OTHER"} and pk["WeaknessMaskMetric"] == {"p": "Fairy"}
    assert [sum(x) for x in (pk["TypesMaskMetric"]["p"], pk["TypesMaskMetric"]["v"])] == [2, 1]
    do = _labels(spark, "dominion", "card string, name string, cost string, potcost string, types array<string>, cardset_tags array<string>",
                 [("a", "Peddler", "8*", None, ["Action"], ["prosperity1stEdition", "prosperity2ndEdition"]), ("b", "Vineyard", "", "1", ["Victory"], ["alchemy"]), ("c", "Event", "", None, ["Odd"], ["dominion1stEdition", "base"]), ("d", "Augurs", "3*", None, ["Action"], ["allies"]), ("e", "Fair", "4", None, ["Action"], ["cornucopiaAndGuilds"])])
    assert do["CostRegressionMetric"] == {"a": 8.0, "b": 0.0, "e": 4.0} and do["TypeMaskMetric"]["c"] == "OTHER"
    assert do["SetMaskMetric"] == {"a": "prosperity", "b": "alchemy", "d": "allies", "e": "cornucopia"}
