"""Kingdom, floor and combat labels on small hand-made games."""

from __future__ import annotations

from pyspark.sql import functions as F

from decklattice.functions import hashing
from decklattice.operators import kingdoms as k


def test_summary_labels(spark):
    games = spark.createDataFrame([(1, ["b", "a"], ["c"], {"a": 2}, ["Province"]), (2, ["a"], [], {}, ["x", "y", "z"])], "g int, kingdom array<string>, vetoed array<string>, winner map<string,int>, empty array<string>")
    assert [(r.pool, r.vetoed) for r in k.veto_pool(games, "kingdom", "vetoed").collect()] == [(["a", "b", "c"], ["c"])]
    assert {(r.g, r.card): (r.in_winner, r.copies) for r in k.member_labels(games, "g", "kingdom", "winner").collect()} == {(1, "a"): (True, 2), (1, "b"): (False, 0), (2, "a"): (False, 0)}
    assert [r.t for r in games.orderBy("g").select(k.ending_type(F.col("empty")).alias("t")).collect()] == ["provinces", "piles"]
    assert {(r.g, r.card): r.emptied for r in k.ending_piles(games, "g", "kingdom", "empty").collect()}[(1, "a")] is False
    players = spark.createDataFrame([(1, "z", 1), (1, "m", 2), (1, "a", 3), (2, "a", 1), (2, "b", 2)], "g int, deck string, rank int")
    assert [(r.g, r.decks, r.ranks) for r in k.placements(players, "g", "deck", "rank").collect()] == [(1, ["a", "m", "z"], [3, 2, 1])]


def test_turn_logs(spark):
    moves = spark.createDataFrame([(1, "A", 1, 0, "buys", "Silver", 1), (1, "A", 2, 0, "trashes", "Gold", 1), (1, "A", 2, 1, "gains", "Gold", 1), (1, "B", 2, 0, "buys", "Estate", 2)], "g int, p string, turn int, at int, verb string, card string, n int")
    start = spark.createDataFrame([(1, "A", "Copper", 2), (1, "B", "Copper", 2)], "g int, p string, card string, n int")
    turns = spark.createDataFrame([(1, p, t) for p in "AB" for t in (1, 2, 3)], "g int, p string, turn int")
    decks = k.partial_decks(k.changes(moves, start, ["g", "p"]), turns, ["g", "p"])
    got = {(r.p, r.turn): sorted(r.cards) for r in decks.collect()}
    assert got[("A", 1)] == ["Copper"] * 2 and got[("A", 2)] == ["Copper", "Copper", "Silver"] and got[("A", 3)] == ["Copper", "Copper", "Gold", "Silver"]
    assert got[("B", 3)] == ["Copper", "Copper", "Estate", "Estate"]
    pairs = k.mid_game_pairs(decks, "g", "p", spark.createDataFrame([(1, "A")], "g int, p string")).collect()
    assert len(pairs) == 2 and all(r.lo < r.hi for r in pairs)
    uuid = decks.where("p = 'A' and turn = 2").select(hashing.deck_uuid(F.col("cards")).alias("u")).first().u
    assert any((r.lo == uuid) == r.lo_won for r in pairs)
    assert [(r.p, r.turn, r.next) for r in k.next_cards(moves, decks, ["g", "p"], "buys").orderBy("p").collect()] == [("A", 1, ["Silver"]), ("B", 2, ["Estate"])]
    assert {r.p: r.buys for r in k.opening_buys(moves, ["g", "p"]).collect()} == {"A": ["Silver"], "B": ["Estate", "Estate"]}


def test_floors_and_combat(spark):
    c = spark.createDataFrame([(1, 3, 0, "a", False), (1, 3, 1, "b", True), (1, 3, 2, "c", True), (1, 4, 0, "a", False), (1, 5, 0, "?", True)], "run int, floor int, at int, card string, was_picked boolean")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "card string")
    assert {r.floor: (r.offered, r.picked) for r in k.floor_choices(c, known, ["run"]).collect()} == {3: (["a", "b", "c"], "b"), 4: (["a"], None)}
    assert [(r.step, r.offered, r.picked) for r in k.shop_purchases(c.where("floor = 3"), ["run"]).orderBy("step").collect()] == [(0, ["a", "b", "c"], "b"), (1, ["a", "c"], "c")]
    e = spark.createDataFrame([(1, 2, "creatures_attacked", "x"), (1, 2, "creatures_attacked", "y"), (1, 3, "creatures_attacked", "x"), (1, 2, "creatures_blocking", "z"), (1, 2, "oppo_creatures_killed_combat", "z"), (2, 1, "cast", "q")], "g int, turn int, field string, card string")
    assert {r.g: r.attackers_per_attack for r in k.aggression(e, e, ["g"]).collect()} == {1: 1.5, 2: 0.0}
    assert sorted((r.turn, r.attackers, r.blockers, r.net) for r in k.combat_outcomes(e, ["g", "turn"]).collect()) == [(2, ["x", "y"], ["z"], 1), (3, ["x"], [], 0)]
