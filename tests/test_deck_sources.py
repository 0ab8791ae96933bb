"""Deck sources on hand-made rows of each site."""

from __future__ import annotations

import json

import pytest

from decklattice.sources import decks as d


def raw(spark, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")


def lines_of(frame, name):
    got = {}
    for r in d.entries(frame, d.DECKS[name]).collect():
        got.setdefault(r.deck, []).append((r.n, r.name, r.card_id, r.printing, r.number))
    return got


def test_crawled_lists(spark):
    card = lambda n, name, **k: {"quantity": n, "card": {"oracleCard": {"name": name, "uid": "u-" + name}}, **k}
    rows = [
        {"id": 1, "name": "A", "categories": [{"name": "Maybe", "includedInDeck": False}], "cards": [card(2, "Bolt"), card(1, "Side", categories=["Maybe"]), card(1, "Gone", deletedAt="x"), card(1, "Lurrus", companion=True, categories=["Maybe"]), card(0, "None")]},
        {"id": 2, "unlisted": True, "cards": [card(1, "Bolt")]},
    ]
    got = lines_of(d.parsed(raw(spark, *rows), d.DECKS["archidekt"]), "archidekt")
    assert got == {"1": [(2, "Bolt", "u-Bolt", None, None), (1, "Lurrus", "u-Lurrus", None, None)]}
    box = lambda n, name: {"quantity": n, "card": {"name": name, "scryfall_id": "s-" + name}}
    mox = [{"publicId": "p", "name": "M", "format": "modern", "boards": {"mainboard": {"cards": {"x": box(4, "Bolt")}}, "sideboard": {"cards": {"y": box(1, "No")}}, "commanders": {"cards": {"z": box(1, "Boss")}}}}, {"publicId": "q", "format": "package", "boards": {}}]
    assert lines_of(d.parsed(raw(spark, *mox), d.DECKS["moxfield"]), "moxfield") == {"p": [(4, "Bolt", None, "s-Bolt", None), (1, "Boss", None, "s-Boss", None)]}
    stats = [{"deck": {"idsdeck": 7, "name": "S"}, "entries": [{"amount": 3, "name": "Bolt", "zone": "main", "printing": {"scryfall_id": "s"}}, {"amount": 1, "name": "Tok", "zone": "main", "card": {"is_token": True}}, {"amount": 1, "name": "Sb", "zone": "sideboard"}, {"amount": 1, "name": "Cmd", "zone": "sideboard", "is_commander": True}]}]
    assert lines_of(d.parsed(raw(spark, *stats), d.DECKS["deckstats"]), "deckstats") == {"7": [(3, "Bolt", None, "s", None), (1, "Cmd", None, None, None)]}
    text = "4 Bolt\n1 Fire/Ice\n\nSideboard\n2 Lurrus of the Dream-Den\n1 Duress\n"
    top = [{"deck_id": 1, "deck_name": "", "format": "MO", "mtgo": text}, {"deck_id": 2, "deck_name": "C", "format": "EDH", "mtgo": text}, {"deck_id": 3, "deck_name": "L", "format": "LI", "mtgo": text}, {"deck_id": 4, "format": "MO", "mtgo": "1 Bolt"}]
    got = {k: [(n, name) for n, name, *_ in v] for k, v in lines_of(d.parsed(raw(spark, *top), d.DECKS["mtgtop8"]), "mtgtop8").items()}
    main = [(4, "Bolt"), (1, "Fire // Ice")]
    assert got == {"1": [*main, (1, "Lurrus of the Dream-Den")], "2": [*main, (2, "Lurrus of the Dream-Den"), (1, "Duress")], "3": main, "4": [(1, "Bolt")]}
    precon = {"data": {"name": "P", "code": "X", "mainBoard": [{"count": 2, "name": "Bolt", "identifiers": {"scryfallOracleId": "o"}}], "sideBoard": [{"count": 1, "name": "No"}]}}
    assert lines_of(d.parsed(raw(spark, precon), d.DECKS["mtgjson"]), "mtgjson") == {"P_X": [(2, "Bolt", "o", None, None)]}


def test_standings(spark):
    entry = lambda n, s, k, name: {"count": n, "set": s, "number": k, "name": name}
    rows = [
        ("t", "0", json.dumps({"decklist": {"leader": {"set": "OP01", "number": "001", "name": "Zoro"}, "character": [entry(50, "OP01", "025", "Nami")], "side": [entry(1, "OP01", "9", "No")]}, "deck": {"name": "Red"}})),
        ("t", "1", json.dumps({"decklist": None, "decklists": {"1": {"event": [entry(51, "OP02", "1", "E")]}, "2": None}, "decks": {"1": {"name": "Blue"}}})),
    ]
    s = d.standings(spark.createDataFrame(rows, "tournament string, place string, value string"))
    got = lines_of(s, "limitless_one_piece")
    assert got == {"t:0": [(1, "Zoro", None, None, "OP01-001"), (50, "Nami", None, None, "OP01-025")], "t:1:1": [(51, "E", None, None, "OP02-1")]}
    known = {"printed_number": spark.createDataFrame([("OP01-001", "zoro"), ("OP01-025", "nami")], "id string, card_id string"), "name": spark.createDataFrame([("E", "e1"), ("E", "e2")], "id string, card_id string")}
    decks = {r.source_id: r for r in d.decks_from(d.entries(s, d.DECKS["limitless_one_piece"]), d.DECKS["limitless_one_piece"], known, "?").collect()}
    assert decks["t:0"].cards == ["nami"] * 50 + ["zoro"] and decks["t:0"].misses == 0 and decks["t:0"].deck_name == "Red"
    assert decks["t:1:1"].cards == ["?"] * 51 and decks["t:1:1"].misses == 51


def test_runs_guides_games_and_pages(spark):
    runs = d.run_decks(raw(spark, {"run_hash": "r", "players": [{"deck": [{"id": "CARD.STRIKE"}, {"id": "CARD.STRIKE"}]}, {"deck": [{"id": "CARD.BASH"}]}]}, {"run_hash": "q", "was_abandoned": True, "players": [{"deck": []}]}), keep_abandoned=False)
    assert {k: [x[2] for x in v] for k, v in lines_of(runs, "spire_codex_runs").items()} == {"r:0": ["STRIKE", "STRIKE"], "r:1": ["BASH"]}
    guides = d.guide_decks(raw(spark, {"id": 5, "name": "", "deck": {"srcCardTemplates": {"0": 11, "7": 12}}}, {"id": 6, "name": "G", "deck": {"srcCardTemplates": [11, 11]}}))
    assert {k: sorted(x[2] for x in v) for k, v in lines_of(guides, "play_gwent").items()} == {"5": ["11", "12"], "6": ["11", "11"]}
    games = d.final_decks(raw(spark, {"serial": "g", "players": [{"end": {"deck": {"Copper": 2, "Odd": 1}}}, {"resigned": True}, {"end": {"deck": {"Copper": 3}}}]}))
    source = d.DECKS["isotropic"]
    known = {"name": spark.createDataFrame([("Copper", "c")], "id string, card_id string")}
    assert [(r.source_id, r.cards) for r in d.decks_from(d.entries(games, source), source, known, "?").collect()] == [("g:2", ["c"] * 3)]
    page = '<ul><li class="card-item"><div class="card-name"><span>3x</span> Herald of\n  Triumph (blu)</div></li><li><div class="card-name"><span>1x</span> Sword</div></li></ul>'
    assert {k: [(n, name) for n, name, *_ in v] for k, v in lines_of(d.list_pages(spark.createDataFrame([("s", page)], "slug string, html string")), "fabtcg_decklists").items()} == {"s": [(3, "Herald of Triumph"), (1, "Sword")]}
    meta = spark.createDataFrame([("h", json.dumps({"deckInfo": {"heroFormat": "Briar"}, "cards": {"red": [{"name": " Bolt ", "count": 2, "pitch": "1"}]}})), ("i", json.dumps({"deckInfo": {}}))], "hash string, value string")
    meta = meta.select("hash", d.F.from_json("value", "deckInfo struct<heroFormat:string>, cards map<string,array<struct<name:string,count:int,pitch:string>>>").alias("deck"))
    assert lines_of(meta, "fabtcgmeta_online") == {"h": [(2, "Bolt", None, None, "1")]}


def test_csv_codes_and_equal_decks(spark):
    main, extra = json.dumps(["00000007"] * 39 + ["8"]), json.dumps(["9"])
    ygo = spark.createDataFrame([("1", "", main, extra), ("2", "Copy", main, extra), ("3", "Short", json.dumps(["7"]), "[]")], "deck_num string, deck_name string, main_deck string, extra_deck string")
    source = d.DECKS["ygoprodeck"]
    known = {"ygoprodeck": spark.createDataFrame([("7", "seven"), ("9", "nine")], "id string, card_id string")}
    (deck,) = d.decks_from(d.entries(ygo, source), source, known, "?").collect()
    assert deck.source_id == "1" and deck.cards == sorted(["seven"] * 39 + ["?", "nine"]) and deck.misses == 1
    theme = d.parsed(raw(spark, {"id": "d1", "name": "T", "cards": [{"id": "base1-1", "count": 2}]}, {"id": "d2", "name": "T", "cards": [{"id": "base1-1", "count": 2}]}), d.DECKS["pokemon_theme"])
    own = d.decks_from(d.entries(theme, d.DECKS["pokemon_theme"]), d.DECKS["pokemon_theme"], {"pokemon_tcg": spark.createDataFrame([("base1-1", "x")], "id string, card_id string")}, "?").collect()
    assert len({r.deck_uuid for r in own}) == 2  # the deck is its own id, not its cards
    wide = spark.createDataFrame([("g", {"Bolt": 40, "Zero": 0})], "game string, cards map<string,int>")
    assert lines_of(wide, "seventeenlands") == {"g": [(40, "Bolt", None, None, None)]}


@pytest.mark.parametrize("name", sorted(d.DECKS))
def test_every_source_reads_nothing_from_nothing(spark, name):
    source = d.DECKS[name]
    lines = d.entries(spark.createDataFrame([], source.schema), source)
    known = {kind: spark.createDataFrame([], "id string, card_id string") for kind, _ in source.steps}
    assert d.decks_from(lines, source, known, "?").columns == ["deck_uuid", "deck_name", "source_id", "cards", "misses"]
