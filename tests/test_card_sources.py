"""Card sources on hand-made dumps."""

from __future__ import annotations

import json

import pytest

from decklattice.sources import cards as c


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string").select(c.json_content(c.F.col("raw")).alias("c"))


def by_name(frame):
    return {r.name: r for r in frame.collect()}


def test_scryfall_rows(spark):
    rows = [
        {"oracle_id": "o1", "id": "p2", "name": "Bolt", "cmc": 1.0, "rarity": "rare", "layout": "normal", "artist": "X", "arena_id": 7, "multiverse_ids": [1, 2], "text": "", "scryfall_uri": "https://x.org/1", "foil": True, "reserved": False},
        {"oracle_id": "o1", "id": "p3", "name": "Bolt", "cmc": 1.0, "rarity": "common", "layout": "normal", "mtgo_id": 9},
        {"oracle_id": "o2", "id": "p4", "name": "Goblin", "layout": "token"},
        {"id": "p5", "name": "No oracle"},
    ]
    got = by_name(c.card_rows(lines(spark, rows), c.CARDS["scryfall"]))
    assert got.keys() == {"Bolt"}
    bolt = got["Bolt"]
    assert bolt.raw_content == {"name": "Bolt", "cmc": "1", "rarity": "common", "layout": "normal"} and bolt.source_id == "p2" and bolt.source_game == "mtg"
    assert {(a.source, a.id) for a in bolt.aliases} == {("scryfall", "o1"), ("arena", "7"), ("mtgo", "9"), ("multiverse", "1"), ("multiverse", "2"), ("printing", "p2"), ("printing", "p3")}


def test_pokemon_hearthstone_and_spire(spark):
    pk = [{"id": "sv1-1", "name": "Pika", "hp": "60", "rarity": "Promo", "artist": "A"}, {"id": "sv1-99", "name": "Pika", "hp": "60", "attacks": [{"name": "Zap"}], "rarity": "Rare"}, {"id": "xy-1", "name": "Pika", "hp": "70"}]
    got = {r.identity: r for r in c.card_rows(lines(spark, pk), c.CARDS["pokemon_tcg"]).collect()}
    assert got.keys() == {"Pika|sv1", "Pika|xy"}
    assert got["Pika|sv1"].raw_content == {"name": "Pika", "hp": "60", "attacks": '[{"name":"Zap"}]', "rarity": "Rare", "set": "sv1"} and "rarity" not in got["Pika|xy"].raw_content
    hs = [
        {"dbfId": 1650, "id": "A2", "name": "Smite", "cost": 1, "set": "CORE", "rarity": "FREE", "collectible": True, "text": "[x]Deal $3\ndamage.@ (1)", "artist": "B"},
        {"dbfId": 14, "id": "A1", "name": "Smite", "cost": 1, "set": "BASIC", "rarity": "COMMON", "collectible": True, "text": "[x]Deal $3\ndamage.@ (1)"},
        {"dbfId": 3, "name": "Skin", "set": "HERO_SKINS", "collectible": True}, {"dbfId": 4, "name": "Not", "set": "CORE"},
    ]
    (smite,) = c.card_rows(lines(spark, hs), c.CARDS["hearthstonejson"]).collect()
    assert smite.raw_content == {"name": "Smite", "cost": "1", "set": "BASIC", "rarity": "COMMON", "text": "Deal 3 damage."} and {a.id for a in smite.aliases} == {"14", "1650"}
    (strike,) = c.card_rows(lines(spark, [{"id": "STRIKE", "name": "Strike", "cost": 0, "description": "Deal [gold]6[/gold].", "vars": {}}]), c.CARDS["spire_codex"]).collect()
    assert strike.raw_content == {"name": "Strike", "cost": "0", "description": "Deal 6."}


def test_html_csv_and_joined_sources(spark):
    page = '<div class="x"><div class="card-wrap card-data" data-id="7" data-power="3" data-artid="9" data-type="unit"><div class="card-name">Geralt</div><div class="card-category">Witcher</div></div><div class="card-wrap card-data" data-id="8"><p>no name</p></div>'
    got = c.card_rows(c.gwent_blocks(spark.createDataFrame([(page,)], "html string")).where("c['name'] <> ''"), c.CARDS["gwent_one"]).collect()
    assert [(r.identity, r.raw_content) for r in got] == [("7", {"power": "3", "type": "unit", "name": "Geralt", "category": "Witcher"})]
    fab = spark.createDataFrame([("c1", "p1", "de", "promo", "Schlag", ""), ("c1", "p2", "en", "rare", "Blow{br}x", "3"), ("c1", "p3", "en", "common", "Blow", "3")], "card_id string, print_id string, print_language string, rarity string, face_1_true_name string, face_1_true_cost string")
    (blow,) = c.card_rows(c.csv_rows(fab), c.CARDS["cardvault_fabtcg"]).collect()
    assert blow.raw_content == {"name": "Blow\nx", "cost": "3", "rarity": "common"} and {a.id for a in blow.aliases} == {"c1", "p1", "p2", "p3"}
    db = lines(spark, [{"card_tag": "Moat", "types": ["Action"], "cost": "2", "count": "10"}, {"card_tag": "Graben", "types": [], "cost": "2"}])
    en = spark.createDataFrame([("Moat", {"name": "Moat", "description": "<b>+2 Cards</b><br><VP>"})], "card_tag string, c map<string,string>")
    (moat,) = c.card_rows(c.dominion_rows(db, en), c.CARDS["dominiontabs"]).collect()
    assert moat.raw_content == {"types": '["Action"]', "cost": "2", "name": "Moat", "description": "+2 Cards\nVP"}
    ygo = spark.createDataFrame([("1", "Number 39", "XYZ Monster", "text", "2500", "-1", "4", "Warrior"), ("2", "Pot", "Spell Card", "draw", None, None, None, "Normal"), ("3", "Sheep", "Token", "", "0", "0", "1", "Beast")], "id string, name string, type string, desc string, atk string, def string, level string, race string")
    got = by_name(c.card_rows(c.csv_rows(ygo.withColumns({k: c.F.lit(None).cast("string") for k in ("linkval", "linkmarkers")})), c.CARDS["ygoprodeck"]))
    assert got["Number 39"].raw_content == {"name": "Number 39", "type": "XYZ Monster", "monster_type": "Warrior", "rank": "4", "atk": "2500", "def": "?", "text": "text"}
    assert got["Pot"].raw_content == {"name": "Pot", "type": "Spell Card", "property": "Normal", "text": "draw"} and len(got) == 2


def test_catalogues_vote(spark, tmp_path):
    product = lambda i, name, set_id=1, rarity="Rare", types=("Character",), **a: {"productId": i, "name": name, "setId": set_id, "rarity": rarity, "metadata": {"cardTypes": list(types), "rulesText": a.pop("rules", None), "customAttributes": a}}
    catalog = {"sets": [{"setId": 1, "name": "First", "releaseDate": "2023-01-01T00:00:00"}, {"setId": 2, "name": "Illumineer's Quest: X", "releaseDate": None}, {"setId": 3, "name": "Old", "releaseDate": "2020"}], "products": [
        product(1, "Elsa - Snow Queen", costInk="8", inkwellIcononCard="No", classification="Dreamborn;Hero", rules="<b>Freeze</b> it ."),
        product(2, "Elsa - Snow Queen (Epic)", rarity="Epic", costInk="7", inkwellIcononCard="No"), product(3, "Elsa, Snow Queen (Foil)", set_id=3, costInk=8), product(4, "Mickey", set_id=2), product(5, "Box", types=()),
        product(6, "Stitch", costInk="1", strength="None"), product(7, "Stitch (Errata Version)", costInk="2"),
    ]}
    (tmp_path / "l.json").write_text(json.dumps(catalog))
    got = by_name(c.catalog_cards(c.tcgjson_products(spark, str(tmp_path / "l.json")), c.CATALOGS["lorcana"]))
    assert got.keys() == {"Elsa - Snow Queen", "Stitch"}
    elsa = got["Elsa - Snow Queen"]
    assert elsa.product_ids == [1, 2, 3] and elsa.source_id == "3" and elsa.numbers == []
    assert elsa.raw_content == {"name": "Elsa - Snow Queen", "type": "Character", "cost": "8", "inkwell": "false", "classifications": '["Dreamborn","Hero"]', "text": "Freeze it.", "rarity": "Rare", "set": "Old"}
    assert got["Stitch"].raw_content["cost"] == "2"
    data = lambda **a: [{"name": k.replace("_", " "), "value": v} for k, v in a.items()]
    groups = {"groups": [{"groupId": 1, "name": "GD01", "publishedOn": "2025"}], "products": [
        {"productId": 11, "name": "Gundam", "groupId": 1, "extendedData": data(Number="GD01-001", CardType="UNIT", Rarity="Common", Cost="3", Attack_Points="4", Description="<i>Go</i>")},
        {"productId": 12, "name": "Gundam (Alt)", "groupId": 1, "extendedData": data(Number="GD01-001 p", CardType="UNIT", Rarity="LR++", Cost="3")},
        {"productId": 13, "name": "Token", "groupId": 1, "extendedData": data(Number="T-001", CardType="UNIT")}, {"productId": 14, "name": "Base", "groupId": 1, "extendedData": data(Number="EXB-1", CardType="EX Base")},
        {"productId": 15, "name": "Box", "groupId": 1, "extendedData": None},
    ]}
    (tmp_path / "g.json").write_text(json.dumps(groups))
    (gundam,) = c.catalog_cards(c.tcgcsv_products(spark, str(tmp_path / "g.json")), c.CATALOGS["gundam"]).collect()
    assert gundam.identity == "number:GD01-001" and gundam.numbers == ["GD01-001"] and gundam.product_ids == [11, 12]
    assert gundam.raw_content == {"name": "Gundam", "type": "UNIT", "cost": "3", "ap": "4", "text": "Go", "rarity": "Common", "set": "GD01"}


@pytest.mark.parametrize("game", sorted(c.CATALOGS))
def test_every_catalogue_has_a_plan(spark, game):
    products = spark.createDataFrame([], "product_id long, name string, set_name string, release_date string, rarity string, types array<string>, rules string, number string, attributes map<string,string>")
    assert c.catalog_cards(products, c.CATALOGS[game]).columns[:2] == ["source_game", "identity"]


def test_empty_dumps(spark):
    for s in c.CARDS.values():
        assert c.card_rows(spark.createDataFrame([], "c map<string,string>"), s).columns[0] == "source_game"
    assert c.card_rows(spark.createDataFrame([], "c map<string,string>"), c.CARDS["scryfall"]).count() == 0
