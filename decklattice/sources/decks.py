"""Deck sources: raw lists of each site to entries, matched cards and distinct decks.

``DECKS[source]`` says of a source how a raw row is read and which of its cards are the deck that a
game starts with. ``entries`` gives one row per line of a deck; ``decks_from`` matches the cards,
checks sizes and gives every different deck once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators.store import match_chain

#: What a line says of its card: names of the columns, null where a source does not say it.
REFERENCE = ("name", "card_id", "printing", "number")
_LINE = "named_struct('n', cast({n} as int), 'name', {name}, 'card_id', {card_id}, 'printing', {printing}, 'number', {number})"


def line(n: str, name: str = "cast(null as string)", card_id: str = "cast(null as string)", printing: str = "cast(null as string)", number: str = "cast(null as string)") -> str:
    return _LINE.format(n=n, name=name, card_id=card_id, printing=printing, number=number)


@dataclass(frozen=True)
class DeckSource:
    """One source; expressions are SQL over the columns that ``schema`` gives a row's JSON."""

    game: str
    schema: str
    key: str
    lines: str  # an array of ``line`` structs
    name: str = "cast(null as string)"
    where: str = "true"
    least: int = 1
    most: int | None = None
    steps: tuple[tuple[str, str], ...] = (("name", "name"),)  # (alias source or "name", reference column), in order
    whole: bool = False  # a deck with an unknown card is dropped
    own_id: bool = False  # the deck's id follows from its key, not from its cards


# Companions, and the formats whose export has commanders in its second section.
COMPANIONS = ("Gyruda, Doom of Depths", "Jegantha, the Wellspring", "Kaheera, the Orphanguard", "Keruga, the Macrosage", "Lurrus of the Dream-Den", "Lutri, the Spellchaser", "Obosh, the Preypiercer", "Umori, the Collector", "Yorion, Sky Nomad", "Zirda, the Dawnwaker")
COMMAND_FORMATS, POOL_FORMAT = ("EDH", "cEDH", "EDHM", "EDHP"), "LI"

_NAMES = ", ".join('"' + c + '"' for c in COMPANIONS)
_FORMATS = ", ".join(f"'{f}'" for f in COMMAND_FORMATS)
_OUT = "transform(filter(coalesce(categories, array()), g -> g.includedInDeck = false), g -> g.name)"
_TEXT = "filter(transform(split(mtgo, '\\\\n'), l -> trim(l)), l -> l <> '')"
_CUT = f"array_position({_TEXT}, 'Sideboard')"
_MAIN = f"if({_CUT} = 0, {_TEXT}, slice({_TEXT}, 1, cast({_CUT} as int) - 1))"
_SIDE = f"if({_CUT} = 0, array(), slice({_TEXT}, cast({_CUT} as int) + 1, 100000))"
_NAME_OF = "regexp_replace(regexp_extract(l, '^[0-9]+ +(.*)$', 1), ' */+ *', ' // ')"
_KEPT = f"filter({_SIDE}, l -> format in ({_FORMATS}) or (format <> '{POOL_FORMAT}' and {_NAME_OF} in ({_NAMES})))"
_ONE_COMPANION = f"if(format in ({_FORMATS}), {line('regexp_extract(l, \"^([0-9]+)\", 1)', _NAME_OF)}, {line('1', _NAME_OF)})"
_PASS = "transform(from_json({0}, 'array<string>'), c -> " + line("1", card_id="cast(cast(c as bigint) as string)") + ")"

_CRAWL = {"least": 20, "most": 256, "steps": (("oracle", "card_id"), ("printing", "printing"), ("name", "name"))}
DECKS: dict[str, DeckSource] = {
    "archidekt": DeckSource(
        "mtg", "id bigint, name string, unlisted boolean, categories array<struct<name:string,includedInDeck:boolean>>, cards array<struct<quantity:int,companion:boolean,deletedAt:string,categories:array<string>,card:struct<oracleCard:struct<name:string,uid:string>>>>",
        "cast(id as string)",
        f"transform(filter(cards, c -> c.deletedAt is null and (coalesce(c.companion, false) or size(coalesce(c.categories, array())) = 0 or not array_contains({_OUT}, c.categories[0]))), c -> " + line("c.quantity", "c.card.oracleCard.name", "c.card.oracleCard.uid") + ")",
        "name", "not coalesce(unlisted, false)", **_CRAWL,
    ),
    "moxfield": DeckSource(
        "mtg", "publicId string, name string, format string, boards map<string,struct<cards:map<string,struct<quantity:int,card:struct<name:string,scryfall_id:string>>>>>", "publicId",
        "flatten(transform(array('mainboard', 'commanders', 'companions', 'signatureSpells'), b -> transform(coalesce(map_values(boards[b].cards), array()), c -> " + line("c.quantity", "c.card.name", printing="c.card.scryfall_id") + ")))",
        "name", "coalesce(format, '') <> 'package'", **_CRAWL,
    ),
    "deckstats": DeckSource(
        "mtg", "deck struct<idsdeck:bigint,name:string>, entries array<struct<amount:int,name:string,zone:string,is_commander:boolean,is_companion:boolean,card:struct<is_token:boolean>,printing:struct<scryfall_id:string>>>", "cast(deck.idsdeck as string)",
        "transform(filter(entries, e -> not coalesce(e.card.is_token, false) and (coalesce(e.zone, '') in ('main', 'commander') or coalesce(e.is_commander, false) or coalesce(e.is_companion, false))), e -> " + line("e.amount", "e.name", printing="e.printing.scryfall_id") + ")",
        "deck.name", **_CRAWL,
    ),
    "mtgtop8": DeckSource(
        "mtg", "deck_id bigint, deck_name string, format string, mtgo string", "cast(deck_id as string)",
        f"concat(transform({_MAIN}, l -> {line('regexp_extract(l, \"^([0-9]+)\", 1)', _NAME_OF)}), transform({_KEPT}, l -> {_ONE_COMPANION}))", "nullif(deck_name, '')", **_CRAWL,
    ),
    "mtgjson": DeckSource(
        "mtg", "data struct<name:string,code:string,mainBoard:array<struct<count:int,name:string,identifiers:struct<scryfallOracleId:string,scryfallId:string>>>,commander:array<struct<count:int,name:string,identifiers:struct<scryfallOracleId:string,scryfallId:string>>>>", "concat_ws('_', data.name, data.code)",
        "transform(concat(coalesce(data.mainBoard, array()), coalesce(data.commander, array())), c -> " + line("c.count", "c.name", "c.identifiers.scryfallOracleId", "c.identifiers.scryfallId") + ")", "data.name", **_CRAWL,
    ),
    "hearthstonetopdecks": DeckSource("hearthstone", "url string, title string, cards array<struct<card:bigint,n:int>>", "url", "transform(cards, c -> " + line("c.n", card_id="cast(c.card as string)") + ")", "title", steps=(("hearthstonejson", "card_id"),)),
    "zenodo_hearthstone": DeckSource("hearthstone", "idDeck string, archetype string, cards array<string>", "idDeck", "transform(cards, c -> " + line("1", "trim(c)") + ")", "archetype"),
    "ygoprodeck": DeckSource(
        "yugioh", "deck_num string, deck_name string, main_deck string, extra_deck string", "deck_num", f"concat({_PASS.format('main_deck')}, {_PASS.format('extra_deck')})", "coalesce(nullif(deck_name, ''), deck_num)",
        "size(from_json(main_deck, 'array<string>')) between 40 and 60 and size(from_json(extra_deck, 'array<string>')) between 0 and 15", steps=(("ygoprodeck", "card_id"),),
    ),
    "fabtcgmeta_online": DeckSource(
        "flesh_and_blood", "hash string, deck struct<deckInfo:struct<heroFormat:string>,cards:map<string,array<struct<name:string,count:int,pitch:string>>>>", "hash",
        "flatten(transform(map_values(deck.cards), g -> transform(g, c -> " + line("c.count", "trim(c.name)", number="c.pitch") + ")))", "deck.deckInfo.heroFormat", "deck.cards is not null and not exists(flatten(map_values(deck.cards)), c -> coalesce(c.count, 0) < 1)",
    ),
    "fabtcg_decklists": DeckSource("flesh_and_blood", "slug string, cards array<struct<n:int,name:string>>", "slug", "transform(cards, c -> " + line("c.n", "c.name") + ")"),
    "spire_codex_runs": DeckSource("slay_the_spire_2", "run string, deck array<struct<id:string>>", "run", "transform(deck, c -> " + line("1", card_id="regexp_replace(c.id, '^CARD[.]', '')") + ")", steps=(("spire_codex", "card_id"),), own_id=True),
    "sts_gg": DeckSource("slay_the_spire_2", "id string, deck array<struct<id:string>>", "id", "transform(deck, c -> " + line("1", card_id="regexp_replace(c.id, '^CARD[.]', '')") + ")", steps=(("spire_codex", "card_id"),), own_id=True),
    "isotropic": DeckSource("dominion", "game string, cards map<string,int>", "game", "transform(map_entries(cards), c -> " + line("c.value", "c.key") + ")", whole=True),
    "play_gwent": DeckSource("gwent", "id bigint, name string, templates array<string>", "cast(id as string)", "transform(templates, c -> " + line("1", card_id="c") + ")", "nullif(name, '')", steps=(("gwent_one", "card_id"),), own_id=True),
    "pokemon_theme": DeckSource("pokemon", "id string, name string, cards array<struct<id:string,count:int>>", "id", "transform(cards, c -> " + line("c.count", card_id="c.id") + ")", "name", steps=(("pokemon_tcg", "card_id"),), own_id=True),
    "seventeenlands": DeckSource("mtg", "game string, cards map<string,int>", "game", "transform(map_entries(map_filter(cards, (k, v) -> v > 0)), c -> " + line("c.value", "c.key") + ")", least=40),
}

_ENTRY = "struct<count:int,set:string,number:string,name:string>"
_SECTIONS = f"transform(map_entries(map_filter(sections, (k, v) -> k <> 'side')), s -> coalesce(from_json(s.value, 'array<{_ENTRY}>'), array()))"
_STANDING = f"transform(flatten({_SECTIONS}), e -> " + line("coalesce(e.count, 1)", "e.name", number="concat_ws('-', e.set, e.number)") + ")"


def _limitless(game: str, least: int, most: int | None, by_number: bool = True) -> DeckSource:
    steps = (("printed_number", "number"), ("name", "name")) if by_number else (("name", "name"),)
    return DeckSource(game, "source_id string, archetype string, sections map<string,string>", "source_id", _STANDING, "archetype", least=least, most=most, steps=steps)


# Sizes of full decks.
DECKS |= {
    "limitless_pokemon": _limitless("pokemon", 60, 60), "limitless_one_piece": _limitless("one_piece", 51, 51), "limitless_digimon": _limitless("digimon", 50, 55), "limitless_gundam": _limitless("gundam", 50, 50),
    "limitless_dragon_ball_fusion_world": _limitless("dragon_ball_fusion_world", 51, 61), "limitless_dragon_ball_masters": _limitless("dragon_ball_masters", 51, None), "limitless_battle_spirits_saga": _limitless("battle_spirits_saga", 50, 60),
    "limitless_star_wars_unlimited": _limitless("star_wars_unlimited", 52, None, False), "limitless_lorcana": _limitless("lorcana", 60, None, False),
}


def parsed(raw: DataFrame, source: DeckSource, column: str = "value") -> DataFrame:
    """Raw JSON rows with the columns of the source's schema."""
    return raw.select(F.from_json(column, source.schema).alias("r")).select("r.*")


def standings(raw: DataFrame, tournament: str = "tournament", place: str = "place", value: str = "value") -> DataFrame:
    """(source_id, archetype, sections) of standings rows: none, one or several lists each."""
    lists = "decklist map<string,string>, deck struct<name:string>, decklists map<string,map<string,string>>, decks map<string,struct<name:string>>"
    r = raw.select(F.concat_ws(":", tournament, place).alias("source_id"), F.from_json(value, lists).alias("r"))
    one = r.where("r.decklist is not null").select("source_id", F.col("r.deck.name").alias("archetype"), F.col("r.decklist").alias("sections"))
    many = r.select("source_id", "r.decks", F.explode("r.decklists").alias("k", "sections")).where("sections is not null")
    return one.union(many.select(F.concat_ws(":", "source_id", "k"), F.col("decks")[F.col("k")]["name"], "sections"))


def run_decks(raw: DataFrame, keep_abandoned: bool = True, value: str = "value") -> DataFrame:
    """(run, deck) of run records: one deck per player."""
    r = raw.select(F.from_json(value, "run_hash string, was_abandoned boolean, players array<struct<deck:array<struct<id:string>>>>").alias("r")).select("r.*")
    r = r if keep_abandoned else r.where("not coalesce(was_abandoned, false)")
    return r.select("run_hash", F.posexplode("players").alias("i", "p")).select(F.concat_ws(":", "run_hash", "i").alias("run"), F.col("p.deck").alias("deck"))


def guide_decks(raw: DataFrame, value: str = "value") -> DataFrame:
    """(id, name, templates) of guides; the cards are an array or an object of slots."""
    cards = F.get_json_object(value, "$.deck.srcCardTemplates")
    slots = F.map_values(F.from_json(cards, "map<string,string>"))
    ids = F.when(cards.startswith("["), F.from_json(cards, "array<string>")).otherwise(slots)
    return raw.select(F.get_json_object(value, "$.id").cast("bigint").alias("id"), F.get_json_object(value, "$.name").alias("name"), ids.alias("templates"))


def final_decks(raw: DataFrame, value: str = "value") -> DataFrame:
    """(game, cards) of game summaries: each player who did not leave."""
    r = raw.select(F.from_json(value, "serial string, players array<struct<end:struct<deck:map<string,int>>>>").alias("r")).select("r.*")
    return r.select("serial", F.posexplode("players").alias("i", "p")).where("p.`end`.deck is not null").select(F.concat_ws(":", "serial", "i").alias("game"), F.col("p.end.deck").alias("cards"))


def list_pages(pages: DataFrame, slug: str = "slug", html: str = "html") -> DataFrame:
    """(slug, cards) of deck pages that write lines as "3x Name (red)"; the colour mark goes."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)</?(span|b|i|em|strong)\b[^>]*>", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\s+", " "), r"<[^>]*>", "\n")
    found = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\s*(\d+x\s+\S.*?)\s*$"), F.lit(1)), lambda t: F.struct(F.regexp_extract(t, r"^(\d+)", 1).cast("int").alias("n"), F.regexp_replace(F.regexp_replace(t, r"^\d+x\s+", ""), r"\s+\((?:red|yel|blu)\)$", "").alias("name")))
    return pages.select(slug, found.alias("cards"))


def entries(rows: DataFrame, source: DeckSource) -> DataFrame:
    """(deck, deck_name, n, name, card_id, printing, number): the lines of each deck that count; lines without copies go."""
    e = rows.where(F.expr(source.where)).select(F.expr(source.key).alias("deck"), F.expr(source.name).alias("deck_name"), F.explode(F.expr(source.lines)).alias("l"))
    return e.select("deck", "deck_name", "l.*").where("deck is not null and n >= 1")


def decks_from(lines: DataFrame, source: DeckSource, known: dict[str, DataFrame], unknown: str, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> DataFrame:
    """(deck_uuid, deck_name, source_id, cards, misses): every different full deck once.

    ``known`` has for each step of the source a table (id, card_id): names or aliases and the cards
    they stand for; one that stands for several is no match. A line that no step knows is the
    unknown card, or drops the deck where the source wants whole ones. Of equal decks the one of the
    smallest source_id gives the name. Empty sources give no rows.
    """
    steps = []
    for kind, column in source.steps:
        own = "ref" if column == "card_id" else column
        if kind in known:
            table = known[kind].select(F.col("id").cast("string").alias(own), F.col("card_id").cast("string").alias("card_id"))
            steps.append((kind, table, [own]))
    matched = match_chain(lines.withColumnRenamed("card_id", "ref"), steps, unknown)
    copies = F.flatten(F.collect_list(F.array_repeat("card_id", F.col("n"))))
    miss = F.sum(F.when(F.col("match_kind") == "unknown", F.col("n")).otherwise(0))
    bags = matched.groupBy("deck").agg(F.max("deck_name").alias("deck_name"), F.array_sort(copies).alias("cards"), miss.alias("misses")).where(F.size("cards") >= source.least)
    bags = bags if source.most is None else bags.where(F.size("cards") <= source.most)
    bags = bags.where("misses = 0") if source.whole else bags
    uuid = hashing.uuid5(namespace, F.concat(F.lit(source.game + ":"), "deck")) if source.own_id else hashing.deck_uuid(F.col("cards"))
    named = bags.withColumn("deck_uuid", uuid)
    one = named.groupBy("deck_uuid").agg(F.min_by(F.struct(F.coalesce("deck_name", "deck").alias("deck_name"), F.col("deck").alias("source_id"), "cards", "misses"), "deck").alias("r"))
    return one.select("deck_uuid", "r.*")

