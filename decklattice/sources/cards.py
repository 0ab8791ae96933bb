"""Card sources: raw dumps of each game to one row per card, ready for the card store.

``CARDS[source]`` says of a source which rows are deck cards, what makes two rows one card, which
row stands for it, which other names (aliases) it has and which fields go. ``card_rows`` applies it.
Games whose dump is a catalogue of products have a ``Catalog`` each; ``catalog_cards`` groups the
printings and lets them vote on every field.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = "map<string,string>"
#: Keys that say nothing of a card in any source, and values that are no content.
NOISE_KEYS = r"(^|_)ids?$|_uris?$|_urls?$"
NOISE_VALUES = r"^(https?://\S*|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|\d{4}-\d{2}-\d{2}([T ]\S*)?|\[\]|\{\}|false|)$"


@dataclass(frozen=True)
class Source:
    """One source; expressions are SQL over ``c``, the row's fields as text (nested ones as JSON)."""

    game: str
    name: str
    identity: tuple[str, ...]
    where: str = "true"
    order: str = "c['id']"  # the row that stands for its card is the least by this
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    add: dict[str, str] = field(default_factory=dict)
    ladder: tuple[str, ...] = ()  # rarities, the least first: the card has its least one
    aliases: dict[str, str] = field(default_factory=dict)  # alias source to an array of ids
    clean: tuple[tuple[str, str], ...] = ()  # (pattern, replacement) for text values, in order
    mirror: bool = False  # the dump is the whole pool: stored cards that it lacks go


def lean(content: Column, drop: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> Column:
    """The content without noise keys and empty values; whole numbers without a fraction."""
    whole = F.transform_values(content, lambda k, v: F.regexp_replace(v, r"^(-?\d+)\.0+$", "$1"))
    fine = lambda k, v: v.isNotNull() & ~v.rlike(NOISE_VALUES) & ~k.rlike(NOISE_KEYS) & ~k.isin(*(drop or ("",)))
    out = F.map_filter(whole, fine)
    return F.map_filter(out, lambda k, v: k.isin(*keep)) if keep else out


def json_content(raw: Column) -> Column:
    """A JSON object's fields as text; null for what is none."""
    return F.from_json(raw, CONTENT)


def card_rows(rows: DataFrame, source: Source) -> DataFrame:
    """(source_game, data_source, identity, source_id, name, raw_content, aliases) of rows (c: map of fields).

    One row per card: the least row of an identity stands for it, its rarity is the least of all
    printings, and aliases are those of all of them, as (source, id). Rows whose identity or name is
    null are no cards; an empty dump gives no rows.
    """
    content = F.col("c")
    if source.add:
        content = F.map_concat(F.map_filter("c", lambda k, v: ~k.isin(*source.add)), F.create_map(*[x for k, e in source.add.items() for x in (F.lit(k), F.expr(e).cast("string"))]))
    content = lean(content, source.drop, source.keep)
    for pattern, to in source.clean:
        content = F.transform_values(content, _replaced(pattern, to))
    ids = [F.transform(F.coalesce(F.expr(e), F.array()).cast("array<string>"), _named(k)) for k, e in source.aliases.items()]
    names = F.filter(F.concat(*ids), lambda a: a["id"].isNotNull() & (a["id"] != "")) if ids else F.array().cast("array<struct<source:string,id:string>>")
    rank = F.array_position(F.array(*[F.lit(r) for r in source.ladder]), F.expr("c['rarity']")) if source.ladder else F.lit(None).cast("long")
    parts = [F.expr(e).cast("string") for e in source.identity]
    kept = rows.where(F.expr(source.where)).select("c", content.alias("content"), names.alias("names"), F.when(rank > 0, rank).alias("rank"), F.expr(source.order).alias("at"), *[p.alias(f"k{i}") for i, p in enumerate(parts)])
    keys = [f"k{i}" for i in range(len(parts))]
    one = kept.dropna(subset=keys).groupBy(*keys).agg(
        F.min_by(F.struct("c", "content"), F.struct("at", F.to_json("content"))).alias("r"), F.min("rank").alias("rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("aliases")
    )
    body = F.col("r.content")
    if source.ladder:
        least = F.get(F.array(*[F.lit(r) for r in source.ladder]), F.col("rank").cast("int") - 1)
        body = F.map_concat(F.map_filter(body, lambda k, v: k != "rarity"), F.when(least.isNotNull(), F.create_map(F.lit("rarity"), least)).otherwise(F.create_map().cast(CONTENT)))
    out = one.select(F.lit(source.game).alias("source_game"), F.lit(source.name).alias("data_source"), F.concat_ws("|", *keys).alias("identity"), F.col("r.c")["id"].alias("source_id"), F.col("r.content")["name"].alias("name"), body.alias("raw_content"), "aliases")
    return out.where("name is not null")


def _replaced(pattern: str, to: str):
    return lambda k, v: F.trim(F.regexp_replace(v, pattern, to))


def _named(source: str):
    return lambda i: F.struct(F.lit(source).alias("source"), i.alias("id"))


def gwent_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """(c) of the card blocks of pages: data-* attributes, name, category and ability text."""
    block = F.explode(F.slice(F.split(html, r'(?=<div[^>]*class="card-wrap card-data")'), 2, 1_000_000))
    b = pages.select(block.alias("b"))
    tag = F.regexp_extract("b", r"^(<div[^>]*>)", 1)
    pairs = lambda g: F.regexp_extract_all(tag, F.lit(r'data-([\w-]+)="([^"]*)"'), F.lit(g))
    inner = lambda name: F.trim(F.regexp_replace(F.regexp_extract("b", r'(?s)class="[^"]*\b' + name + r'\b[^"]*"[^>]*>(.*?)</(?:div|h\d|p|span)>', 1), r"<[^>]*>", ""))
    texts = F.create_map(F.lit("name"), inner("card-name"), F.lit("category"), inner("card-category"), F.lit("ability_text"), inner("card-body-ability"))
    return b.select(F.map_concat(F.map_from_arrays(pairs(1), pairs(2)), texts).alias("c"))


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(c) of JSON lines: one object per line."""
    return spark.read.text(path).select(json_content(F.col("value")).alias("c")).where("c is not null")


def json_array_rows(spark: SparkSession, path: str) -> DataFrame:
    """(c, file) of files that are one JSON array of objects each."""
    whole = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return whole.select(F.explode(F.from_json("value", f"array<{CONTENT}>")).alias("c"), "file")


def csv_rows(frame: DataFrame) -> DataFrame:
    """(c) of a frame of columns: empty cells are missing fields."""
    cells = [x for c in frame.columns for x in (F.lit(c), F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")))]
    return frame.select(F.create_map(*cells).alias("c"))


def dominion_rows(cards: DataFrame, texts: DataFrame) -> DataFrame:
    """(c) of the card list (c) joined with the English texts (card_tag, c); cards without a text go."""
    joined = cards.withColumn("card_tag", F.col("c")["card_tag"]).join(texts.select("card_tag", F.col("c").alias("t")), "card_tag")
    return joined.select(F.map_concat(F.map_filter("c", lambda k, v: ~F.map_contains_key("t", k)), "t").alias("c"))


# Rarities, least first, and the fields of each source that describe a card or do not.
MTG_RARITIES = ("common", "uncommon", "rare", "mythic", "special", "bonus")
FAB_RARITIES = ("token", "basic", "common", "rare", "super-rare", "majestic", "legendary", "fabled", "marvel", "promo", "promo-marvel", "gold", "gold-marvel")
POKEMON_RARITIES = (
    "Common", "Uncommon", "Rare", "Rare Holo", "Rare Holo EX", "Rare Holo GX", "Rare Holo V", "Rare Holo VMAX", "Rare Holo VSTAR", "Rare Holo ex", "Rare Holo LV.X", "Rare BREAK", "Rare Prime", "Rare Prism Star", "Rare Holo Star",
    "Rare Shining", "Rare Shiny", "Rare Shiny GX", "Shiny Rare", "Shiny Ultra Rare", "Rare ACE", "ACE SPEC Rare", "LEGEND", "Amazing Rare", "Radiant Rare", "Double Rare", "Rare Ultra", "Ultra Rare", "Illustration Rare",
    "Trainer Gallery Rare Holo", "Rare Rainbow", "Rare Secret", "Hyper Rare", "Special Illustration Rare", "Mega Hyper Rare", "MEGA_ATTACK_RARE", "Futuristic Rare", "Black White Rare", "Holo Rare V", "Holo Rare VMAX", "Holo Rare VSTAR",
    "Classic Collection", "Pikachu Rare", "Promo",
)
MTG_DROP = (
    "object", "lang", "all_parts", "artist", "border_color", "frame", "frame_effects", "security_stamp", "finishes", "games", "collector_number", "image_status", "prices", "edhrec_rank", "penny_rank", "promo_types", "preview", "watermark",
    "flavor_text", "set_name", "set_type", "foil", "nonfoil", "reprint", "booster", "highres_image", "story_spotlight",
)
MTG_LAYOUTS = "'token', 'double_faced_token', 'emblem', 'scheme', 'planar', 'vanguard', 'art_series', 'front_card'"
POKEMON_DROP = ("number", "artist", "flavorText", "images", "nationalPokedexNumbers", "legalities", "retreatCost", "convertedEnergyCost")
HS_KEEP = ("name", "cost", "attack", "health", "durability", "armor", "runeCost", "type", "cardClass", "classes", "rarity", "set", "races", "spellSchool", "text")
SPIRE_DROP = ("description_raw", "vars", "powers_applied", "keywords_key", "type_key", "rarity_key", "compendium_order", "spawns_cards", "sources")
FAB_FACE = ("name", "typebox", "pitch", "pitch_chi", "color", "cost", "power", "defense", "life", "intellect", "traitbox", "textbox")
YGO_KEEP = ("name", "type", "attribute", "monster_type", "property", "level", "rank", "link_rating", "link_arrows", "scale", "atk", "def", "text")

_MONSTER, _XYZ, _LINK = (f"contains(c['type'], '{w}')" for w in ("Monster", "XYZ", "Link"))
_STAT = "if({0} = '-1', '?', {0})"

CARDS: dict[str, Source] = {
    "scryfall": Source(
        "mtg", "scryfall", ("c['oracle_id']",), f"coalesce(c['layout'], '') not in ({MTG_LAYOUTS})", drop=MTG_DROP, ladder=MTG_RARITIES,
        aliases={"scryfall": "array(c['oracle_id'])", "arena": "array(c['arena_id'])", "mtgo": "array(c['mtgo_id'], c['mtgo_foil_id'])", "multiverse": "from_json(c['multiverse_ids'], 'array<string>')", "printing": "array(c['id'])"},
    ),
    "pokemon_tcg": Source(
        "pokemon", "pokemon_tcg", ("c['name']", "regexp_extract(c['id'], '^(.*)-[^-]*$', 1)"), order="-length(to_json(c))", drop=POKEMON_DROP, ladder=POKEMON_RARITIES,
        add={"set": "regexp_extract(c['id'], '^(.*)-[^-]*$', 1)"}, aliases={"pokemon_tcg": "array(c['id'])"},
    ),
    "hearthstonejson": Source(
        "hearthstone", "hearthstonejson", ("to_json(map_filter(c, (k, v) -> k in ('name', 'cost', 'attack', 'health', 'durability', 'armor', 'runeCost', 'type', 'cardClass', 'classes', 'races', 'spellSchool', 'text')))",),
        "c['collectible'] = 'true' and coalesce(c['set'], '') <> 'HERO_SKINS'", "cast(c['dbfId'] as long)", keep=HS_KEEP, aliases={"hearthstonejson": "array(c['dbfId'])"},
        clean=((r"@[\s\S]*$", ""), (r"</?[bi]>|\[x\]|\{\d\}", ""), (r"[$#](?=\d)", ""), (r"\s+", " ")), mirror=True,
    ),
    "gwent_one": Source("gwent", "gwent_one", ("c['id']",), drop=("artid", "res"), aliases={"gwent_one": "array(c['id'])"}),
    "spire_codex": Source("slay_the_spire_2", "spire_codex", ("c['id']",), drop=SPIRE_DROP, aliases={"spire_codex": "array(c['id'])"}, clean=((r"\[/?[a-z]+\]", ""),)),
    "cardvault_fabtcg": Source(
        "flesh_and_blood", "cardvault_fabtcg", ("c['card_id']",), order="struct(c['print_language'] <> 'en', c['print_id'])", keep=(*FAB_FACE, "rarity"), ladder=FAB_RARITIES,
        add={k: f"c['face_1_true_{k}']" for k in FAB_FACE}, aliases={"cardvault_fabtcg": "array(c['card_id'])", "print": "array(c['print_id'])"}, clean=((r"\{br\}", "\n"),),
    ),
    "dominiontabs": Source(
        "dominion", "dominiontabs", ("c['card_tag']",), order="c['card_tag']", keep=("name", "types", "cost", "potcost", "debtcost", "description", "extra"), aliases={"dominiontabs": "array(c['card_tag'])"},
        clean=((r"<\*?VP\*?>", "VP"), (r"<\*?COIN\*?>", "Coin"), (r"<\*?POTION\*?>", "Potion"), (r"<(?:br|n|line)>", "\n"), (r"</?(?:u|i|b|left|center|justify)>", ""), (r"[ \t ]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")),
    ),
    "ygoprodeck": Source(
        "yugioh", "ygoprodeck", ("c['id']",), "c['type'] not in ('Token', 'Skill Card')", keep=YGO_KEEP, aliases={"ygoprodeck": "array(c['id'])"}, mirror=True,
        add={
            "monster_type": f"if({_MONSTER}, c['race'], null)", "property": f"if({_MONSTER}, null, c['race'])", "level": f"if({_XYZ} or {_LINK} or not {_MONSTER}, null, c['level'])", "rank": f"if({_XYZ}, c['level'], null)",
            "link_rating": "c['linkval']", "link_arrows": "c['linkmarkers']", "atk": _STAT.format("c['atk']"), "def": _STAT.format("c['def']"), "text": "c['desc']",
        },
    ),
}


@dataclass(frozen=True)
class Catalog:
    """One game's catalogue of products: kept fields as (attribute, key, kind), and what is no card."""

    game: str
    fields: tuple[tuple[str, str, str], ...]
    ladder: tuple[str, ...]
    number: str = ""  # where cards are their numbers: the pattern of one
    suffix: str = ""  # what ends a name besides tags in brackets
    no_sets: str = ""  # pattern of sets without deck cards
    no_types: tuple[str, ...] = ()
    no_numbers: str = ""
    untyped: bool = False  # a product without a type is a card if it has a number


# Fixed values of the catalogues: fields, rarities and patterns.
FIRST_WORD, AFTER_SLASH, ENDS_IN_NUMBER = r"^\S+", r"(?<=/)[^/\s]+", r"\s+-\s+[A-Z]+\d*-\d+$"
CATALOGS: dict[str, Catalog] = {
    "lorcana": Catalog(
        "lorcana",
        (("inkType", "ink", "text"), ("costInk", "cost", "int"), ("inkwellIcononCard", "inkwell", "flag"), ("strength", "strength", "int"), ("willpower", "willpower", "int"), ("loreValue", "lore", "int"), ("moveCost", "move_cost", "int"), ("classification", "classifications", "list")),
        ("Common", "Uncommon", "Rare", "Super Rare", "Legendary", "Epic", "Enchanted", "Iconic"), no_sets="^Illumineer's Quest",
    ),
    "digimon": Catalog(
        "digimon",
        (("color", "color", "list"), ("playCost", "play_cost", "int"), ("levelLv", "level", "int"), ("digimonForm", "form", "text"), ("digimonAttribute", "attribute", "text"), ("digimonType", "digimon_type", "text"), ("digimonPowerDp", "dp", "int"),
         ("digivolve1Color", "digivolve_1_color", "text"), ("digivolve1Level", "digivolve_1_level", "text"), ("digivolve1Cost", "digivolve_1_cost", "int"), ("digivolve2Color", "digivolve_2_color", "text"), ("digivolve2Level", "digivolve_2_level", "text"),
         ("digivolve2Cost", "digivolve_2_cost", "int"), ("digivolve3Level", "digivolve_3_level", "text"), ("inheritedEffect", "inherited_effect", "rules"), ("securityEffect", "security_effect", "rules")),
        ("Common", "Uncommon", "Rare", "Super Rare", "Secret Rare", "Special Rare", "Ultimate Rare"), FIRST_WORD, ENDS_IN_NUMBER,
    ),
    "one_piece": Catalog(
        "one_piece", (("color", "color", "list"), ("cost", "cost", "int"), ("life", "life", "int"), ("power", "power", "int"), ("counter", "counter", "int"), ("attribute", "attribute", "list"), ("subtypes", "types", "list")),
        ("Common", "Uncommon", "Rare", "Super Rare", "Leader", "Secret Rare", "Treasure Rare"), FIRST_WORD, ENDS_IN_NUMBER, no_types=("DON!!",),
    ),
    "star_wars_unlimited": Catalog(
        "star_wars_unlimited", (("aspect", "aspects", "list"), ("cost", "cost", "int"), ("power", "power", "int"), ("hp", "hp", "int"), ("arenaType", "arena", "text"), ("traits", "traits", "list"), ("epicAction", "epic_action", "rules")),
        ("Common", "Uncommon", "Rare", "Legendary", "Special"), suffix=r"\s+//.*$",
    ),
    "union_arena": Catalog(
        "union_arena",
        (("seriesName", "series", "text"), ("activationEnergy", "energy_color", "list"), ("requiredEnergy", "energy_cost", "int"), ("actionPointCost", "ap_cost", "int"), ("battlePointBp", "bp", "text"), ("generatedEnergy", "energy_generation", "text"),
         ("affinities", "traits", "list"), ("trigger", "trigger", "rules")),
        ("C", "U", "R", "SR", "UR", "SP"), AFTER_SLASH, no_types=("Action Point",),
    ),
    "riftbound": Catalog("riftbound", (("domain", "domains", "list"), ("energyCost", "energy", "int"), ("powerCost", "power", "int"), ("might", "might", "int"), ("tag", "tags", "list")), ("Common", "Uncommon", "Rare", "Epic", "Showcase")),
    "gundam": Catalog(
        "gundam",
        (("Color", "color", "list"), ("Level", "level", "int"), ("Cost", "cost", "int"), ("Attack Points", "ap", "text"), ("Hit Points", "hp", "text"), ("Trait", "traits", "text"), ("Link Condition", "link_condition", "text"), ("Zone", "zones", "list")),
        ("Common", "C+", "C++", "Uncommon", "U+", "Rare", "R+", "Legend Rare", "LR+", "LR++"), r"^(?!RP?-)\S+", no_types=("EX Base", "EX Resource"), no_numbers="^T-",
    ),
    "dragon_ball_fusion_world": Catalog(
        "dragon_ball_fusion_world", (("Color", "color", "list"), ("Cost", "cost", "text"), ("Power", "power", "text"), ("Combo Power", "combo_power", "int"), ("Character Traits", "traits", "list")),
        ("Common", "Uncommon", "Rare", "Super Rare", "Leader", "Secret Rare"), FIRST_WORD, ENDS_IN_NUMBER,
    ),
    "dragon_ball_masters": Catalog(
        "dragon_ball_masters",
        (("Color", "color", "list"), ("EnergyColor Cost", "energy_cost", "text"), ("Z Energy Cost", "z_energy_cost", "int"), ("Power", "power", "text"), ("Combo Power", "combo_power", "int"), ("Combo Energy", "combo_energy", "int"), ("Character", "character", "text"), ("SpecialTrait", "special_traits", "text")),
        ("Common", "Uncommon", "Rare", "Starter Rare", "Super Rare", "Expansion Rare", "Special Rare", "Secret Rare"), r"^[^\s_]+", no_types=("Token",), no_numbers=r"^M-|-EM\d|^\d+$", untyped=True,
    ),
    "battle_spirits_saga": Catalog(
        "battle_spirits_saga",
        (("Color", "color", "list"), ("Cost", "cost", "int"), ("Reduction Symbols", "reduction_symbols", "text"), ("Symbols", "symbols", "int"), ("Spirit Type", "family", "text"), ("LV I Cost", "lv1_core", "int"), ("LV I BP", "lv1_bp", "int"),
         ("LV II Cost", "lv2_core", "int"), ("LV II BP", "lv2_bp", "int"), ("LV III Cost", "lv3_core", "int"), ("LV III BP", "lv3_bp", "int")),
        ("Common", "Uncommon", "Rare", "X Rare", "Special Rare"), FIRST_WORD,
    ),
}

TCGJSON = "sets array<struct<setId:bigint,name:string,releaseDate:string>>, products array<struct<productId:bigint,name:string,setId:bigint,rarity:string,metadata:struct<cardTypes:array<string>,rulesText:string,customAttributes:map<string,string>>>>"
TCGCSV = "groups array<struct<groupId:bigint,name:string,publishedOn:string>>, products array<struct<productId:bigint,name:string,groupId:bigint,extendedData:array<struct<name:string,value:string>>>>"
PRODUCT = ["product_id", "name", "set_name", "release_date", "rarity", "types", "rules", "number", "attributes"]


def tcgjson_products(spark: SparkSession, path: str) -> DataFrame:
    """The products of a catalogue file with sets, product by product."""
    raw = spark.read.schema(TCGJSON).option("multiLine", True).json(path)
    p, s = raw.select(F.inline("products")), raw.select(F.inline("sets")).select("setId", F.col("name").alias("set_name"), F.col("releaseDate").alias("release_date"))
    a = F.col("metadata.customAttributes")
    joined = p.join(F.broadcast(s), "setId")  # the sets of one game
    return joined.select(F.col("productId").alias("product_id"), "name", "set_name", "release_date", "rarity", F.col("metadata.cardTypes").alias("types"), F.coalesce("metadata.rulesText", a["description"]).alias("rules"), a["number"].alias("number"), a.alias("attributes"))


def tcgcsv_products(spark: SparkSession, path: str) -> DataFrame:
    """The products of a catalogue file with groups, whose attributes are a list of names and values."""
    raw = spark.read.schema(TCGCSV).option("multiLine", True).json(path)
    p, s = raw.select(F.inline("products")), raw.select(F.inline("groups")).select("groupId", F.col("name").alias("set_name"), F.col("publishedOn").alias("release_date"))
    a = F.map_from_entries(F.transform(F.coalesce("extendedData", F.array()), lambda e: F.struct(e["name"], e["value"])))
    joined = p.withColumn("a", a).join(F.broadcast(s), "groupId")
    own = lambda k: F.col("a")[k]
    return joined.select(F.col("productId").alias("product_id"), "name", "set_name", "release_date", own("Rarity").alias("rarity"), F.array_compact(F.array(own("CardType"))).alias("types"), own("Description").alias("rules"), own("Number").alias("number"), F.col("a").alias("attributes"))


def rules_text(html: Column) -> Column:
    """Rules text without tags, typographic quotes and doubled spaces."""
    t = F.translate(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", " "), r"</?[A-Za-z][^<>\[]*>?", " "), " ‘’“”", " ''\"\"")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r" (?=[,.;:!?)])", "")
    return F.trim(F.regexp_replace(t, r"(?<=\() ", ""))


def _value(v: Column, kind: str) -> Column:
    text = F.trim(F.regexp_replace(v, r"\s+", " "))
    text = F.when((text != "") & (text != "None"), text)
    if kind == "int":
        return F.when(text.rlike(r"^-?\d+$"), text)
    if kind == "flag":
        return F.when(text == "Yes", "true").when(text == "No", "false")
    if kind == "rules":
        return F.nullif(rules_text(v), F.lit(""))
    if kind == "list":
        parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ";"))
        clean = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & (x != "None"))
        return F.when(F.size(clean) > 0, F.to_json(clean))
    return text


def base_name(name: Column, suffix: str = "") -> Column:
    """A product's name without tags in brackets at its end, and without ``suffix``; never empty."""
    short = F.trim(F.regexp_replace(name, r"(\s*(\([^()]*\)|\[[^\[\]]*\]))+\s*$", ""))
    short = F.trim(F.regexp_replace(short, suffix, "")) if suffix else short
    return F.regexp_replace(F.when(short == "", F.trim(name)).otherwise(short), r"\s+", " ")


def catalog_cards(products: DataFrame, game: Catalog) -> DataFrame:
    """(source_game, identity, source_id, name, raw_content, product_ids, numbers) of a catalogue's cards.

    A card is its number, where the game has a pattern for it, else its base name. Each field is what
    most printings have, of equal ones the newest printing's; where printings are marked as errata,
    only these vote. Rarity and set are those of the printing lowest on the ladder, then in the
    earliest set, then of the smallest id. An empty catalogue gives no rows.
    """
    number = F.nullif(F.regexp_extract(F.coalesce("number", F.lit("")), game.number, 0), F.lit("")) if game.number else F.lit(None).cast("string")
    types = F.filter(F.coalesce("types", F.array().cast("array<string>")), lambda t: t != "")
    p = products.withColumns({"card_number": number, "types": types, "base": base_name(F.col("name"), game.suffix)})
    typed = F.size("types") > 0
    p = p.where(typed | F.col("card_number").isNotNull() if game.untyped else typed)
    for column, pattern in (("set_name", game.no_sets), ("number", game.no_numbers)):
        p = p.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))) if pattern else p
    p = p.where(~F.arrays_overlap("types", F.array(*[F.lit(t) for t in game.no_types]))) if game.no_types else p
    plain = F.regexp_replace(F.lower("base"), r"\s*(,|\s-)\s+", " - ")
    p = p.withColumn("identity", F.coalesce(F.concat(F.lit("number:"), "card_number"), F.concat(F.lit("name:"), plain)))
    errata = p.withColumn("errata", F.contains("name", F.lit("(Errata Version)")))
    marked = errata.groupBy("identity").agg(F.bool_or("errata").alias("any_errata"))
    rank = F.array_position(F.array(*[F.lit(r) for r in game.ladder]), F.coalesce("rarity", F.lit("")))
    place = F.struct(F.when(rank > 0, rank).otherwise(len(game.ladder) + 1), F.coalesce("release_date", F.lit("￿")), "product_id")
    first = F.min_by(F.struct("product_id", "rarity", "set_name"), place)
    printed = F.regexp_extract(F.coalesce("number", F.lit("")), r"^\s*(\S+)", 1)
    groups = errata.groupBy("identity").agg(
        first.alias("r"), F.array_sort(F.collect_set("product_id")).alias("product_ids"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("product_id", "card_number", printed.alias("printed")))), lambda x: F.array(x["card_number"], x["printed"])))).alias("numbers"),
    )
    one_type = F.when(F.size("types") == 1, F.get("types", 0)).when(F.size("types") > 1, F.to_json("types"))
    values = [("type", one_type), *[(key, _value(F.col("attributes")[a], kind)) for a, key, kind in game.fields], ("text", F.nullif(rules_text(F.col("rules")), F.lit("")))]
    voters = errata.join(marked, "identity").where("errata or not any_errata")
    long = voters.select("identity", "product_id", F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values]))).where("value is not null")
    long = long.union(errata.select("identity", "product_id", F.lit("name"), "base"))
    votes = long.groupBy("identity", "key", "value").agg(F.count(F.lit(1)).alias("n"), F.max("product_id").alias("newest"))
    won = votes.groupBy("identity", "key").agg(F.max_by("value", F.struct("n", "newest", "value")).alias("value"))
    content = won.groupBy("identity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("voted"))
    extra = F.map_filter(F.create_map(F.lit("rarity"), F.col("r.rarity"), F.lit("set"), F.col("r.set_name")), lambda k, v: v.isNotNull() & (v != ""))
    out = groups.join(content, "identity")
    numbers = F.filter("numbers", lambda x: x.isNotNull() & (x != "")) if game.number else F.array().cast("array<string>")
    return out.select(F.lit(game.game).alias("source_game"), "identity", F.col("r.product_id").cast("string").alias("source_id"), F.col("voted")["name"].alias("name"), F.map_concat("voted", extra).alias("raw_content"), "product_ids", F.when(F.startswith("identity", F.lit("number:")), numbers).otherwise(F.array().cast("array<string>")).alias("numbers"))
