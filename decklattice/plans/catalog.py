"""The label tables by name: each a parameterisation of one operator.

A family says how its raw rows look (keys, copies of cards, values); a label says which operator it
is, over which column or condition. ``build`` turns a label into a DataFrame over the family's
prepared tables, so a new label is a line here and not a new operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import decks, rates
from ..operators.rates import RateSpec


@dataclass(frozen=True)
class Label:
    """One label table: operator kind, and its SQL expressions over the family's rows."""

    kind: str
    value: str = ""
    where: str = ""
    keys: tuple[str, ...] = ()
    most: int | None = None
    classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Family:
    """Prepared tables of a family: ``copies`` (one row per copy in a deck), ``rows`` (one per run, game or pick)."""

    game: tuple[str, ...]
    card: str
    copies: DataFrame | None = None
    rows: DataFrame | None = None


def _where(frame: DataFrame, condition: str) -> DataFrame:
    return frame.where(condition) if condition else frame


def card_mean(f: Family, x: Label) -> DataFrame:
    return rates.mean_per_copy(_where(f.copies, x.where), f.card, F.expr(x.value))


def card_shares(f: Family, x: Label) -> DataFrame:
    return rates.share_by_class(f.copies, f.card, x.value, list(x.classes))


def deck_label(f: Family, x: Label) -> DataFrame:
    bags = decks.decks_of(f.copies, list(f.game), f.card)
    value = F.expr(x.value)
    if x.classes:
        value = scalars.closed_class(value, list(x.classes))
    labels = _where(f.rows, x.where).select(*f.game, value.alias("label"))
    return decks.deck_labels(bags, labels, list(f.game))


def card_rate(f: Family, x: Label) -> DataFrame:
    keys = list(x.keys) or [f.card]
    return rates.rate(_where(f.rows, x.where), RateSpec(keys, F.expr(x.value).cast("int")))


def presence_rate(f: Family, x: Label) -> DataFrame:
    seen = rates.presence(_where(f.copies, x.where), list(f.game), f.card)
    return rates.rate(seen.join(f.rows, list(f.game)), RateSpec([f.card], F.expr(x.value).cast("int")))


def presence_delta(f: Family, x: Label) -> DataFrame:
    seen = rates.presence(f.copies, list(f.game), f.card).join(f.rows, list(f.game))
    return rates.delta_to_mean(seen, f.card, F.expr(x.value), f.rows, F.expr(x.value))


def side_delta(f: Family, x: Label) -> DataFrame:
    seen = rates.presence(f.copies, list(f.game), f.card).join(f.rows, list(f.game))
    return rates.side_delta(seen, list(x.keys) or [f.card], F.expr(x.where), F.expr(x.value))


def masked_class(f: Family, x: Label) -> DataFrame:
    return _where(f.rows, x.where).select(f.card, scalars.closed_class(F.expr(x.value), list(x.classes)).alias("label")).where("label is not null")


def masked_number(f: Family, x: Label) -> DataFrame:
    return _where(f.rows, x.where).select(f.card, scalars.printed_number(F.expr(x.value).cast("string"), x.most).alias("label")).where("label is not null")


def masked_first(f: Family, x: Label) -> DataFrame:
    """The first class, in the order of the list, that the card's words have."""
    return _where(f.rows, x.where).select(f.card, scalars.first_of(F.expr(x.value), list(x.classes)).alias("label"))


def masked_set(f: Family, x: Label) -> DataFrame:
    return _where(f.rows, x.where).select(f.card, scalars.multi_hot(F.expr(x.value), list(x.classes)).alias("labels"))


KINDS: dict[str, Callable[[Family, Label], DataFrame]] = {
    "card_mean": card_mean, "card_shares": card_shares, "deck_label": deck_label, "card_rate": card_rate, "presence_rate": presence_rate,
    "presence_delta": presence_delta, "side_delta": side_delta, "masked_class": masked_class, "masked_number": masked_number, "masked_set": masked_set, "masked_first": masked_first,
}


def build(family: Family, label: Label) -> DataFrame:
    return KINDS[label.kind](family, label)


#: Values of a finished run, as column of the run and name of the label.
RUN_VALUES = {
    "RelicCount": "relic_count", "TotalDamageTaken": "total_damage_taken", "DeckSize": "deck_size", "TotalCardsPicked": "total_cards_picked", "TotalTurns": "total_turns",
    "ElitesKilled": "elites_killed", "FloorsCleared": "floors_cleared", "TotalCombats": "total_combats", "WinRate": "cast(win as int)",
}

#: Runs of a deck builder: rows have the values above, copies also upgraded, floor and act2_floor.
RUNS: dict[str, Label] = {f"Card{k}Metric": Label("card_mean", v) for k, v in RUN_VALUES.items()} | {
    "CardUpgradeRateMetric": Label("card_mean", "cast(upgraded as int)"),
    "CardWinRateAtAct2Metric": Label("card_mean", "cast(win as int)", "act2_floor is not null and floor <= act2_floor"),
    "CardCharacterPredictionMetric": Label("card_shares", "character"),
    "AscensionPredictionMetric": Label("deck_label", "ascension"),
    "CharacterPredictionMetric": Label("deck_label", "character"),
    "KilledByMetric": Label("deck_label", "killed_by", "not win"),
    "WinMetric": Label("deck_label", "win"),
    "TotalCardsSkippedMetric": Label("deck_label", "total_cards_skipped"),
} | {f"{k}Metric": Label("deck_label", v) for k, v in RUN_VALUES.items() if k not in ("DeckSize", "WinRate")}

#: Limited games: rows have won, on_play, num_turns and rank; copies have a zone.
GAMES: dict[str, Label] = {
    "WinRateWhenInDeckMetric": Label("presence_rate", "won", "zone = 'deck'"),
    "OpeningHandWinRateMetric": Label("presence_rate", "won", "zone = 'opening_hand'"),
    "DrawnWinRateMetric": Label("presence_rate", "won", "zone in ('opening_hand', 'drawn')"),
    "GameLengthAssociationMetric": Label("presence_delta", "num_turns"),
    "OnPlayWinRateDeltaMetric": Label("side_delta", "won", "on_play"),
    "DeckWinPredictionMetric": Label("deck_label", "won"),
    "DeckGameLengthPredictionMetric": Label("deck_label", "num_turns"),
    "DeckRankTierPredictionMetric": Label("deck_label", "rank", classes=("bronze", "silver", "gold", "platinum", "diamond", "mythic")),
}

#: Draft picks: one row per option of a pack with whether it was picked.
DRAFTS: dict[str, Label] = {
    "CardTakeRateMetric": Label("card_rate", "picked", keys=("card", "pack_number", "pick_number")),
    "FirstPickRateMetric": Label("card_rate", "picked", "pack_number = 0 and pick_number = 0"),
    "RankStratifiedTakeRateMetric": Label("card_rate", "picked", "rank is not null and rank <> ''", ("card", "rank", "pack_number", "pick_number")),
}

#: Kingdom games: one row per card on offer (or in a deck) with what became of it.
KINGDOMS: dict[str, Label] = {
    "AverageCopiesBoughtMetric": Label("card_mean", "copies", "copies >= 1"),
    "VetoRateMetric": Label("card_rate", "vetoed", "game_has_veto"),
    "OpeningBuyRateMetric": Label("card_rate", "opened"),
    "PileExhaustionRateMetric": Label("card_rate", "pile_empty"),
    "TurnCountAssociationMetric": Label("presence_delta", "winner_turns"),
    "KingdomGameLengthMetric": Label("deck_label", "winner_turns", "not any_resigned"),
    "FullDeckWinPredictionMetric": Label("deck_label", "rank = 1"),
}

# The closed vocabularies of card fields, in order.
MTG_TYPES = ("Creature", "Planeswalker", "Land", "Instant", "Sorcery", "Artifact", "Enchantment")
ENERGY = ("Grass", "Fire", "Water", "Lightning", "Psychic", "Fighting", "Darkness", "Metal", "Fairy", "Dragon", "Colorless")
STAGES = ("Basic", "Stage 1", "Stage 2")
HS_CLASSES = ("NEUTRAL", "DEATHKNIGHT", "DEMONHUNTER", "DRUID", "HUNTER", "MAGE", "PALADIN", "PRIEST", "ROGUE", "SHAMAN", "WARLOCK", "WARRIOR", "MULTICLASS")
HS_TRIBES = ("BEAST", "UNDEAD", "ELEMENTAL", "MECHANICAL", "DRAGON", "DEMON", "DRAENEI", "PIRATE", "MURLOC", "NAGA", "TOTEM", "QUILBOAR")
HS_SCHOOLS = ("SHADOW", "NATURE", "HOLY", "FIRE", "ARCANE", "FROST", "FEL", "NONE")
FAB_CLASSES = ("Generic", "Warrior", "Guardian", "Mechanologist", "Runeblade", "Brute", "Ninja", "Assassin", "Illusionist", "Wizard", "Ranger", "Pirate", "Necromancer")
FAB_RARE_CLASSES = ("Bard", "Adjudicator", "Merchant", "Shapeshifter", "Thief")
FAB_TYPES = ("Attack Reaction", "Defense Reaction", "Action", "Instant", "Equipment", "Weapon", "Hero", "Block", "Token")
SPIRE_RARITIES = ("Basic", "Common", "Uncommon", "Rare", "Ancient")
SPIRE_COLORS = ("ironclad", "silent", "defect", "necrobinder", "regent", "colorless")
GWENT_FACTIONS = ("neutral", "syndicate", "monster", "scoiatael", "nilfgaard", "northern_realms", "skellige")
GWENT_SETS = ("baseset", "crimsoncurse", "novigrad", "cursed toad", "iron judgment", "price of power", "unmillable", "uroboros", "way of the witcher", "master mirror", "merchants of ofir", "thronebreaker")
DOMINION_TYPES = ("Action", "Event", "Treasure", "Ally", "Landmark", "Way", "Project", "Victory", "Trait", "Prophecy", "Night", "Hex", "Boon")
DOMINION_GROUPS = ("Augurs", "Clashes", "Forts", "Odysseys", "Townsfolk", "Wizards", "Catapult - Rocks", "Encampment - Plunder", "Gladiator - Fortune", "Patrician - Emporium", "Settlers - Bustling Village", "Sauna - Avanto")
DOMINION_SETS = ("dominion", "intrigue", "seaside", "alchemy", "prosperity", "cornucopia", "hinterlands", "darkAges", "adventures", "empires", "nocturne", "renaissance", "menagerie", "allies", "plunder", "risingSun", "promo")
DOMINION_SET_NAMES = {"cornucopiaAndGuilds": "cornucopia", "animals": "menagerie"}


def _sql(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


#: The words before " - " of a type box, and the two-word card types among them.
_BOX = "array_remove(split(split(typebox, ' - ')[0], '[\\\\s|/]+'), '')"
_BOX_TYPES = f"concat({_BOX}, filter(array('Attack Reaction', 'Defense Reaction'), t -> contains(split(typebox, ' - ')[0], t)))"
_BOX_CLASSES = f"array_intersect({_BOX}, array({_sql(FAB_CLASSES + FAB_RARE_CLASSES)}))"
#: A coin cost: digits, or digits and a mark; an empty one is 0 beside a potion cost.
_COINS = "if(cost = '' and potcost is not null, '0', regexp_extract(cost, '^([0-9]+)[*+]?$', 1))"
#: The expansions that set tags stand for, editions taken off.
_RENAMED = "".join(f"when '{a}' then '{b}' " for a, b in DOMINION_SET_NAMES.items())
_TAG = "regexp_replace(t, '(1stEdition|2ndEdition)(Removed|Upgrade)?$', '')"
_HOME = f"array_distinct(transform(cardset_tags, t -> case {_TAG} {_RENAMED}else {_TAG} end))"

#: Masked fields of single cards, by game: fields of the parsed content.
MASKED: dict[str, dict[str, Label]] = {
    "mtg": {
        "CmcRegressionMetric": Label("masked_number", "cast(cmc as int)", "mana_cost is not null and faces = 1"),
        "CardTypeMaskMetric": Label("masked_first", "split(split(type_line, ' — ')[0], ' ')", "faces = 1 and type_line is not null", classes=MTG_TYPES),
        "RarityMaskMetric": Label("masked_class", "rarity", classes=("common", "uncommon", "rare", "mythic")),
        "ColorsMaskMetric": Label("masked_set", "colors", classes=("W", "U", "B", "R", "G")),
        "PowerRegressionMetric": Label("masked_number", "power", most=20),
        "ToughnessRegressionMetric": Label("masked_number", "toughness", most=20),
    },
    "pokemon": {
        "HpRegressionMetric": Label("masked_number", "hp", "supertype = 'Pokémon'"),
        "TypesMaskMetric": Label("masked_set", "types", "supertype = 'Pokémon' and types is not null", classes=ENERGY),
        "StageMaskMetric": Label("masked_first", "subtypes", "supertype = 'Pokémon' and subtypes is not null", classes=STAGES),
        "RetreatCostRegressionMetric": Label("masked_number", "convertedRetreatCost", "supertype = 'Pokémon'"),
        "WeaknessMaskMetric": Label("masked_class", "weaknesses[0]", "supertype = 'Pokémon' and size(weaknesses) > 0", classes=ENERGY),
    },
    "hearthstone": {
        "CostRegressionMetric": Label("masked_number", "cost", most=20),
        "AttackRegressionMetric": Label("masked_number", "attack", "type = 'MINION'", most=20),
        "HealthRegressionMetric": Label("masked_number", "health", "type = 'MINION'", most=20),
        "ClassMaskMetric": Label("masked_class", "if(classes is not null, 'MULTICLASS', cardClass)", classes=HS_CLASSES),
        "RarityMaskMetric": Label("masked_class", "rarity", classes=("FREE", "COMMON", "RARE", "EPIC", "LEGENDARY")),
        "CardTypeMaskMetric": Label("masked_class", "type", classes=("MINION", "SPELL", "WEAPON", "LOCATION", "HERO")),
        "RacesMaskMetric": Label("masked_set", f"if(array_contains(races, 'ALL'), array({_sql(HS_TRIBES)}), coalesce(races, array()))", "type = 'MINION'", classes=HS_TRIBES),
        "SpellSchoolMaskMetric": Label("masked_class", "coalesce(spellSchool, 'NONE')", "type = 'SPELL'", classes=HS_SCHOOLS),
    },
    "flesh_and_blood": {
        "PitchMaskMetric": Label("masked_class", "pitch", "pitch in ('1', '2', '3') and back_face is null", classes=("1", "2", "3")),
        "CostRegressionMetric": Label("masked_number", "cost", "back_face is null", most=20),
        "PowerRegressionMetric": Label("masked_number", "power", "back_face is null", most=20),
        "DefenseRegressionMetric": Label("masked_number", "defense", "back_face is null", most=20),
        "ClassMaskMetric": Label("masked_class", f"case size({_BOX_CLASSES}) when 0 then 'Classless' when 1 then {_BOX_CLASSES}[0] else 'Multiclass' end", "typebox is not null and back_face is null", classes=(*FAB_CLASSES, "Classless", "Multiclass")),
        "CardTypeMaskMetric": Label("masked_first", _BOX_TYPES, "typebox is not null and back_face is null", classes=FAB_TYPES),
    },
    "spire": {
        "CostMaskMetric": Label("masked_class", "cast(cost as string)", "cost >= 0", classes=("0", "1", "2", "3")),
        "CardTypeMaskMetric": Label("masked_class", "type", "type in ('Attack', 'Skill', 'Power')", classes=("Attack", "Skill", "Power")),
        "RarityMaskMetric": Label("masked_class", "rarity", f"rarity in ({_sql(SPIRE_RARITIES)})", classes=SPIRE_RARITIES),
        "ColorMaskMetric": Label("masked_class", "color", f"color in ({_sql(SPIRE_COLORS)})", classes=SPIRE_COLORS),
    },
    "gwent": {
        "ColorMaskMetric": Label("masked_class", "color", classes=("gold", "bronze", "leader")),
        "FactionMaskMetric": Label("masked_class", "faction", classes=GWENT_FACTIONS),
        "RarityMaskMetric": Label("masked_class", "rarity", classes=("legendary", "epic", "rare", "common")),
        "SetMaskMetric": Label("masked_class", "`set`", classes=GWENT_SETS),
        "TypeMaskMetric": Label("masked_class", "type", classes=("unit", "special", "artifact", "ability", "stratagem")),
        "PowerMaskMetric": Label("masked_class", "cast(power as string)", "type = 'unit'", classes=tuple(str(i) for i in range(18))),
        "ArmorMaskMetric": Label("masked_class", "cast(armor as string)", "type = 'unit'", classes=tuple(str(i) for i in range(6))),
        "ProvisionMaskMetric": Label("masked_class", "cast(provision as string)", "type <> 'stratagem'", classes=tuple(str(i) for i in range(4, 16))),
    },
    "dominion": {
        "CostRegressionMetric": Label("masked_number", _COINS, f"name not in ({_sql(DOMINION_GROUPS)})"),
        "TypeMaskMetric": Label("masked_class", "types[0]", classes=DOMINION_TYPES),
        "SetMaskMetric": Label("masked_class", f"{_HOME}[0]", f"size({_HOME}) = 1 and {_HOME}[0] not in ('base', 'guilds')", classes=DOMINION_SETS),
    },
}
