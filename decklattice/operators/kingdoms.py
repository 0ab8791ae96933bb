"""Kingdom games, floors and combat: labels that combine decks, turns and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing


def veto_pool(games: DataFrame, kingdom: str, vetoed: str) -> DataFrame:
    """(pool_uuid, pool, vetoed) of games with a veto: the kingdom together with what was vetoed."""
    pool = F.array_sort(F.array_union(kingdom, vetoed))
    return games.where(F.size(vetoed) > 0).select(hashing.deck_uuid(pool).alias("pool_uuid"), pool.alias("pool"), F.array_sort(vetoed).alias("vetoed"))


def placements(players: DataFrame, game: str, deck: str, rank: str, least: int = 3, most: int = 4) -> DataFrame:
    """(game, decks, ranks) of games of three or four: decks in order of their id, ranks beside them."""
    p = players.groupBy(game).agg(F.array_sort(F.collect_list(F.struct(deck, rank))).alias("x")).where(F.size("x").between(least, most))
    return p.select(game, F.transform("x", lambda e: e[deck]).alias("decks"), F.transform("x", lambda e: e[rank]).alias("ranks"))


def member_labels(games: DataFrame, key: str, kingdom: str, winner: str) -> DataFrame:
    """(key, card, in_winner, copies) for every kingdom card; ``winner`` is a map of card to copies."""
    rows = games.select(key, F.explode(kingdom).alias("card"), F.col(winner).alias("w"))
    return rows.select(key, "card", F.map_contains_key("w", F.col("card")).alias("in_winner"), F.coalesce(F.try_element_at("w", F.col("card")), F.lit(0)).alias("copies"))


def ending_type(piles: Column, top: str = "Province", rich: str = "Colony", three: int = 3) -> Column:
    """How a game ended, from the piles that were empty."""
    return F.when(F.array_contains(piles, rich), "colonies").when(F.array_contains(piles, top), "provinces").when(F.size(piles) >= three, "piles").otherwise("other")


def ending_piles(games: DataFrame, key: str, kingdom: str, empty: str) -> DataFrame:
    """(key, card, emptied) for every kingdom card."""
    return games.select(key, F.explode(kingdom).alias("card"), F.col(empty).alias("e")).select(key, "card", F.array_contains("e", F.col("card")).alias("emptied"))


def opening_buys(moves: DataFrame, keys: list[str], turns: int = 2) -> DataFrame:
    """(keys, buys): what a player bought in the first turns, sorted."""
    b = moves.where((F.col("verb") == "buys") & (F.col("turn") <= turns))
    return b.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(card, n)")))).alias("buys"))


def changes(moves: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """Deck changes in order: the start as turn 0, buys and gains up, trashes down."""
    delta = F.when(F.col("verb").isin("buys", "gains"), F.col("n")).when(F.col("verb") == "trashes", -F.col("n"))
    moved = moves.select(*keys, "card", "turn", "at", delta.alias("delta")).where("delta is not null")
    return start.select(*keys, "card", F.lit(0).alias("turn"), F.lit(0).alias("at"), F.col("n").alias("delta")).unionByName(moved)


def partial_decks(changed: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, turn, cards) before each turn of ``turns``: gains minus trashes of earlier turns, in order."""
    from .events import deck_before

    held = deck_before(changed, keys, "card", "turn", "at", "delta").withColumnRenamed("turn", "since")
    asked = turns.select(*keys, "turn")
    latest = asked.join(held, keys).where("since < turn").groupBy(*keys, "turn", "card").agg(F.max_by("held_after", "since").alias("n")).where("n > 0")
    return latest.groupBy(*keys, "turn").agg(F.flatten(F.array_sort(F.collect_list(F.expr("array_repeat(card, cast(n as int))")))).alias("cards"))


def mid_game_pairs(decks: DataFrame, game: str, player: str, winner: DataFrame) -> DataFrame:
    """(lo, hi, lo_won): both players' partial decks at each shared turn; equal decks are skipped."""
    d = decks.select(game, player, "turn", hashing.deck_uuid(F.col("cards")).alias("deck"))
    a = d.select(game, "turn", F.col(player).alias("pa"), F.col("deck").alias("a"))
    b = d.select(game, "turn", F.col(player).alias("pb"), F.col("deck").alias("b"))
    both = a.join(b, [game, "turn"]).where("pa < pb and a <> b").join(winner.select(game, F.col(player).alias("w")), game)
    won = F.when(F.col("a") < F.col("b"), F.col("w") == F.col("pa")).otherwise(F.col("w") == F.col("pb"))
    return both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), won.alias("lo_won"))


def next_cards(moves: DataFrame, decks: DataFrame, keys: list[str], verb: str) -> DataFrame:
    """(keys, turn, cards, next): the distinct cards bought or trashed on each turn, with the deck before it."""
    n = moves.where(F.col("verb") == verb).groupBy(*keys, "turn").agg(F.array_sort(F.collect_set("card")).alias("next"))
    return decks.join(n, [*keys, "turn"])


def floor_choices(choices: DataFrame, known: DataFrame, keys: list[str], card: str = "card") -> DataFrame:
    """(keys, floor, offered, picked) of rewards: picked is null when all were left; unknown cards drop the row."""
    rows = choices.join(known.select(F.col(card), F.lit(True).alias("__known")), card, "left")
    g = rows.groupBy(*keys, "floor").agg(F.array_sort(F.collect_list(F.struct("at", card, "was_picked"))).alias("x"), F.count("__known").alias("k"))
    g = g.where(F.col("k") == F.size("x"))
    return g.select(*keys, "floor", F.transform("x", lambda e: e[card]).alias("offered"), F.get(F.filter("x", lambda e: e["was_picked"]), 0)[card].alias("picked"))


def shop_purchases(choices: DataFrame, keys: list[str], card: str = "card") -> DataFrame:
    """(keys, floor, step, offered, picked): purchases one after another, each out of what is left."""
    g = choices.groupBy(*keys, "floor").agg(F.array_sort(F.collect_list(F.struct("at", card, "was_picked"))).alias("x"))
    bought = F.filter("x", lambda e: e["was_picked"])
    g = g.select(*keys, "floor", "x", F.posexplode(bought).alias("step", "b"))
    left = F.filter("x", lambda e: ~e["was_picked"] | (e["at"] >= F.col("b.at")))
    return g.select(*keys, "floor", "step", F.transform(left, lambda e: e[card]).alias("offered"), F.col(f"b.{card}").alias("picked"))


def aggression(events: DataFrame, games: DataFrame, game: list[str], kind: str = "field") -> DataFrame:
    """(game, attackers_per_attack): attackers per half-turn with an attack; 0 where none was made."""
    a = events.where(F.col(kind) == "creatures_attacked").groupBy(*game, "turn").agg(F.count(F.lit(1)).alias("n"))
    per = a.groupBy(*game).agg(F.avg("n").alias("x"))
    return games.select(*game).distinct().join(per, game, "left").select(*game, F.coalesce("x", F.lit(0.0)).alias("attackers_per_attack"))


def combat_outcomes(events: DataFrame, half_turn: list[str], kind: str = "field", card: str = "card") -> DataFrame:
    """(half turn, attackers, blockers, net): per attack who fought, and kills from the attacker's view."""
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col(kind) == name, F.col(card))))
    count = lambda name: F.sum((F.col(kind) == name).cast("int"))
    g = events.groupBy(*half_turn).agg(of("creatures_attacked").alias("attackers"), of("creatures_blocking").alias("blockers"), (count("oppo_creatures_killed_combat") - count("user_creatures_killed_combat")).alias("net"))
    return g.where(F.size("attackers") > 0)
