"""Labels that set a choice, an opening or a deck beside how the game went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .decks import options_and_pick
from .events import exclusion_reason, held_at
from .rates import side_delta


def tutor_rate(zones: DataFrame, game: list[str], card: str = "card", zone: str = "zone", deck: str = "deck", tutored: str = "tutored", with_tutor: bool = False) -> DataFrame:
    """(card, label, sample_count): of the games with the card in the deck, the share in which it was tutored.

    With ``with_tutor`` only games count in which some card was tutored: the rate of being chosen.
    Copies do not matter; a card that is in no deck has no row.
    """
    held = zones.where(F.col(zone) == deck).select(*game, card).distinct()
    hit = zones.where(F.col(zone) == tutored).select(*game, card).distinct()
    if with_tutor:
        held = held.join(hit.select(*game).distinct(), game, "left_semi")
    both = held.join(hit.withColumn("__hit", F.lit(1)), [*game, card], "left")
    g = both.groupBy(card).agg(F.sum(F.coalesce("__hit", F.lit(0))).alias("n"), F.count(F.lit(1)).alias("sample_count"))
    return g.select(card, (F.col("n") / F.col("sample_count")).alias("label"), "sample_count")


def side_sensitivity(games: DataFrame, first: str, won: str, deck: str = "deck_uuid") -> DataFrame:
    """Of each deck the win rate on the play minus that on the draw; null where it has one side only."""
    return side_delta(games, [deck], F.col(first), F.col(won))


def pool_conditioned_picks(rows: DataFrame, pools: DataFrame, keys: list[str], option: str, position: str, picked: Column, pool: str = "pool") -> DataFrame:
    """(keys, options, pick, pool): a pick with its options in order, and the cards taken before it.

    A pick without a pool row (the first one) has an empty pool.
    """
    picks = options_and_pick(rows, keys, option, position, picked)
    return picks.join(pools.select(*keys, pool), keys, "left").withColumn(pool, F.coalesce(F.transform(pool, lambda c: c.cast("string")), F.array().cast("array<string>")))


def copy_counts(bags: DataFrame, cards: str = "cards") -> DataFrame:
    """(deck_set_uuid, card, copies): each different card of a deck beside the address of its set of cards."""
    sets = bags.select(hashing.deck_uuid(F.array_distinct(cards)).alias("deck_set_uuid"), F.col(cards).alias("__cards"))
    one = sets.select("deck_set_uuid", "__cards", F.explode(F.array_distinct("__cards")).alias("card"))
    return one.select("deck_set_uuid", "card", F.size(F.filter("__cards", lambda c: c == F.col("card"))).alias("copies"))


def eventual_wins(decks: DataFrame, kingdoms: DataFrame, winners: DataFrame, game: str, player: str) -> DataFrame:
    """(partial_deck_uuid, kingdom_uuid, player_wins) of each player's deck before each turn; empty decks go."""
    d = decks.where(F.size("cards") > 0).select(game, player, hashing.deck_uuid(F.col("cards")).alias("partial_deck_uuid"))
    return _with_outcome(d, kingdoms, winners, game, player).select("partial_deck_uuid", "kingdom_uuid", F.col("won").alias("player_wins"))


def opening_outcomes(openings: DataFrame, kingdoms: DataFrame, winners: DataFrame, game: str, player: str, buys: str = "buys") -> DataFrame:
    """(opening_group_uuid, kingdom_uuid, won) of what each player bought first; nothing bought gives no row."""
    o = openings.where(F.size(buys) > 0).select(game, player, hashing.deck_uuid(F.col(buys)).alias("opening_group_uuid"))
    return _with_outcome(o, kingdoms, winners, game, player).select("opening_group_uuid", "kingdom_uuid", "won")


def _with_outcome(rows: DataFrame, kingdoms: DataFrame, winners: DataFrame, game: str, player: str) -> DataFrame:
    k = kingdoms.select(game, hashing.deck_uuid(F.col("kingdom")).alias("kingdom_uuid"))
    w = winners.select(game, F.col(player).alias("__winner"))
    return rows.join(k, game).join(w, game).withColumn("won", F.col(player) == F.col("__winner"))


def deck_picks(intervals: DataFrame, chosen: DataFrame, keys: list[str], card: str = "card", eligible: Column | None = None) -> DataFrame:
    """(keys, floor, deck, options, picked): a card of the deck that was removed or upgraded at a floor.

    ``intervals`` says when each copy came and went, ``chosen`` (keys, floor, card) what was taken.
    Options are the different eligible cards held just before; a choice that is not among them goes.
    """
    held = held_at(intervals.withColumn("__ok", F.lit(True) if eligible is None else eligible), chosen.select(*keys, "floor").distinct(), keys)
    bag = held.groupBy(*keys, "floor").agg(F.array_sort(F.collect_list(card)).alias("deck"), F.array_sort(F.collect_set(F.when(F.col("__ok"), F.col(card)))).alias("options"))
    picks = chosen.select(*keys, "floor", F.col(card).alias("picked"))
    return bag.join(picks, [*keys, "floor"]).where(F.array_contains("options", F.col("picked")))


def scored_runs(runs: DataFrame, mode: str = "game_mode", cheated: str = "is_cheated", abandoned: str = "was_abandoned", known: str = "n_known", standard: str = "standard") -> DataFrame:
    """Runs with ``exclusion``: the first reason for which a run is not scored, null where there is none."""
    ladder = [
        ("malformed", F.col(mode).isNull()), ("not_standard", F.col(mode) != standard), ("cheated", F.coalesce(cheated, F.lit(False))), ("abandoned", F.coalesce(abandoned, F.lit(False))),
        ("no_known_cards", F.coalesce(known, F.lit(0)) == 0),
    ]
    return runs.withColumn("exclusion", exclusion_reason(ladder))


def exclusion_tally(scored: DataFrame) -> DataFrame:
    """(exclusion, runs): how many runs each reason keeps out; scored ones under ``scored``."""
    return scored.groupBy(F.coalesce("exclusion", F.lit("scored")).alias("exclusion")).agg(F.count(F.lit(1)).alias("runs"))
