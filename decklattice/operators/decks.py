"""Decks as bags: content addresses, labels, masked cards, options and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, scalars


def decks_of(copies: DataFrame, deck: list[str], card: str) -> DataFrame:
    """(deck keys, cards, deck_uuid): the bag of each deck, sorted, and its content address."""
    bags = copies.groupBy(*deck).agg(F.array_sort(F.collect_list(F.col(card).cast("string"))).alias("cards"))
    return bags.withColumn("deck_uuid", hashing.deck_uuid(F.col("cards")))


def distinct_decks(bags: DataFrame) -> DataFrame:
    """Each distinct bag once, first writer by nothing but content."""
    return bags.groupBy("deck_uuid").agg(F.first("cards").alias("cards"))


def card_counts(copies: DataFrame, deck: list[str], card: str, most: int = 255) -> DataFrame:
    """(deck, entries): card and count in order of the card, counts clipped."""
    n = copies.groupBy(*deck, card).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"))
    return n.groupBy(*deck).agg(F.array_sort(F.collect_list(F.struct(F.col(card).alias("card"), "n"))).alias("entries"))


def deck_labels(bags: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, deck_uuid, label): labels of runs or games on their deck's address."""
    return bags.select(*keys, "deck_uuid").join(labels, keys)


def masked_card(bags: DataFrame, seed: str, eligible: Column | None = None) -> DataFrame:
    """One seeded card of each deck taken out: target_card and the rest of the bag."""
    own = F.array_distinct("cards") if eligible is None else F.filter(F.array_distinct("cards"), lambda c: F.array_contains(eligible, c))
    ranked = F.array_sort(F.transform(own, lambda c: F.struct(F.sha2(F.concat(F.lit(seed + ":"), F.col("deck_uuid"), F.lit(":"), c), 256).alias("k"), c.alias("c"))))
    out = bags.withColumn("target_card", F.get(ranked, 0)["c"]).where("target_card is not null")
    return out.withColumn("rest", scalars.remove_one(F.col("cards"), F.col("target_card")))


def options_and_pick(rows: DataFrame, keys: list[str], option: str, position: str, picked: Column) -> DataFrame:
    """(keys, options, pick): the options in order of position, and the one that was picked (or null)."""
    s = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(option).cast("string").alias("o"), picked.alias("p")))).alias("x"))
    return s.select(*keys, F.transform("x", lambda e: e["o"]).alias("options"), F.get(F.filter("x", lambda e: e["p"]), 0)["o"].alias("pick"))


def canonical_pair(rows: DataFrame, a: str, b: str, a_won: Column) -> DataFrame:
    """Two sides in order of their ids, the label swapped with them."""
    swapped = F.col(a) > F.col(b)
    return rows.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(swapped, ~a_won).otherwise(a_won).alias("lo_won"))


def mirrored(rows: DataFrame, seed: str, share: float = 0.5) -> DataFrame:
    """A seeded share of the pairs with sides and label swapped."""
    swap = hashing.unit(seed, F.concat_ws(":", "lo", "hi")) < share
    return rows.select(F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("a"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("b"), F.when(swap, ~F.col("lo_won")).otherwise(F.col("lo_won")).alias("a_won"))


def dropout(bags: DataFrame, seed: str, drop: float) -> DataFrame:
    """Each copy dropped with a probability, at least one kept."""
    keyed = F.transform("cards", lambda c, i: F.struct(hashing.unit(seed, F.concat_ws(":", F.col("deck_uuid"), c, i.cast("string"))).alias("u"), c.alias("c")))
    kept = F.transform(F.filter(keyed, lambda e: e["u"] >= drop), lambda e: e["c"])
    return bags.withColumn("cards", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.array_max(keyed)["c"])))


def subsample(bags: DataFrame, seed: str, share: float) -> DataFrame:
    """max(1, round(share * n)) copies of each deck by seeded rank, in their order."""
    keyed = F.transform("cards", lambda c, i: F.struct(hashing.rank_key(seed, F.concat_ws(":", F.col("deck_uuid"), i.cast("string"))).alias("k"), i.alias("i"), c.alias("c")))
    n = F.greatest(F.lit(1), F.round(F.size("cards") * F.lit(share)).cast("int"))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(keyed), F.lit(1), n), lambda e: F.struct(e["i"], e["c"])))
    return bags.withColumn("cards", F.transform(kept, lambda e: e["c"]))
