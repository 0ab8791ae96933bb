"""Training views: metrics joined with cards and decks of the visible tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing


def card_view(metric: DataFrame, cards: DataFrame, key: str, visible: Column | None = None) -> DataFrame:
    """One card per row with its label (V1)."""
    c = cards if visible is None else cards.where(visible)
    return metric.join(c, key)


def deck_view(metric: DataFrame, bags: DataFrame, cards: DataFrame, deck: str, card: str, visible: Column | None = None) -> DataFrame:
    """A deck's visible cards with its label (V2): one shuffle by card, one by deck."""
    c = cards if visible is None else cards.where(visible)
    long = bags.select(deck, F.posexplode("cards").alias("at", card)).join(c, card)
    whole = long.groupBy(deck).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", card))), lambda e: e[card]).alias("cards"))
    return metric.join(whole, deck)


def two_deck_view(metric: DataFrame, decks: DataFrame, a: str, b: str, deck: str = "deck_uuid") -> DataFrame:
    """Two decks with a label (V3)."""
    one = decks.select(F.col(deck).alias(a), F.col("cards").alias("cards_a"))
    two = decks.select(F.col(deck).alias(b), F.col("cards").alias("cards_b"))
    return metric.join(one, a).join(two, b)


def option_view(rows: DataFrame, options: str, pick: str, known: DataFrame | None = None, key: str = "card") -> DataFrame:
    """Options with the place of the pick from 0 (V4); rows without it, or with an unknown option, go."""
    out = rows.withColumn("pick_index", F.array_position(F.col(options), F.col(pick)) - 1).where("pick_index >= 0")
    if known is None:
        return out
    w = out.withColumn("__id", F.sha2(F.to_json(F.struct(*out.columns)), 256))  # the same whenever a task is run again
    bad = w.select("__id", F.explode(options).alias(key)).join(known.select(key), key, "left_anti").select("__id").distinct()
    return w.join(bad, "__id", "left_anti").drop("__id")


def masked_card_view(metric: DataFrame, cards: DataFrame, key: str, content: str, field: str) -> DataFrame:
    """Cards with the labelled field masked in their JSON content."""
    from ..functions.scalars import json_masked

    return metric.join(cards, key).withColumn(content, json_masked(F.col(content), field))


def split_views(view: DataFrame, seed: str, group: str, ratios: dict[str, float]) -> DataFrame:
    """The view with ``split``, decided by the group, so that a group is never divided."""
    return view.withColumn("split", hashing.split_of(seed, F.col(group), ratios))


def same_deck_pairs(items: DataFrame, deck: str, card: str, per_deck: int, seed: str) -> DataFrame:
    """(deck, a, b): ordered pairs of up to ``per_deck`` seeded cards of a deck."""
    from .sampling import capped

    some = capped(items.select(deck, card).distinct(), seed, card, [deck], per_deck)
    return some.select(deck, F.col(card).alias("a")).join(some.select(deck, F.col(card).alias("b")), deck).where("a <> b")


def slices(bags: DataFrame, seed: str, size: int, count: int) -> DataFrame:
    """Seeded disjoint slices of each deck that has enough distinct cards: ``slices`` array<array>."""
    keyed = F.array_sort(F.transform(F.array_distinct("cards"), lambda c: F.struct(hashing.rank_key(seed, F.concat_ws(":", F.col("deck_uuid"), c)).alias("k"), c.alias("c"))))
    order = F.transform(keyed, lambda e: e["c"])
    out = bags.withColumn("__order", order).where(F.size("__order") >= size * count)
    return out.withColumn("slices", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice("__order", i * size + 1, size))).drop("__order")


def missing_card(bags: DataFrame, seed: str, size: int) -> DataFrame:
    """(deck_uuid, slice, missing): a slice of a deck and a card of the deck outside it."""
    s = slices(bags, seed, size + 1, 1)
    return s.select("deck_uuid", F.slice(F.get("slices", 0), 1, size).alias("slice"), F.element_at(F.get("slices", 0), -1).alias("missing"))


def odd_one_out(bags: DataFrame, seed: str, size: int) -> DataFrame:
    """(deck_uuid, cards, intruder): a slice with a card of the next deck in seeded order."""
    s = slices(bags, seed, size, 1).withColumn("k", hashing.bucket32(seed, F.col("deck_uuid")))
    w = Window.partitionBy(F.pmod("k", F.lit(64))).orderBy("k", "deck_uuid")
    s = s.withColumn("donor", F.lead("cards").over(w))
    free = F.array_sort(F.array_except("donor", "cards"))
    s = s.withColumn("intruder", F.get(free, 0)).where("intruder is not null")
    return s.select("deck_uuid", F.get("slices", 0).alias("cards"), "intruder")


def rounds_summary(rounds: DataFrame, names: str, loss: str, baseline: str) -> DataFrame:
    """(round, mean_normalised): mean loss over baseline per round."""
    return rounds.groupBy("round").agg(F.avg(F.col(loss) / F.col(baseline)).alias("mean_normalised"), F.count(names).alias("views"))


def best_round(rounds: DataFrame, name: str, loss: str) -> DataFrame:
    return rounds.groupBy(name).agg(F.min_by("round", F.struct(loss, "round")).alias("best_round"), F.min(loss).alias("best_loss"))


def saturated(rounds: DataFrame, name: str, loss: str, patience: int, delta: float) -> DataFrame:
    """(name, round, saturated): no round of the last ``patience`` was better by ``delta`` than the best before."""
    past = Window.partitionBy(name).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    r = rounds.withColumn("__better", F.coalesce(F.col(loss) < F.min(loss).over(past) - delta, F.lit(True)))
    last = Window.partitionBy(name).orderBy("round").rowsBetween(-(patience - 1), 0)
    seen = F.count(F.lit(1)).over(last)
    return r.select(name, "round", ((seen == patience) & ~F.max("__better").over(last)).alias("saturated"))


def quarantined(results: DataFrame, name: str, order: str, failed: Column, most: int) -> DataFrame:
    """Names whose last results failed so many times in a row."""
    w = Window.partitionBy(name).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    r = results.withColumn("__ok", F.max((~failed).cast("int")).over(w))
    return r.where("__ok = 0").groupBy(name).agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= most)
