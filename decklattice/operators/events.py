"""Turn events: wide to long, per-turn hits, intervals, and decks as they were at a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt_turns(wide: DataFrame, keys: list[str], columns: dict[str, tuple[str, int]], separator: str = r"\|") -> DataFrame:
    """(keys, actor, turn, card): per-turn columns of card lists as rows; empty lists give none.

    ``columns`` maps a column to its (actor, turn).
    """
    entries = [F.struct(F.lit(a).alias("actor"), F.lit(t).alias("turn"), F.col(c).cast("string").alias("list")) for c, (a, t) in columns.items()]
    rows = wide.select(*keys, F.inline(F.array(*entries))).where("list is not null and list <> ''")
    return rows.select(*keys, "actor", "turn", F.explode(F.split("list", separator)).alias("card")).where("card <> ''")


def zone_presence(wide: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """(keys, card, n) of wide count columns; columns of one card are joined by their largest count."""
    rows = wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(card).alias("card"), F.col(c).cast("int").alias("n")) for c, card in columns.items()])))
    return rows.where("n > 0").groupBy(*keys, "card").agg(F.max("n").alias("n"))


def hit_rate(events: DataFrame, hits: DataFrame, half_turn: list[str], card: str, distinct_events: bool = True) -> DataFrame:
    """Share of a card's (half-turn) events whose half-turn is among ``hits``."""
    own = events.select(*half_turn, card).distinct() if distinct_events else events.select(*half_turn, card)
    hit = hits.select(*half_turn).distinct().withColumn("hit", F.lit(1))
    s = own.join(hit, half_turn, "left").groupBy(card).agg(F.sum(F.coalesce("hit", F.lit(0))).alias("num"), F.count(F.lit(1)).alias("den"))
    return s.select(card, (F.col("num") / F.col("den")).alias("rate"), F.col("den").alias("sample_count"))


def first_turn(events: DataFrame, game: list[str], card: str, turn: str = "turn") -> DataFrame:
    return events.groupBy(*game, card).agg(F.min(turn).alias("first_turn"))


def next_turn(turns: DataFrame, keys: list[str], turn: str, value: str) -> DataFrame:
    """Each turn with the value of exactly the next one; a gap yields no row."""
    after = turns.select(*keys, (F.col(turn) - 1).alias(turn), F.col(value).alias(f"next_{value}"))
    return turns.join(after, [*keys, turn])


def held_at(intervals: DataFrame, moments: DataFrame, keys: list[str], moment: str = "floor", added: str = "floor_added", left: str = "floor_left") -> DataFrame:
    """Cards held just before each moment: added before it and not left before it.

    An equi join on the keys, with the interval as a condition of the join.
    """
    i, m = intervals.alias("i"), moments.alias("m")
    on = [F.col(f"i.{k}") == F.col(f"m.{k}") for k in keys]
    held = (F.col(f"i.{added}") < F.col(f"m.{moment}")) & (F.col(f"i.{left}").isNull() | (F.col(f"i.{left}") >= F.col(f"m.{moment}")))
    return m.join(i, [*on, held]).select(*[F.col(f"m.{k}") for k in keys], F.col(f"m.{moment}"), *[F.col(f"i.{c}") for c in intervals.columns if c not in (*keys, moment)])


def deck_before(changes: DataFrame, keys: list[str], card: str, turn: str, order: str, delta: str) -> DataFrame:
    """(keys, card, turn, held): copies before each turn at which the card changes, and after the last.

    Changes run in order; a card that is not held cannot be trashed, so the count stops at zero.
    The floor needs no loop: the running sum, minus its lowest value so far where that is below 0.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, card).orderBy(turn, order).rowsBetween(Window.unboundedPreceding, 0)
    c = changes.withColumn("__sum", F.sum(delta).over(w))
    c = c.withColumn("__low", F.least(F.min("__sum").over(w), F.lit(0)))
    c = c.withColumn("__held", F.col("__sum") - F.col("__low"))
    return c.groupBy(*keys, card, turn).agg(F.max_by("__held", order).alias("held_after"))


def exclusion_reason(ladder: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds; null where none does."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(ladder):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def net_outcome(events: DataFrame, keys: list[str], kind: str, gained: list[str], lost: list[str]) -> DataFrame:
    """Per key: events of the gained kinds minus those of the lost ones."""
    sign = F.when(F.col(kind).isin(gained), 1).when(F.col(kind).isin(lost), -1).otherwise(0)
    return events.groupBy(*keys).agg(F.sum(sign).alias("net"))
