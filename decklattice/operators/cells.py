"""Cells of training views: label rows joined with the cards and decks that a tier may see.

A cell is the form of what goes in (a card, a deck, two groups, options) and of the label that comes
out. Rows whose cards the tier does not see go; of a deck or group only the cards it sees stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """Where a row names some cards: a ``deck`` column, a ``card`` column, or ``cards`` (an array)."""

    kind: str
    column: str
    distinct: bool = False
    without: str = ""  # a column with a card of which no copy stays
    may_be_empty: bool = False


@dataclass(frozen=True)
class View:
    """One training view: its cell, the label table it reads and that table's columns."""

    cell: str
    metric: str
    label: str = "label"
    key: str = "card_uuid"
    groups: tuple[Group, ...] = ()
    classes: tuple[str, ...] = ()
    cap: float | None = None
    least: int = 0
    counts: str = ""
    can_skip: bool = False
    swap: bool = False
    split_by: str = ""
    balance_by: str = ""
    masks: str = ""


def _with_ids(rows: DataFrame, groups: tuple[Group, ...], decks: DataFrame | None) -> DataFrame:
    """Adds ``g0``, ``g1``, ...: the card ids of each group, in order; rows of an unknown deck go."""
    for k, g in enumerate(groups):
        if g.kind == "deck":
            bag = decks.select(F.col("deck_uuid").alias(g.column), F.col("cards").alias(f"g{k}"))
            rows = rows.join(bag, g.column)
        else:
            ids = F.col(g.column) if g.kind == "cards" else F.array(g.column)
            rows = rows.withColumn(f"g{k}", F.coalesce(ids, F.array().cast("array<string>")))
        ids = F.filter(f"g{k}", lambda c: c.isNotNull())
        ids = F.filter(ids, _other_than(g.without)) if g.without else ids
        rows = rows.withColumn(f"g{k}", F.array_distinct(ids) if g.distinct else ids)
    return rows


def _other_than(column: str):
    return lambda c: ~c.eqNullSafe(F.col(column))


def seen_groups(rows: DataFrame, groups: tuple[Group, ...], cards: DataFrame, decks: DataFrame | None, key: str = "card_uuid") -> DataFrame:
    """Rows with ``g0``, ``g1``, ...: of each group the cards that ``cards`` has, copies and order kept.

    All groups of a row meet the cards in one join and come back in one aggregation. Equal rows are
    one until the end. A row goes if a group that may not be empty is.
    """
    rows = _with_ids(rows, groups, decks)
    names = [f"g{k}" for k in range(len(groups))]
    keyed = rows.withColumn("__row", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    keyed = keyed.groupBy("__row").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rows.columns])
    tagged = lambda k: lambda c, i: F.struct(F.lit(k).alias("g"), i.alias("at"), c.alias("id"))
    each = F.concat(*[F.transform(n, tagged(k)) for k, n in enumerate(names)])
    seen = keyed.select("__row", F.inline(each)).join(cards.select(F.col(key).alias("id")).distinct(), "id")
    back = seen.groupBy("__row").agg(*[F.array_sort(F.collect_list(F.when(F.col("g") == k, F.struct("at", "id")))).alias(n) for k, n in enumerate(names)])
    out = keyed.drop(*names).join(back, "__row", "left")
    for n, g in zip(names, groups):
        out = out.withColumn(n, F.coalesce(F.transform(n, lambda e: e["id"]), F.array().cast("array<string>")))
        out = out if g.may_be_empty else out.where(F.size(n) > 0)
    return out.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__row", "__n", "__again")


def _number(label: Column, cap: float | None) -> Column:
    """The label as a number up to the cap; null where it is none."""
    x = label.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x if cap is None else F.least(x, F.lit(cap)))


def _card(rows: DataFrame, v: View, cards: DataFrame) -> DataFrame:
    """The row with its card's columns, and the field that the label is read from masked, if the view says so."""
    out = rows.join(cards, v.key)
    if v.masks and "raw_content" in cards.columns:
        from ..functions.scalars import json_masked

        out = out.withColumn("raw_content", json_masked(F.col("raw_content"), v.masks))
    return out


def card_number(rows, v, cards, decks):
    """A card and a number; rows without one go."""
    return _card(rows.withColumn("label", _number(F.col(v.label), v.cap)).where("label is not null"), v, cards)


def card_class(rows, v, cards, decks):
    """A card and one of the classes; other labels go."""
    out = rows.withColumn("label", F.col(v.label).cast("string")).where("label is not null")
    return _card(out.where(F.col("label").isin(list(v.classes))) if v.classes else out, v, cards)


def card_labels(rows, v, cards, decks):
    """A card and a map of every class to 0 or 1."""
    names = F.array(*[F.lit(c) for c in v.classes])
    return _card(rows.withColumn("label", F.map_from_arrays(names, F.transform(F.col(v.label), lambda b: b.cast("int")))), v, cards)


def card_curve(rows, v, cards, decks):
    """A card and a map of place to rate, of the places with enough samples; rows without one go."""
    places = F.transform(F.arrays_zip(F.col(v.label).alias("r"), F.col(v.counts).alias("n")), lambda e, i: F.struct(i.alias("at"), e["r"].cast("double").alias("r"), e["n"].alias("n")))
    kept = F.filter(places, lambda e: e["r"].isNotNull() & (e["n"] >= max(v.least, 1)))
    out = rows.withColumn("label", F.map_from_entries(F.transform(kept, lambda e: F.struct(e["at"], e["r"])))).where(F.size("label") > 0)
    return _card(out, v, cards)


def card_shares(rows, v, cards, decks):
    """A card and a map of every class to its share."""
    return _card(rows.withColumn("label", F.create_map(*[x for c in v.classes for x in (F.lit(c), F.col(f"`{c}`").cast("double"))])), v, cards)


def group_number(rows, v, cards, decks):
    """Groups of cards and a number."""
    rows = rows.withColumn("label", _number(F.col(v.label), v.cap)).where("label is not null")
    return seen_groups(rows, v.groups, cards, decks)


def group_bit(rows, v, cards, decks):
    """Groups of cards and 0 or 1."""
    rows = rows.withColumn("label", F.col(v.label).cast("boolean").cast("int")).where("label is not null")
    return seen_groups(rows, v.groups, cards, decks)


def group_class(rows, v, cards, decks):
    """Groups of cards and one of the classes; other labels go."""
    rows = rows.withColumn("label", F.col(v.label).cast("string")).where("label is not null")
    return seen_groups(rows.where(F.col("label").isin(list(v.classes))) if v.classes else rows, v.groups, cards, decks)


def options(rows, v, cards, decks):
    """Options (``g0``, each once; two at least), perhaps a context (``g1``), and the place of what was picked.

    ``label`` of the table is one card or an array of them: one row for each pick among the options.
    With ``can_skip`` a row without a pick has the place after the last option.
    """
    out = seen_groups(rows, v.groups, cards, decks).withColumn("g0", F.array_distinct("g0")).where(F.size("g0") >= 2)
    many = dict(rows.dtypes)[v.label].startswith("array")
    out = out.withColumn("__pick", F.explode_outer(v.label)) if many else out.withColumn("__pick", F.col(v.label))
    place = F.when(F.col("__pick").isNotNull(), F.array_position("g0", F.col("__pick")) - 1)
    place = F.coalesce(place, F.size("g0").cast("long")) if v.can_skip else place
    return out.withColumn("pick_index", place).where("pick_index >= 0").drop("__pick")


CELLS = {
    "card_number": card_number, "card_class": card_class, "card_labels": card_labels, "card_curve": card_curve, "card_shares": card_shares,
    "group_number": group_number, "group_bit": group_bit, "group_class": group_class, "options": options,
}


def build_view(view: View, rows: DataFrame, cards: DataFrame, decks: DataFrame | None = None) -> DataFrame:
    """The view over a label table; ``cards`` are those that the tier sees, ``decks`` (deck_uuid, cards).

    Null labels and ids go; equal rows stay; empty tables give no rows.
    """
    return CELLS[view.cell](rows, view, cards, decks)


def swapped(view: View, built: DataFrame, seed: str, share: float = 0.5) -> DataFrame:
    """A seeded share of the rows with both groups changed over and the bit turned; only where the view is a pair."""
    if not view.swap:
        return built
    from ..functions import hashing

    hit = hashing.unit(seed, F.to_json(F.struct("g0", "g1", "label"))) < share
    a, b = F.when(hit, F.col("g1")).otherwise(F.col("g0")), F.when(hit, F.col("g0")).otherwise(F.col("g1"))
    return built.withColumns({"g0": a, "g1": b, "label": F.when(hit, 1 - F.col("label")).otherwise(F.col("label"))})


def balanced(view: View, built: DataFrame, seed: str) -> DataFrame:
    """As many rows of each group of ``balance_by`` as the smallest one has, drawn by hash."""
    if not view.balance_by:
        return built
    from .sampling import capped

    least = built.groupBy(view.balance_by).count().agg(F.min("count").alias("n")).first().n or 0
    return capped(built, seed, view.key, [view.balance_by], least)
