"""Conditional rates, averages, deltas, vectors and distributions over decks, drafts and games."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RateSpec:
    """A ratio label: sums of numerator and denominator by keys, kept where the denominator is positive."""

    keys: list[str]
    numerator: Column
    denominator: Column = field(default_factory=lambda: F.lit(1))
    where: Column | None = None
    label: str = "label"


def counts(rows: DataFrame, spec: RateSpec) -> DataFrame:
    """The mergeable count table (keys, num, den) of a rate."""
    rows = rows if spec.where is None else rows.where(spec.where)
    return rows.groupBy(*spec.keys).agg(F.sum(spec.numerator.cast("double")).alias("num"), F.sum(spec.denominator.cast("double")).alias("den"))


def finished(tables: list[DataFrame], keys: list[str], label: str = "label") -> DataFrame:
    """Count tables merged by name, summed by key, and divided; keys without denominator go."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    s = merged.groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("den").alias("den")).where("den > 0")
    return s.select(*keys, (F.col("num") / F.col("den")).alias(label), F.rint("den").cast("long").alias("sample_count"))


def rate(rows: DataFrame, spec: RateSpec) -> DataFrame:
    """A rate straight from rows: one shuffle, combined before it."""
    return finished_one(counts(rows, spec), spec.keys, spec.label)


def finished_one(table: DataFrame, keys: list[str], label: str) -> DataFrame:
    table = table.where("den > 0")
    return table.select(*keys, (F.col("num") / F.col("den")).alias(label), F.rint("den").cast("long").alias("sample_count"))


def presence(copies: DataFrame, game: list[str], card: str) -> DataFrame:
    """One row for each card that a game holds, however many copies."""
    return copies.select(*game, card).distinct()


def mean_per_copy(copies: DataFrame, card: str, value: Column, label: str = "label") -> DataFrame:
    """Mean of a value over all copies of a card (one sample per copy)."""
    return copies.groupBy(card).agg(F.avg(value.cast("double")).alias(label), F.count(value).alias("sample_count")).where("sample_count > 0")


def delta_to_mean(rows: DataFrame, card: str, value: Column, overall: DataFrame, overall_value: Column, label: str = "delta") -> DataFrame:
    """Mean of a value where a card is there, minus the mean over all games.

    The mean over all games is a single number that joins the result as a scalar subquery.
    """
    base = overall.agg(F.avg(overall_value.cast("double")).alias("base"))
    mean = rows.groupBy(card).agg(F.avg(value.cast("double")).alias("mean"), F.count(value).alias("sample_count"))
    return mean.join(F.broadcast(base)).select(card, (F.col("mean") - F.col("base")).alias(label), "sample_count")


def side_delta(rows: DataFrame, keys: list[str], side: Column, hit: Column, label: str = "delta") -> DataFrame:
    """Rate on one side minus rate on the other; null unless both sides were seen."""
    one, two = side.cast("int"), (~side).cast("int")
    h = hit.cast("int")
    s = rows.groupBy(*keys).agg(F.sum(one).alias("n1"), F.sum(two).alias("n2"), F.sum(one * h).alias("h1"), F.sum(two * h).alias("h2")).where("n1 + n2 > 0")
    return s.select(*keys, F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("h1") / F.col("n1") - F.col("h2") / F.col("n2")).alias(label), (F.col("n1") + F.col("n2")).alias("sample_count"))


def curve(rows: DataFrame, keys: list[str], position: Column, length: int, numerator: Column, denominator: Column, label: str = "rates") -> DataFrame:
    """Rates by position as one array of fixed length; null where a position was never seen."""
    at = F.least(position, F.lit(length - 1))
    s = rows.groupBy(*keys, at.alias("pos")).agg(F.sum(numerator.cast("double")).alias("num"), F.sum(denominator.cast("double")).alias("den")).where("den > 0")
    per = s.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("num", "den")))).alias("m"))
    seq = F.sequence(F.lit(0), F.lit(length - 1))
    get = lambda i: F.try_element_at("m", i)
    return per.select(*keys, F.transform(seq, lambda i: get(i)["num"] / get(i)["den"]).alias(label), F.transform(seq, lambda i: F.coalesce(F.rint(get(i)["den"]).cast("long"), F.lit(0).cast("long"))).alias("sample_counts"))


def conditional_inclusion(included: DataFrame, legal: DataFrame, group: str, card: str, least: int = 1) -> DataFrame:
    """Share of the decks of all groups in which a card is legal that hold it.

    ``included`` has (group, card, n) and ``legal`` (group, card, decks); cards never included are
    left out, as are those legal in fewer than ``least`` decks.
    """
    both = legal.join(included, [group, card], "left")
    s = both.groupBy(card).agg(F.sum("decks").alias("legal_deck_count"), F.sum(F.coalesce("n", F.lit(0))).alias("included_deck_count"))
    s = s.where((F.col("included_deck_count") > 0) & (F.col("legal_deck_count") >= least))
    return s.select(card, (F.col("included_deck_count") / F.col("legal_deck_count")).alias("inclusion_rate"), "legal_deck_count", "included_deck_count")


def inclusion_by_group(included: DataFrame, legal: DataFrame, group: str, card: str, groups: list[str]) -> DataFrame:
    """The same as arrays over the groups; null where the card is illegal."""
    both = legal.join(included, [group, card], "left")
    per = both.groupBy(card).agg(F.map_from_entries(F.collect_list(F.struct(group, F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("decks"))))).alias("m"), F.sum(F.coalesce("n", F.lit(0))).alias("total"))
    names = F.array(*[F.lit(g) for g in groups])
    get = lambda g: F.try_element_at("m", g)
    return per.where("total > 0").select(card, F.transform(names, lambda g: get(g)["n"] / get(g)["decks"]).alias("inclusion_rate_by_group"), F.transform(names, lambda g: F.coalesce(get(g)["decks"], F.lit(0).cast("long"))).alias("legal_deck_count_by_group"))


def share_by_class(copies: DataFrame, card: str, kind: str, domain: list[str]) -> DataFrame:
    """For each card the share of its copies by class, a column for each class of the domain."""
    p = copies.groupBy(card).agg(F.count(F.lit(1)).alias("sample_count"), *[F.sum((F.col(kind) == k).cast("int")).alias(k) for k in domain])
    return p.select(card, *[(F.col(k) / F.col("sample_count")).alias(k) for k in domain], "sample_count")


def distinct_then_sum(rows: DataFrame, partition: list[str], key: str, counted: str) -> DataFrame:
    """Distinct values per partition file, then summed over files: one in two files counts twice."""
    per = rows.groupBy(*partition, key).agg(F.count_distinct(counted).alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("count"))


def best_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
