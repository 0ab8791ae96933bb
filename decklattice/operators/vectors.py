"""Tables of vectors: appending, labels, samples, covariance and whitening."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .sampling import capped


def append_vectors(table: DataFrame | None, rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """The table with the rows that are new to it; a vector of another width, or not finite, raises when it is read."""
    fine = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checked = rows.withColumn(vector, F.when(fine, F.col(vector)).otherwise(F.raise_error(F.lit("vector of another width or not finite")).cast(rows.schema[vector].dataType)))
    body = [c for c in rows.columns if c != key]
    one = checked.groupBy(key).agg(F.min_by(F.struct(*body), F.to_json(F.struct(*body))).alias("__r")).select(key, "__r.*").select(rows.columns)
    return one if table is None else table.unionByName(one.join(table.select(key), key, "left_anti"))


def tier_label(key: Column, seed: str, tiers: dict[str, float]) -> Column:
    """The label of a card that is its holdout tier."""
    return hashing.split_of(seed, key, tiers)


def labelled_sample(vectors: DataFrame, labels: DataFrame, key: str, label: str, seed: str, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Vectors with a label that is not null, at most so many of each group by seeded rank (all without ``most``)."""
    known = labels.where(F.col(label).isNotNull()).select(key, label).distinct()
    rows = vectors.join(known, key)
    return rows if most is None else capped(rows, seed, key, by or [label], most)


def selected(cards: DataFrame, games: list[str] | None = None, tiers: Column | None = None) -> DataFrame:
    """Cards of some games and tiers."""
    cards = cards if games is None else cards.where(F.col("source_game").isin(games))
    return cards if tiers is None else cards.where(tiers)


def moments(vectors: DataFrame, vector: str) -> DataFrame:
    """(n, total, outer): mergeable sums of the vectors and of their outer products, one row per batch of a task.

    Rows of several tables can be united: ``covariance`` adds them up. Null vectors do not count.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        import pandas as pd

        for b in batches:
            if len(b):
                x = np.stack(b["v"].to_numpy())
                yield pd.DataFrame({"n": [len(x)], "total": [x.sum(0)], "outer": [(x.T @ x).ravel()]})

    return rows.mapInPandas(run, "n bigint, total array<double>, outer array<double>")


def covariance(sums: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, population covariance) of ``moments``: added up by place, so no task gathers all batches."""
    part = lambda c: sums.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # noqa: E731  width, and width squared, rows
    n = sums.agg(F.sum("n")).first()[0] or 0
    if not n:
        return 0, np.empty(0), np.empty((0, 0))
    mean = np.array([r.x for r in part("total")]) / n
    return n, mean, np.array([r.x for r in part("outer")]).reshape(len(mean), -1) / n - np.outer(mean, mean)


def whitening(mean: np.ndarray, cov: np.ndarray, kept: int | None = None, floor: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions of the covariance, scaled to unit variance, the largest first."""
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: kept or len(values)]
    return mean, directions[:, order] / np.sqrt(np.maximum(values[order], floor))


def whitened(vectors: DataFrame, vector: str, stats: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Vectors less the mean, times the projection."""
    mean, projection = stats

    @F.pandas_udf("array<double>")
    def apply(v):
        import pandas as pd

        return pd.Series(list((np.stack(v.to_numpy()) - mean) @ projection)) if len(v) else v

    return vectors.withColumn(vector, apply(F.col(vector).cast("array<double>")))


def calibration_sample(cards: DataFrame, seed: str, key: str, per_game: int, game: str = "source_game") -> DataFrame:
    """So many cards of each game, by seeded rank (a sampling operator)."""
    return capped(cards, seed, key, [game], per_game)


def odd_one_out_loss(items: DataFrame, vectors: str, temperature: float = 0.07) -> DataFrame:
    """(loss, baseline, items) of items of card vectors, the intruder last.

    Each card's fit is its cosine with the mean of the others; the loss is the cross-entropy of the
    last place under -fit / temperature, the baseline its value when all fits are equal.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = F.transform(vectors, lambda x: x.cast("array<double>"))
    total = F.aggregate(F.slice("v", 2, F.size("v")), F.get("v", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    rows = items.select(v.alias("v")).where(F.size("v") >= 3).withColumn("sum", total)
    fit = F.transform("v", lambda x: _cosine(x, F.zip_with(F.col("sum"), x, lambda s, y: s - y), dot))
    rows = rows.select(F.transform(fit, lambda f: -f / temperature).alias("z"))
    top = F.array_max("z")
    lse = top + F.log(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return rows.agg(F.avg(lse - F.element_at("z", -1)).alias("loss"), F.avg(F.log(F.size("z").cast("double"))).alias("baseline"), F.count(F.lit(1)).alias("items"))


def _cosine(a: Column, b: Column, dot) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def pooled(items: DataFrame, vectors: str, name: str = "vector") -> DataFrame:
    """Items with the mean of their card vectors."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, 2, n), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return items.where(n > 0).withColumn(name, F.transform(total, lambda x: x / n))


def card_contexts(bags: DataFrame, seed: str, size: int, contexts: int = 2, deck: str = "deck_uuid") -> DataFrame:
    """(card, context, deck, cards): cards with slices of decks around them, for cards with so many decks.

    The decks of a card and the other cards of a slice are drawn by hash.
    """
    spread = bags.where(F.size(F.array_distinct("cards")) > size).select(deck, F.array_distinct("cards").alias("own"), F.explode(F.array_distinct("cards")).alias("card"))
    ranked = capped(spread.withColumn("__k", F.concat_ws(":", "card", F.col(deck))), seed, "__k", ["card"], contexts)
    keyed = F.transform(F.filter("own", lambda c: c != F.col("card")), lambda c: F.struct(hashing.rank_key(seed, F.concat_ws(":", F.col("card"), F.col(deck), c)).alias("k"), c.alias("c")))
    out = ranked.withColumn("cards", F.transform(F.slice(F.array_sort(keyed), 1, size), lambda e: e["c"]))
    enough = out.groupBy("card").count().where(F.col("count") == contexts).select("card")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("card").orderBy(deck)) - 1
    return out.join(enough, "card").select("card", at.alias("context"), deck, "cards")
