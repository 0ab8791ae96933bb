"""Losses and baselines as aggregates over (prediction, label) columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELTA = 1.345


def bce(z: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, without overflow."""
    return F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * y)


def mse(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def huber(p: Column, y: Column, delta: float = DELTA) -> Column:
    """e*e within delta, 2*delta*|e| - delta*delta beyond."""
    e = F.abs(p - y)
    return F.avg(F.when(e <= delta, e * e).otherwise(2 * delta * e - delta * delta))


def log_sum_exp(logits: Column) -> Column:
    m = F.array_max(logits)
    return m + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def cross_entropy(logits: Column, index: Column) -> Column:
    """Softmax cross-entropy over ragged options, the right one by its place from 0."""
    return F.avg(log_sum_exp(logits) - F.get(logits, index))


def soft_cross_entropy(logits: Column, target: Column) -> Column:
    """Cross-entropy with a distribution as target."""
    return F.avg(F.aggregate(F.zip_with(logits, target, lambda z, t: t * (log_sum_exp(logits) - z)), F.lit(0.0), lambda a, x: a + x))


def masked_vector(logits: Column, target: Column) -> Column:
    """Mean over rows of the mean squared error of sigmoid(logit) where the target is known."""
    pairs = F.filter(F.arrays_zip(logits.alias("z"), target.alias("y")), lambda e: e["y"].isNotNull())
    err = lambda e: F.pow(1 / (1 + F.exp(-e["z"])) - e["y"], 2)
    return F.avg(F.aggregate(pairs, F.lit(0.0), lambda a, e: a + err(e)) / F.size(pairs))


def standardised(y: Column, stats: DataFrame, rows: DataFrame, name: str = "y") -> DataFrame:
    """Rows with the label in units of the training rows' mean and population deviation."""
    return rows.join(F.broadcast(stats)).withColumn(name, (y - F.col("mean")) / F.col("std")).drop("mean", "std")


def label_stats(train: DataFrame, y: Column) -> DataFrame:
    """(mean, std) of the training labels; no spread raises."""
    s = train.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))
    return s.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(F.raise_error(F.lit("labels have no spread")).cast("double")))


def entropy_baseline(train: DataFrame, label: str) -> DataFrame:
    """(baseline): entropy of the class shares."""
    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return n.join(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("baseline"))


def binary_baseline(train: DataFrame, y: Column) -> DataFrame:
    p = train.agg(F.avg(y.cast("double")).alias("p"))
    h = F.when((F.col("p") <= 0) | (F.col("p") >= 1), 0.0).otherwise(-F.col("p") * F.log("p") - (1 - F.col("p")) * F.log(1 - F.col("p")))
    return p.select(h.alias("baseline"))


def soft_baseline(train: DataFrame, target: str) -> DataFrame:
    """Entropy of the mean target distribution."""
    mean = train.select(F.posexplode(target).alias("i", "t")).groupBy("i").agg(F.avg("t").alias("t"))
    return mean.agg((-F.sum(F.when(F.col("t") > 0, F.col("t") * F.log("t")).otherwise(0.0))).alias("baseline"))


def uniform_baseline(train: DataFrame, options: str) -> DataFrame:
    return train.agg(F.avg(F.log(F.size(options).cast("double"))).alias("baseline"))


def masked_vector_baseline(train: DataFrame, target: str) -> DataFrame:
    """Loss of the mean vector: per row the mean squared distance to it, over known entries."""
    long = train.select(F.monotonically_increasing_id().alias("row"), F.posexplode(target).alias("i", "t")).where("t is not null")
    mean = long.groupBy("i").agg(F.avg("t").alias("m"))
    per = long.join(F.broadcast(mean), "i").groupBy("row").agg(F.avg(F.pow(F.col("t") - F.col("m"), 2)).alias("l"))
    return per.agg(F.avg("l").alias("baseline"))


def huber_baseline(train: DataFrame, y: Column, delta: float = DELTA, rounds: int = 50, tolerance: float = 1e-9) -> float:
    """Huber loss of the best constant on standardised labels: the clipped mean, from the median on."""
    z = standardised(y.alias("y"), label_stats(train, y), train, "__z").select("__z")
    c = z.agg(F.median("__z")).first()[0]
    for _ in range(rounds):
        step = z.agg(F.avg(F.least(F.greatest(F.col("__z") - c, F.lit(-delta)), F.lit(delta)))).first()[0]
        c += step
        if abs(step) < tolerance:
            break
    return z.agg(huber(F.lit(c), F.col("__z"), delta)).first()[0]


def info_nce(pairs: DataFrame, anchor: str, logit: str, positive: Column) -> DataFrame:
    """(loss, anchors) of a table of comparisons (anchor, logit, is it a positive).

    For each positive: log(exp(l+) + sum of exp over negatives) - l+; mean per anchor, then over
    anchors. What must not be compared (the item itself, the same identity) is not in the table.
    """
    s = pairs.select(F.col(anchor).alias("a"), F.col(logit).alias("l"), positive.alias("p"))
    neg = s.where(~F.col("p")).groupBy("a").agg(F.max("l").alias("m"), F.collect_list("l").alias("ls"))
    neg = neg.select("a", (F.col("m") + F.log(F.aggregate("ls", F.lit(0.0), lambda x, l: x + F.exp(l - F.col("m"))))).alias("lse"))
    loss = F.coalesce(F.greatest("l", "lse") + F.log1p(F.exp(-F.abs(F.col("l") - F.col("lse")))) - F.col("l"), F.lit(0.0))
    per = s.where("p").join(neg, "a", "left").groupBy("a").agg(F.avg(loss).alias("x"))
    return per.agg(F.avg("x").alias("loss"), F.count(F.lit(1)).alias("anchors"))


def constant_logit_loss(pairs: DataFrame, anchor: str, positive: Column) -> DataFrame:
    """Its value when all logits are equal: mean ln(1 + negatives) over anchors with a positive."""
    s = pairs.groupBy(anchor).agg(F.sum((~positive).cast("int")).alias("n"), F.sum(positive.cast("int")).alias("p")).where("p > 0")
    return s.agg(F.avg(F.log1p(F.col("n").cast("double"))).alias("loss"))


def learning_rate(step: Column, total: int, warmup: float = 0.1, kind: str = "cosine") -> Column:
    """A multiplier: linear warm-up, then constant, linear or cosine decay."""
    at, w = step / F.lit(float(total)), max(warmup, 1e-9)
    left = (1 - at) / (1 - w)
    after = {"constant": F.lit(1.0), "linear": left, "cosine": 0.5 * (1 + F.cos(math.pi * (1 - left)))}[kind]
    return F.when(at < w, at / w).otherwise(after)
