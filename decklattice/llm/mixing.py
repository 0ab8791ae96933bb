"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words_of

PREFIX = "__mix_"


def _columns(docs: DataFrame, id_col: str, source_col: str, text_col: str, tie_hex: int) -> DataFrame:
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.withColumns(
        {
            PREFIX + "src": F.coalesce(F.col(source_col), F.lit("")),
            PREFIX + "null": F.col(source_col).isNull(),
            PREFIX + "size": F.size(words_of(F.col(text_col))).cast("long"),
            PREFIX + "h": h,
            PREFIX + "bin": F.substring(h, 1, tie_hex),
            PREFIX + "tie": F.md5(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...], ratio: float, cap: float) -> DataFrame:
    """(src, null, source_size, target) from (src, null, size, n): shares by weight below caps.

    The shares are the level at which the capped shares add up to ``ratio`` of all sizes: what a
    capped source leaves goes to the others by weight until none is above its cap.
    """
    by_name = Window.orderBy("null", "src")
    rising = Window.orderBy("fill", "null", "src")
    s = sizes.groupBy("src", "null").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    s = s.withColumn("rn", F.row_number().over(by_name))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("fill", F.col("top") / F.col("w"))
    s = s.withColumns(
        {
            "before": F.sum("top").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("top"),
            "w_left": F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)),
            "want": F.sum("source_size").over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(ratio)),
        }
    )
    s = s.withColumn("level", (F.col("want") - F.col("before")) / F.col("w_left"))
    all_rows = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("final", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(all_rows))
    target = F.least(F.col("top"), F.coalesce(F.col("final") * F.col("w"), F.col("top")))
    return s.select("src", "null", "source_size", target.alias("target"))


def with_copies(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tie_hex: int = 3) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    A document of source s is expected target(s)/source_size(s) times. The documents of a source
    are laid in a row by size, then by the MD5 of the id; the running sum of the expected copies,
    moved by one offset that the seed and the source give, crosses an integer so many times as the
    document is taken. As equal sizes lie together, the words taken come near the target.

    The place in the row is not counted in one task per source: documents are counted by (source,
    size, first ``tie_hex`` hex digits of the hash), these counts are summed up in two levels, and
    only documents of one such bin are numbered together. ``tie_hex`` changes no result.

    A null text has size 0; a null source is a source of its own, last in order; repeated ids and
    rows count each by itself; equal places are settled by the MD5 of the text; an empty table
    gives no rows. Sources without a word get a target of 0 and no copies. New columns replace
    those of the same name; all others are kept.
    """
    names = {"size": "size", "src": "src", "null": "null", "bin": "bin"}
    rows = _columns(docs, id_col, source_col, text_col, tie_hex)
    bins = rows.groupBy(*[F.col(PREFIX + k).alias(v) for k, v in names.items()]).agg(F.count(F.lit(1)).alias("n"))
    bins = cut(bins)
    targets = source_targets(bins, weights, ratio, cap)

    by_size = bins.groupBy("src", "null", "size").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("src", "null").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    by_size = by_size.select("src", "null", "size", (F.sum("n").over(in_source) - F.col("n")).alias("size_at"))
    in_size = Window.partitionBy("src", "null", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    starts = bins.withColumn("bin_at", F.sum("n").over(in_size) - F.col("n"))
    starts = starts.join(by_size, ["src", "null", "size"]).join(targets, ["src", "null"])
    keys = [PREFIX + k for k in names]
    starts = starts.select(*[F.col(k).alias(PREFIX + k) for k in names], (F.col("bin_at") + F.col("size_at")).alias(PREFIX + "at"), F.col("source_size").alias(PREFIX + "source_size"), F.col("target").alias(PREFIX + "target"))

    in_bin = Window.partitionBy(*keys).orderBy(PREFIX + "h", id_col, PREFIX + "tie")
    rows = rows.withColumn(PREFIX + "rn", F.row_number().over(in_bin)).join(starts, keys)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.when(F.col(PREFIX + "null"), "n").otherwise("s"), F.col(PREFIX + "src"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    each = F.when(F.col(PREFIX + "source_size") > 0, F.col(PREFIX + "target") / F.col(PREFIX + "source_size")).otherwise(0.0)
    place = (F.col(PREFIX + "at") + F.col(PREFIX + "rn")).cast("double")

    def crossed(at: Column) -> Column:
        return F.floor(each * at + unit)

    rows = rows.withColumn(PREFIX + "copies", crossed(place) - crossed(place - 1))
    out = {
        "size": F.col(PREFIX + "size"),
        "source_size": F.col(PREFIX + "source_size"),
        "target": F.col(PREFIX + "target"),
        "copies": F.col(PREFIX + "copies"),
        "taken": F.col(PREFIX + "copies") * F.col(PREFIX + "size"),
    }
    kept = [c for c in docs.columns if c not in out]
    return rows.select(*kept, *[v.alias(k) for k, v in out.items()])


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of ``docs``."""
    own = docs.columns
    kept = docs.select(F.struct(*own).alias("__doc"), *{how.get("id_col", "doc_id"), how.get("source_col", "source"), how.get("text_col", "text")})
    taken = with_copies(kept, **how).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__doc.*")
