"""Links within the buckets of a similarity join, without all pairs of a bucket.

Nodes are sets; those in a bucket are candidates. In each bucket all nodes are compared with one
leader, and what follows from that decides most other pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import connected_components

#: Nodes of a group that are compared in one task; larger groups are split into blocks.
BLOCK = 2048
#: A pair is compared exactly unless so many signature values differ as has this chance at most.
SCREEN_LOSS = 1e-5
#: Differences from a leader are kept of nodes of this similarity to it; others are far from it.
NEAR = 0.4
_EVEN_BITS = 0x5555555555555555


def two_bits(values: list[Column], place: int) -> Column:
    """Two bits from a place on of up to 32 signature values, packed."""
    out = F.lit(0).cast("long")
    for i, v in enumerate(values):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(v, place).bitwiseAND(F.lit(3).cast("long")), 2 * i))
    return out


def _pairs_of_bits(x: Column) -> Column:
    """Of each two bits, whether one is set."""
    return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EVEN_BITS))


def differing(low: tuple[Column, Column], high: tuple[Column, Column]) -> Column:
    """How many signature values surely differ, by sketches of four bits a value."""
    return F.bit_count(_pairs_of_bits(low[0].bitwiseXOR(low[1])).bitwiseOR(_pairs_of_bits(high[0].bitwiseXOR(high[1]))))


def most_differing(n: int, bits: int, similarity: float) -> int:
    """The least t for which n values of similar sets differ in more than t with SCREEN_LOSS at most."""
    p = (1 - similarity) * (1 - 0.5**bits)
    tail, t = 0.0, n
    while t > 0:
        tail += math.comb(n, t) * p**t * (1 - p) ** (n - t)
        if tail > SCREEN_LOSS:
            break
        t -= 1
    return t


def enough(common: Column, a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of sizes a and b with so many common elements have the Jaccard similarity."""
    return common * (1 + similarity) >= (a + b) * similarity - 1e-9


def linked(similarity: float) -> Column:
    """Of a comparison (na, n_gone, n_come): sizes of a, of a without b, and of b without a."""
    common = F.col("na") - F.col("n_gone")
    return enough(common, F.col("na"), common + F.col("n_come"), similarity)


_linked = linked


def _in_blocks(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The rows twice, with ``block``: dealt out by hash, and repeated for each block of their key.

    A join on key and block so meets every pair once, and no task has more than about BLOCK times
    a large group. Without a group above BLOCK there is one block, and both are the same rows.
    """
    large = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    large = materialise(large, "large-groups")
    if large.isEmpty():
        discard(large)
        return (rows.withColumn("block", F.lit(0).cast("long")),) * 2
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    rows = rows.join(large, key, "left")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(value), blocks)).drop("blocks")
    again = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks")
    return dealt, again


def _named(rows: DataFrame, classes: DataFrame, node: str) -> DataFrame:
    """Adds ``c``: the class of the node so far, itself where it has none."""
    return rows.join(classes.select(F.col("node").alias(node), "root"), node, "left").withColumn("c", F.coalesce("root", node)).drop("root")


def _links_by_leader(star: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b), written, of nodes of different classes that were compared with the same leader.

    Their common elements follow from how each differs from the leader, so the test is part of the
    join and only links leave it.
    """
    rows = materialise(_named(star.where(F.col("gone").isNotNull()), classes, "b"), "star")
    left, right = _in_blocks(rows, "a", "b")
    left = left.select("a", "block", "na", *[F.col(x).alias(x + "1") for x in ("b", "c", "gone", "come")])
    right = right.select("a", "block", *[F.col(x).alias(x + "2") for x in ("b", "c", "gone", "come")])
    gone1, gone2, come1, come2 = (F.size(x) for x in ("gone1", "gone2", "come1", "come2"))
    n1, n2 = F.col("na") - gone1 + come1, F.col("na") - gone2 + come2
    most = F.col("na") - F.greatest(gone1, gone2) + F.least(come1, come2)
    common = F.col("na") - gone1 - gone2 + F.size(F.array_intersect("gone1", "gone2")) + F.size(F.array_intersect("come1", "come2"))
    on = (F.col("c1") < F.col("c2")) & enough(most, n1, n2, similarity) & enough(common, n1, n2, similarity)
    out = materialise(left.join(right, ["a", "block"]).where(on).select(F.col("b1").alias("a"), F.col("b2").alias("b")).distinct(), "links")
    discard(rows)
    return out


def linked_classes(members: DataFrame, compared: Callable[[DataFrame], DataFrame], similarity: float, values: int, known: DataFrame | None = None) -> DataFrame:
    """(node, root), written, of every node that is similar to another one of a bucket.

    ``members``: (bucket, node, n, low, high, weight) of the nodes of buckets of several, n the size of
    the node's set (null: unknown), low and high its sketch of ``values`` signature values, weight how
    often it occurs. ``compared`` takes pairs (a, b) and returns them with na, n_gone, n_come, gone and
    come: the size of a, the numbers and the hashes of elements that only a and only b has. ``known``
    are links (a, b) that another search has found: they count, and their nodes are one class.

    The most frequent node leads a bucket: n comparisons for n nodes. Two nodes that were compared
    with the same leader are then tested by how each differs from it. A node that is far from the
    leader is compared with the others of its bucket that are not linked to the leader; by the
    triangle inequality no other one can be similar to it. So no link within a bucket is lost, but
    for pairs whose signatures differ in so many values as similar sets hardly ever do (SCREEN_LOSS):
    those are not compared. Large groups are split by hash into blocks.
    """
    screen = most_differing(values, 4, similarity)

    def near(a: str, b: str) -> Column:
        few = differing((F.col("low" + a), F.col("low" + b)), (F.col("high" + a), F.col("high" + b))) <= screen
        sizes = F.least("n" + a, "n" + b) >= F.greatest("n" + a, "n" + b) * similarity - 1e-9
        return few & F.coalesce(sizes, F.lit(True))

    order = F.shiftleft(F.least(F.col("weight").cast("long"), F.lit(1 << 19)), 43) + F.shiftrightunsigned("node", 21)
    first = lambda x: F.max_by(x, order).alias(x + "0")
    led = members.join(members.groupBy("bucket").agg(first("node"), first("n"), first("low"), first("high")), "bucket")
    led = led.where("node <> node0").select("bucket", "node", "n", "low", "high", F.col("node0").alias("leader"), near("", "0").alias("near"))
    led = materialise(led, "members")
    star = compared(led.where("near").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    edges = star.where(linked(similarity)).select("a", "b")
    edges = edges.union(known) if known else edges
    classes = materialise(connected_components(edges), "classes")
    by_leader = _links_by_leader(star, classes, similarity)
    led_pairs = star.select(F.col("a").alias("leader"), F.col("b").alias("node"), linked(similarity).alias("linked"), F.col("gone").isNotNull().alias("kept"))
    loose = led.join(led_pairs, ["leader", "node"], "left").where("not coalesce(linked, false)").withColumn("near", F.coalesce("kept", F.lit(False)))
    mixed = loose.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bool_and("near").alias("all_near")).where("size > 1 and not all_near").select("bucket")
    loose = materialise(_named(loose.join(mixed, "bucket"), classes, "node").select("bucket", "node", "n", "low", "high", "near", "c"), "loose")
    left, right = (x.select("bucket", "block", *[F.col(c).alias(c + k) for c in ("node", "n", "low", "high", "near", "c")]) for k, x in zip("12", _in_blocks(loose, "bucket", "node")))
    met = left.join(right, ["bucket", "block"]).where((F.col("node1") < F.col("node2")) & (F.col("c1") != F.col("c2")) & ~(F.col("near1") & F.col("near2")) & near("1", "2"))
    far = compared(met.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct())
    out = materialise(connected_components(edges.union(by_leader).union(far.where(linked(similarity)).select("a", "b"))), "classes")
    discard(led, star, classes, by_leader, loose, far)
    return out


def difference(a: Column, b: Column, hashed: Callable[[Column], Column]) -> Column:
    """An array of one struct (na, n_gone, n_come, gone, come) of two arrays; see ``linked_classes``."""

    def sized(x: Column) -> Column:
        return F.struct(x["na"].alias("na"), F.size(x["gone"]).alias("n_gone"), F.size(x["come"]).alias("n_come"), x["gone"].alias("gone"), x["come"].alias("come"))

    def kept(x: Column) -> Column:
        common, own = x["na"] - x["n_gone"], lambda c: F.when(near, hashed(x[c]))
        near = common >= (common + x["n_gone"] + x["n_come"]) * NEAR
        return F.struct(x["na"].alias("na"), x["n_gone"].alias("n_gone"), x["n_come"].alias("n_come"), own("gone").alias("gone"), own("come").alias("come"))

    sets = F.array(F.struct(a.alias("a"), b.alias("b")))
    step = lambda x: F.struct(F.size(x["a"]).alias("na"), F.array_except(x["a"], x["b"]).alias("gone"), F.array_except(x["b"], x["a"]).alias("come"))
    return F.transform(F.transform(F.transform(sets, step), sized), kept)
