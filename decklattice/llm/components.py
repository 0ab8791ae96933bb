"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Return (node, root) for every node that an edge names; the root is a node of the component.

    Distributed union-find by contraction. In a round every node hangs itself below its smallest
    neighbour, pointer jumping takes all to the roots of these trees, and the edges are rewritten to
    the roots. Every tree has two nodes or more, so each round halves the nodes at least. Each step
    is written to the shared folder: a lost executor costs one step at most. Steps that nothing
    reads any more are deleted. Null ends and loops are ignored; no edges give no rows.
    """
    e = edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))
    e = materialise(e.where("u < v").distinct(), "edges")
    hung: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select(F.col("v"), F.col("u")))
        p = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"), F.lit(True).alias("moved"))
        p = materialise(p, "parents")
        while True:
            up = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = materialise(p.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
            discard(p)
            p = jumped
            if p.where("moved").isEmpty():
                break
        hung.append(p)
        of_u, of_v = p.select("u", F.col("p").alias("pu")), p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left_over = e.join(of_u, "u").join(of_v, "v").where("pu <> pv")
        contracted = materialise(left_over.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        discard(e)
        e = contracted
    if not hung:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = hung[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for p in hung[1:]:
        step = p.select(F.col("u").alias("root"), F.col("p").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
