"""Near-duplicates by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, worker_state
from .stars import BLOCK, difference, linked, linked_classes

#: Gives pairs (a, b) of nodes (node, fp, ...).
Candidates = Callable[[DataFrame], DataFrame]

#: Texts (at about this number) in which shingles are counted, and common ones that are kept. Both
#: only set the order in which prefixes are filled, so they change the work and never the result.
SAMPLE, COMMON = 8192, 500_000
#: MinHash values of a sketch, and parts into which the nodes of a component are dealt.
VALUES, PARTS = 32, 64
_MASKS = np.random.default_rng(30).integers(0, 2**64, VALUES, dtype=np.uint64)[:, None]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased.

    A text of fewer words than a shingle has one shingle, one without a word has none.
    """
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return np.empty(0, np.int64)
    xx = xxhash.xxh64_intdigest
    h = np.array([xx(x, 42) for x in w], np.uint64)
    k = min(len(w), words)
    n = len(w) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique((out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in one order for all sets: rare ones by hash, then common ones by rank.

    Two sets at ``similarity`` or more share at least ceil(similarity * n) shingles, n the size of
    either, so their first n - ceil(similarity * n) + 1 in any fixed order share one: none is lost.
    """
    n = len(hashes)
    if not n:
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    place = np.where(common[at] == hashes, rank[at], -1) if len(common) else np.full(n, -1)
    return hashes[np.argsort(place, kind="stable")][: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def _common(slim: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank by frequency) of shingles that several of some sampled texts have."""
    every = max(1, slim.count() // SAMPLE)
    texts = slim.where(F.pmod("key", F.lit(every).cast("long")) == 0).dropDuplicates(["key"]).select("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), words))], ["h"])

    counts = texts.mapInArrow(run, "h bigint").groupBy("h").count().where("count > 1")
    kept = materialise(counts.orderBy(F.desc("count"), "h").limit(COMMON), "common-shingles")  # an executor picks them, not the driver
    rows = kept.toArrow()  # at most COMMON rows, as numbers: Row objects take twenty times their memory
    discard(kept)
    h, count = (rows.column(c).to_numpy() for c in ("h", "count"))
    h = h[np.lexsort((h, -count))]
    order = np.argsort(h)
    return h[order], np.arange(len(h))[::-1][order]


def sketch(hashes: np.ndarray) -> tuple[int, int]:
    """Two and two bits of each of VALUES MinHash values of a set, packed as ``stars.two_bits`` does."""
    if not len(hashes):
        return 0, 0
    u, least = hashes.view(np.uint64), np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(u), 2048):
        v = (u[None, at : at + 2048] ^ _MASKS) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, v.min(1), out=least)
    place = np.arange(0, 2 * VALUES, 2, dtype=np.uint64)
    packed = [int(np.bitwise_or.reduce((least >> np.uint64(shift) & np.uint64(3)) << place)) for shift in (20, 22)]
    return packed[0] - (packed[0] >> 63 << 64), packed[1] - (packed[1] >> 63 << 64)


def set_print(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set: the majority bits of its hashes, signed; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _prints(slim: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, key, node: a hash of the shingle set, n: its size, fp: its fingerprint, low, high: its sketch, prefix) of every row."""
    held = slim.sparkSession.sparkContext.broadcast(_common(slim, words))

    def run(batches):
        import pyarrow as pa
        import xxhash

        worker_state(None, None)
        for b in batches:
            sets = [shingle_hashes(t.as_py(), words) for t in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            first = [prefix(s, *held.value, similarity) for s in sets]
            low, high = zip(*map(sketch, sets)) if sets else ((), ())
            columns = [b.column(0), b.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array(list(map(set_print, sets)), pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "node", "n", "fp", "low", "high", "prefix"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, key bigint, node bigint, n int, fp bigint, low bigint, high bigint, prefix array<bigint>")


def _compared(nodes: DataFrame, slim: DataFrame, words: int):
    """How the shingle sets of two nodes differ, for ``stars.linked_classes``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t.as_py(), words) for t in b.column(1)], pa.list_(pa.int64()))], ["node", "s"])

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "shingle-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        keys = nodes.join(wanted, "node", "left_semi").select("node", "key")
        texts = slim.select("key", "text").join(keys, "key").dropDuplicates(["node"]).select("node", "text")
        sets = materialise(texts.mapInArrow(run, "node bigint, s array<bigint>"), "shingle-sets")
        of = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias("s" + c))
        out = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.inline(difference(F.col("sa"), F.col("sb"), lambda x: x)))
        out = materialise(out, "shingle-differences")
        discard(pairs, sets)
        return out

    return compared


def shingle_classes(nodes: DataFrame, slim: DataFrame, words: int, similarity: float, candidates: Candidates | None = None) -> DataFrame:
    """(node, root) of all nodes whose shingle sets have the similarity to another one's, or more.

    Pairs that ``candidates`` gives are compared exactly first. For what these lack, nodes that share
    a shingle of their prefixes are candidates as well, which loses none; ``stars.linked_classes``
    finds the links among them.
    """
    compared = _compared(nodes, slim, words)
    known = compared(candidates(nodes)).where(linked(similarity)).select("a", "b") if candidates else None
    postings = nodes.select("node", F.explode("prefix").alias("bucket"))
    shared = postings.groupBy("bucket").count().where("count > 1").select("bucket")
    members = postings.join(shared, "bucket").join(nodes.select("node", "n", "low", "high", "weight"), "node")
    members = materialise(members.select("bucket", "node", "n", "low", "high", "weight"), "shingle-members")
    out = linked_classes(members, compared, similarity, VALUES, known)
    discard(members)
    return out


def shingle_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", candidates: Candidates | None = None) -> DataFrame:
    """(doc_id, component_id) of every row: texts link at a Jaccard similarity of ``similarity`` or more.

    The sets are those of their word shingles, A-Z lower-cased. Every pair at the similarity is
    linked, directly or by way of others, and no other one is, but for equal 64-bit hashes of
    different shingles and for pairs that ``stars.SCREEN_LOSS`` allows to be missed (1 in 100,000). component_id is
    the smallest doc_id that links reach; ``candidates`` gives pairs of nodes (node, fp, ...) that are compared first; texts without a word link with each other. A null id is
    smallest only where a whole component has none; repeated rows stay; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    prints = materialise(_prints(slim, words, similarity), "shingle-prints")
    first = lambda c: F.first(c).alias(c)
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"), first("n"), first("fp"), first("low"), first("high"), first("prefix"))
    nodes = materialise(nodes, "shingle-nodes")
    root = shingle_classes(nodes, slim, words, similarity, candidates)
    least = component_least(nodes, root)
    out = prints.select("doc_id", "node").join(least, "node", "left").select("doc_id", "component_id")
    return out


def component_least(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """(node, component_id): the smallest ``least`` of a node's component, its own where it has none.

    A component may hold a third of all nodes: the smallest is first taken within parts, and the nodes
    of components above BLOCK meet their row in parts as well, so that no task has all of them.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS).cast("long"))
    linked = nodes.select("node", "least").join(root, "node")
    parts = linked.groupBy("root", part.alias("part")).agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n"))
    least = materialise(parts.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")), "components")
    small, large = least.where(F.col("n") <= BLOCK).drop("n"), least.where(F.col("n") > BLOCK).drop("n")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
    dealt = linked.withColumn("part", part).join(large.withColumn("part", salts), ["root", "part"])
    alone = nodes.select("node", F.col("least").alias("component_id")).join(root, "node", "left_anti")
    return linked.join(small, "root").select("node", "component_id").union(dealt.select("node", "component_id")).union(alone)
