"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .shingles import shingle_components

BITS = 64
#: Fingerprints sampled for the estimates (by smallest hash: the same ones in every run).
SAMPLE = 4096
#: Flipped bits that a probe may have in one group: this bounds the masks that a plan holds.
MOST_FLIPS = 2
#: Fingerprints of one index bucket that one block holds; larger buckets are split into blocks.
BLOCK = 4096


def _fingerprint(text: str, words: int) -> int:
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(w) < words:
        return xx(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - words + 1
    ones = np.zeros(BITS, np.int64)
    begins, ends = begins[:n].tolist(), ends[words - 1 :].tolist()
    for at in range(0, n, 65_536):
        h = np.array([xx(joined[a:b], 42) for a, b in zip(begins[at : at + 65_536], ends[at : at + 65_536])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint): majority bits of the XXH64 hashes (seed 42) of all word shingles.

    A-Z are lower-cased; a text of fewer words than a shingle has one shingle; null and empty texts
    have fingerprint 0; repeated rows keep a row each.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.fromiter((_fingerprint(t.as_py() or "", words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp bigint")


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of about equal size, correlated bits together.

    Greedy: a group starts with the free bit of least entropy and takes, one by one, the free bit
    most correlated with those it has.
    """
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)[None, :]) & np.uint64(1)
    x = bits.astype(float)
    p = x.mean(0) if len(x) else np.full(BITS, 0.5)
    x = x - p
    sd = np.sqrt((x * x).mean(0)) if len(x) else np.ones(BITS)
    sd[sd == 0] = 1
    r = np.abs(x.T @ x / max(len(x), 1) / np.outer(sd, sd))
    free, out = list(range(BITS)), []
    for k in range(parts):
        want = len(free) // (parts - k)
        own = [min(free, key=lambda b: (abs(p[b] * (1 - p[b])), b))]
        free.remove(own[0])
        while len(own) < want:
            best = max(free, key=lambda b: (r[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def _masks(group: list[int], t: int) -> list[int]:
    """All flips of at most t bits of a group, as 64-bit masks."""
    return [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(group, k)]


def allocate(sample: np.ndarray, groups: list[list[int]], tau: int, n: int) -> tuple[float, list[int]]:
    """(estimated cost, threshold of each group); thresholds add up to tau - groups + 1.

    Two fingerprints within tau bits differ in at most t_i bits of some group i (generalised
    pigeonhole). A dynamic program over groups and threshold sum takes the cheapest thresholds:
    probes sent, plus candidates, estimated from the distances of sampled pairs in that group. A
    threshold of -1 leaves a group out.
    """
    half = len(sample) // 2
    a, b = sample[:half], sample[half : 2 * half]
    costs = []
    for g in groups:
        mask = np.uint64(sum(1 << k for k in g))
        seen = np.zeros(BITS + 1)
        for shift in range(min(half, 512)):
            d = np.bitwise_count((a ^ np.roll(b, shift)) & mask)
            seen += np.bincount(d, minlength=BITS + 1)
        pairs = max(seen.sum(), 1)
        w = len(g)
        # unseen distances count as if the bits were independent and fair
        fair = np.array([comb(w, k) / 2.0**w for k in range(tau + 1)])
        share = np.cumsum(np.maximum(seen[: tau + 1] / pairs, fair))
        costs.append([0.0] + [(3.0 * n + 1000) * sum(comb(w, j) for j in range(t + 1)) + n * n / 2 * share[t] * 0.02 for t in range(tau + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, ts) in best.items():
            for t in range(-1, min(tau, MOST_FLIPS) + 1):
                new = (cost + c[t + 1], [*ts, t])
                if total + t + 1 <= tau + 1 and (total + t + 1 not in step or new[0] < step[total + t + 1][0]):
                    step[total + t + 1] = new
        best = step
    return best[tau + 1]


def plan(sample: np.ndarray, n: int, tau: int) -> list[tuple[int, list[int]]]:
    """(group mask, flip masks to probe) of the cheapest grouping into up to tau + 1 groups."""
    options = []
    for parts in range(min(3, tau + 1), tau + 2):
        groups = bit_groups(sample, parts)
        cost, ts = allocate(sample, groups, tau, n)
        options.append((cost, parts, [(sum(1 << b for b in g), _masks(g, t)) for g, t in zip(groups, ts) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Forest:
    """Union-find over the fingerprints of one index block."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, hits: np.ndarray) -> np.ndarray:
        """Unite the hits; return one of each part that they had."""
        labels, first = np.unique(self.label[hits], return_index=True)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return hits[first]


def _links(tau: int):
    """Verify probes against the index fingerprints of their block; return a spanning set of links.

    Rows come sorted by (part, key, block, is_probe). Links are verified one and all, but only those
    that connect something new are returned, so a block of n copies gives about n rows, not n * n.
    """

    def run(batches):
        import pyarrow as pa

        at, index, forest = None, None, None
        grown: list[tuple[np.ndarray, ...]] = []
        a_out: list[np.ndarray] = []
        b_out: list[np.ndarray] = []

        def linked(p, i):
            """Which pairs of probe and index rows (as broadcast) are links."""
            return (np.bitwise_count(p[0] ^ i[0]) <= tau) & (p[0] != i[0])

        def probe(rows):
            nonlocal forest
            if forest is None:
                forest = _Forest(len(index[0]))
            for begin in range(0, len(rows[0]), 512):
                some = [r[begin : begin + 512] for r in rows]
                near = linked([r[:, None] for r in some], [r[None, :] for r in index])
                for k in np.flatnonzero(near.any(1)):
                    hits = forest.join(np.flatnonzero(near[k]))
                    a_out.append(np.full(len(hits), some[-1][k]))
                    b_out.append(index[-1][hits])

        for batch in batches:
            part, key, block, is_probe, *rows = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = [r.view(np.uint64) for r in rows]
            n = len(part)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            new[0] = (part[0], key[0], block[0]) != at
            begins = np.flatnonzero(new)
            bounds = np.concatenate(([0] if not new[0] else [], begins, [n])).astype(int)
            n_probe = np.add.reduceat(is_probe.astype(np.int64), bounds[:-1])
            sizes = np.diff(bounds)
            last = len(bounds) - 2
            small = (n_probe == 1) & (sizes == 2)
            small[[0, last]] = False
            one = bounds[:-1][small]
            i, p = [r[one] for r in rows], [r[one + 1] for r in rows]
            ok = linked(p, i)
            if ok.any():
                a_out.append(p[-1][ok])
                b_out.append(i[-1][ok])
            for s in np.flatnonzero(~small & ((n_probe > 0) & (n_probe < sizes) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == last))):
                lo, hi = bounds[s], bounds[s + 1]
                if new[lo]:
                    grown, index, forest, at = [], None, None, (part[lo], key[lo], block[lo])
                cut_at = lo + int((~is_probe[lo:hi]).sum())
                if cut_at > lo:
                    grown.append(tuple(r[lo:cut_at] for r in rows))
                if hi > cut_at and grown:
                    if index is None:
                        index = [np.concatenate(x) for x in zip(*grown)]
                    probe([r[cut_at:hi] for r in rows])
            if a_out:
                a, b = np.concatenate(a_out), np.concatenate(b_out)
                a_out.clear()
                b_out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def links(fps: DataFrame, tau: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``tau`` bits of each other.

    Every pair within ``tau`` bits is found, and is joined by the returned links, directly or by
    way of others. An index bucket of more than ``BLOCK`` fingerprints is split by hash into blocks
    in different tasks, and its probes go to each block.
    """
    n = fps.count()
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, n, tau)
    entry = lambda k, mask: F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
    own_columns = ["fp"]
    index = fps.select(*own_columns, F.inline(F.array(*[entry(k, m) for k, (m, _) in enumerate(parts)])))
    hot = index.groupBy("part", "key").count().where(F.col("count") > BLOCK).select("part", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    hot = materialise(hot, "hot")
    probes = None
    for k, (mask, flips) in enumerate(parts):
        own = fps.select(*own_columns, F.lit(k).alias("part"), F.explode(F.array(*[F.lit(_signed(f)) for f in flips])).alias("flip"))
        own = own.select(*own_columns, "part", F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.col("flip")).alias("key"))
        probes = own if probes is None else probes.union(own)
    if hot.isEmpty():
        index, probes = (f.withColumn("block", F.lit(0)) for f in (index, probes))
    else:
        index = index.join(hot, ["part", "key"], "left").withColumn("block", F.pmod(F.xxhash64(own_columns[-1], F.lit("b")), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int"))
        probes = probes.join(hot, ["part", "key"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    columns = ["part", "key", "block", "is_probe", *own_columns]
    rows = index.withColumn("is_probe", F.lit(False)).select(columns).union(probes.withColumn("is_probe", F.lit(True)).select(columns))
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartition(tasks, "part", "key", "block").sortWithinPartitions("part", "key", "block", "is_probe")
    return laid.mapInArrow(_links(tau), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, tau: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints link at ``tau`` or fewer differing bits; component_id is the smallest doc_id that
    links reach, the document itself included. Equal fingerprints are one node from the start, so
    copies are never paired with each other. Null and empty texts have the fingerprint 0 and link
    like any other; a null id is smallest only where a whole component has none; repeated rows stay;
    an empty table gives no rows; other columns are not read.
    """
    fps = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = connected_components(links(nodes.select("fp"), tau))
    named = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "root").select("fp", "component_id")
    out = fps.join(of_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_pairs(nodes: DataFrame, tau: int = 4) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp, ...) that connect all whose fingerprints are within ``tau`` bits.

    Nodes of one fingerprint are paired with the smallest of them, and these by ``links``.
    """
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-nodes")
    same = nodes.select("node", "fp").join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda c: first.select(F.col("fp").alias("fp" + c), F.col("first").alias(c))
    found = links(first.select("fp"), tau).toDF("fpa", "fpb")
    return same.union(found.join(of("a"), "fpa").join(of("b"), "fpb").select("a", "b"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``shingle_components``: that of the smallest id.

    Candidates come from the fingerprints of the shingle sets, by the pigeonhole search of ``links``,
    and are checked by their exact similarity. Similar texts whose fingerprints differ in more bits
    are found by the shingles that they share.
    Rows that share this id with others of the component are settled by the hash of their text;
    rows without an id are all of their own and stay.
    """
    found = shingle_components(docs, words, similarity, id_col, text_col, fingerprint_pairs).where("doc_id = component_id").select("doc_id").distinct()
    firsts = found.withColumnRenamed("doc_id", "__near_id")
    own = docs.columns
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), *[c for c in own if c not in (id_col, text_col)])
    kept = docs.where(F.col(id_col).isNotNull()).join(firsts, F.col(id_col) == F.col("__near_id"), "left_semi")
    kept = kept.withColumn("__near_rn", F.row_number().over(w)).where("__near_rn = 1").select(own)
    return kept.union(docs.where(F.col(id_col).isNull()))
