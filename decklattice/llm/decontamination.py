"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, worker_state

#: Words of a seed; seeds are the rarest in each window of so many neighbours.
SEED_WORDS, WINDOW = 3, 6
#: N-grams that occur this often in the corpus at most are all seeds.
RARE = 16
#: Items of fewer words count only where a text has them whole, word for word.
LEAST_WORDS = 8
#: Benchmark text, in characters, that is broadcast at a time; a larger benchmark goes in blocks.
BLOCK_CHARS = 16_000_000
KEPT_SCORES = 20_000
_WORDS = re.compile(r"\w+").findall
_BITS = 22


@dataclass(frozen=True)
class Block:
    """Some benchmark items as word numbers, and their seeds sorted by number of the n-gram."""

    vocabulary: dict[str, int]
    ids: list
    items: list[np.ndarray]
    grams: np.ndarray  # distinct n-grams, sorted
    gram: np.ndarray  # of each occurrence: which one
    item: np.ndarray  # in which item
    place: np.ndarray  # where in the item

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in _WORDS(text.lower())], np.int64)

    def grams_of(self, numbers: np.ndarray) -> np.ndarray:
        """The n-gram at each place, -1 where a word is in no item."""
        n = len(numbers) - SEED_WORDS + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        base = len(self.vocabulary) + 1
        for k in range(SEED_WORDS):
            own = numbers[k : k + n]
            out = out * base + own
            known &= own > 0
        return np.where(known, out, -1)


def _block(rows: list[tuple]) -> Block:
    vocabulary: dict[str, int] = {}
    ids, items = [], []
    for item_id, text in rows:
        words = _WORDS(text.lower())
        if len(words) < SEED_WORDS:
            continue
        ids.append(item_id)
        items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
    if (len(vocabulary) + 1) ** SEED_WORDS >= 2**63:
        raise ValueError("a block has too many different words: lower BLOCK_CHARS")
    empty = Block(vocabulary, ids, items, *(np.empty(0, np.int64) for _ in range(4)))
    per = [empty.grams_of(x) for x in items]
    if not per:
        return empty
    all_grams = np.concatenate(per)
    grams, gram = np.unique(all_grams, return_inverse=True)
    return Block(vocabulary, ids, items, grams, gram, np.repeat(np.arange(len(per)), [len(x) for x in per]), np.concatenate([np.arange(len(x)) for x in per]))


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark in blocks of at most BLOCK_CHARS characters (a longer item is a block)."""
    rows, size = [], 0
    for r in benchmark.select(id_col, F.coalesce(F.col(text_col), F.lit(""))).orderBy(id_col).toLocalIterator():
        if rows and size + len(r[1]) > BLOCK_CHARS:
            yield _block(rows)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1])
    yield _block(rows)


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Finder:
    """Where n-grams of a list stand in a text."""

    def __init__(self, block: Block, wanted: np.ndarray):
        self.block, self.wanted = block, wanted
        self.table = np.zeros(1 << _BITS, bool)
        self.table[_slot(wanted)] = True

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, index in ``wanted``) of each occurrence."""
        grams = self.block.grams_of(numbers)
        maybe = np.flatnonzero((grams >= 0) & self.table[_slot(grams)]) if len(grams) else np.empty(0, np.int64)
        if not len(maybe) or not len(self.wanted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.wanted, grams[maybe]), len(self.wanted) - 1)
        ok = self.wanted[at] == grams[maybe]
        return maybe[ok], at[ok]


def rare_seeds(block: Block, counts: np.ndarray) -> np.ndarray:
    """Indices of the occurrences whose n-gram is rare in the corpus, or the rarest of some window of their item.

    N-grams that no text has are no seeds. All up to RARE occurrences are, so an edited item is
    found by whatever n-gram is left of it. Of each stretch of WINDOW n-grams of an item the rarest
    is a seed however frequent it is, so a passage that many documents share is not lost.
    """
    own = counts[block.gram]
    seeds = set(np.flatnonzero((own > 0) & (own <= RARE)).tolist())
    places = np.where(own > 0, own, np.iinfo(np.int64).max)
    bounds = np.searchsorted(block.item, np.arange(len(block.items) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        for at in range(lo, max(lo + 1, hi - WINDOW + 1)):
            part = places[at : min(at + WINDOW, hi)]
            best = at + len(part) - 1 - int(np.argmin(part[::-1]))
            if own[best]:
                seeds.add(best)
    return np.array(sorted(seeds), np.int64)


def align(item: np.ndarray, text: np.ndarray) -> int:
    """Smith-Waterman score of the best local alignment: 1 a match, -1 a change, gap or insertion."""
    best, across = 0, np.arange(1, len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for w in item:
        new = np.maximum(row[:-1] + np.where(text == w, 1, -1), row[1:] - 1)
        new = np.maximum(new, 0)
        new = np.maximum(new, np.maximum.accumulate(new + across) - across)
        row = np.concatenate(([0], new))
        best = max(best, int(new.max()))
    return best


class Judge:
    """The best alignment of a text with the items of a block whose seeds it holds."""

    def __init__(self, block: Block, seeds: np.ndarray):
        self.block = block
        gram = block.gram[seeds]
        kinds, of = np.unique(gram, return_inverse=True)
        self.finder = Finder(block, block.grams[kinds])
        order = np.argsort(of, kind="stable")
        self.seeds, self.bounds = seeds[order], np.searchsorted(of[order], np.arange(len(kinds) + 1))
        self.kept: dict = {}

    def best(self, text: str) -> tuple:
        """(score as a share of the item's words, item id, items compared); 0 and None without a seed."""
        numbers = self.block.numbers(text)
        places, kinds = self.finder.hits(numbers)
        if not len(places):
            return 0.0, None, 0
        pairs: dict[int, list[int]] = {}
        for p, k in zip(places.tolist(), kinds.tolist()):
            for s in self.seeds[self.bounds[k] : self.bounds[k + 1]].tolist():
                pairs.setdefault(int(self.block.item[s]), []).append(p - int(self.block.place[s]))
        top: tuple = (0.0, None)
        for i in sorted(pairs):
            item, shifts = self.block.items[i], np.unique(pairs[i])
            room = len(item) // 4 + 8
            begins = np.maximum(shifts - room, 0)
            ends = np.minimum(shifts + len(item) + room, len(numbers))
            lo, hi = int(begins[0]), int(ends[0])
            regions = []
            for b, e in zip(begins[1:].tolist(), ends[1:].tolist()):
                if b > hi:
                    regions.append((lo, hi))
                    lo = b
                hi = max(hi, e)
            for lo, hi in [*regions, (lo, hi)]:
                for at in range(lo, max(hi - 2 * len(item), lo + 1), 4 * len(item) + 4 * room):
                    part = numbers[at : min(hi, at + 6 * len(item) + 6 * room)]
                    key = (i, part.tobytes())
                    if key not in self.kept:
                        if len(self.kept) >= KEPT_SCORES:
                            self.kept.clear()
                        self.kept[key] = align(item, part) / len(item)
                    if self.kept[key] > top[0] and (len(item) >= LEAST_WORDS or self.kept[key] == 1):
                        top = (self.kept[key], self.block.ids[i])
        return top[0], top[1], len(pairs)


def _counts(held):
    def run(batches):
        import pyarrow as pa

        block = held.value
        finder, n = Finder(block, block.grams), np.zeros(len(block.grams), np.int64)
        for b in batches:
            for text in b.column(0):
                _, at = finder.hits(block.numbers(text.as_py() or ""))
                np.add.at(n, at, 1)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found])], ["gram", "n"])

    return run


def _judges(docs: DataFrame, benchmark: DataFrame, text_col: str):
    """For each block of the benchmark, one after another, a broadcast (block, seeds): seeds by counts over all texts."""
    spark = docs.sparkSession
    for block in benchmark_blocks(benchmark):
        held = spark.sparkContext.broadcast(block)
        counts = np.zeros(len(block.grams), np.int64)
        if len(counts):
            found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counts(held), "gram bigint, n bigint")
            for r in found.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():  # at most one row per n-gram of the block
                counts[r.gram] = r.n
        held.unpersist()
        yield spark.sparkContext.broadcast((block, rare_seeds(block, counts)))


def _scored(slim: DataFrame, held, id_type) -> DataFrame:
    """Adds (score, item_id, n_items) of one block to rows whose last column is the text, which goes."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_type)

    def run(batches):
        import pyarrow as pa

        judge = Judge(*held.value)
        for b in batches:
            s = [judge.best(t.as_py() or "") for t in b.column(b.num_columns - 1)]
            columns = [pa.array([x[0] for x in s], pa.float64()), pa.array([x[1] for x in s], kind), pa.array([x[2] for x in s], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*b.schema.names[:-1], "score", "item_id", "n_items"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{own}, score double, item_id {id_type.simpleString()}, n_items bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, score, item_id, n_items) of every row.

    Seeds are n-grams of SEED_WORDS words of the benchmark items, lower-cased and without
    punctuation; the corpus is counted once to take the rare ones, and the rarest of each window of
    an item.
    Texts with a seed are aligned with its item around it. ``score`` is the best Smith-Waterman
    score as a share of the item's length (1: the whole item, word for word); a document is
    contaminated at ``threshold`` or more, so also by an edited copy or the larger part of an item.
    An item of fewer than LEAST_WORDS words counts only where it stands whole, word for word; one of
    fewer than SEED_WORDS words has no seed and is not searched: it stands in texts by chance.

    The benchmark is broadcast in blocks of bounded size, and where there are several, one at a time:
    the scores of each are written, by text, before the next one is sent. Null and empty texts score
    0 with a null item; of equal scores the smallest item id counts; ids may be of any type; repeated
    rows score alike; an empty table or benchmark gives no rows or scores of 0; other columns are not
    read.
    """
    id_type = benchmark.schema["item_id"].dataType
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    judges = _judges(docs, benchmark, text_col)
    held, following = next(judges), next(judges, None)
    if following is None:
        out = _scored(slim, held, id_type)
    else:
        key = F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"), F.crc32(F.col("text").cast("binary")).alias("c"))
        texts = slim.select(key.alias("key"), "text")
        done = []
        while held is not None:
            done.append(materialise(_scored(texts, held, id_type).where("n_items > 0").distinct(), "block-scores"))
            held.unpersist()
            held, following = following, next(judges, None)
        every = reduce(DataFrame.union, done)
        least = every.groupBy("key").agg(F.max("score").alias("score"), F.sum("n_items").alias("n_items"))
        item = every.select("key", "score", "item_id").join(least.select("key", "score"), ["key", "score"]).groupBy("key").agg(F.min("item_id").alias("item_id"))
        best = least.join(item, "key")
        out = slim.select("doc_id", key.alias("key")).join(best, "key", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score") > 0, F.col("item_id")).alias("item_id"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))
    return out.select("doc_id", (F.col("score") >= threshold).alias("contaminated"), "score", "item_id", "n_items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``contamination`` finds, columns and types as they are.

    One pass over the texts for each block of the benchmark, written before the next where there are
    several.
    """
    at, first = docs.columns.index(text_col), True
    judges = _judges(docs, benchmark, text_col)
    held = next(judges)
    while held is not None:
        following = next(judges, None)

        def run(batches, held=held):
            import pyarrow as pa

            worker_state(None, None)
            judge = Judge(*held.value)
            for b in batches:
                yield b.filter(pa.array([judge.best(t.as_py() or "")[0] < threshold for t in b.column(at)], pa.bool_()))
            del judge
            b = None
            give_back()  # idle workers stay while later stages run

        docs = docs.mapInArrow(run, docs.schema)
        if following is not None or not first:
            docs = materialise(docs, "block-kept")
        held, first = following, False
    return docs
