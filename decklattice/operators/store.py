"""Versioned card and deck tables: upserts, conflicts, match chains, snapshots and versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A conflict rule takes (old, new) columns of one field and a test that both rows exist.
Conflict = Callable[[Column, Column], Column]


def keep_existing(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def keep_incoming(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def keep_longer(old: Column, new: Column) -> Column:
    longer = F.octet_length(new) > F.octet_length(old)
    return F.when(old.isNull() | longer, new).otherwise(old)


def keep_if_differs(old: Column, new: Column) -> Column:
    return F.when(new.isNotNull() & (old.isNull() | (F.sha2(new, 256) != F.sha2(old, 256))), new).otherwise(old)


def merge_keys(old: Column, new: Column) -> Column:
    """Shallow merge of two maps, the new one's keys win."""
    none = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k)), n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Conflict], default: Conflict = keep_incoming) -> DataFrame:
    """Full outer join by key, each field by its rule; the columns of ``old``."""
    fields = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*fields).alias("__old"))
    n = new.select(*keys, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in fields]).alias("__new"))
    both = o.join(n, keys, "full_outer")
    return both.select(*keys, *[rules.get(c, default)(F.col(f"__old.{c}"), F.col(f"__new.{c}")).alias(c) for c in fields])


def mirror(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table as its source is now: changed rows replaced, absent ones deleted."""
    return upsert(old.join(new.select(*keys), keys, "left_semi"), new, keys, {})


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def insert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows; a key that is there already raises when the result is read."""
    w = Window.partitionBy(*keys)
    both = table.unionByName(rows).withColumn("__n", F.count(F.lit(1)).over(w))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("duplicate key"))).otherwise(F.col("__n"))
    return both.withColumn("__n", checked).where("__n = 1").drop("__n")


def create_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key is new; of several with one key the least by its content."""
    rest = [c for c in rows.columns if c not in keys]
    body = F.struct(*rest)
    one = rows.groupBy(*keys).agg(F.min_by(body, F.to_json(body)).alias("__r")).select(*keys, "__r.*") if rest else rows.distinct()
    return table.unionByName(one.select(rows.columns).join(table.select(*keys), keys, "left_anti"))


def last_file_wins(files: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several files, of one key that of the last file."""
    merged = None
    for i, f in enumerate(files):
        f = f.withColumn("__file", F.lit(i))
        merged = f if merged is None else merged.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__file"))
    return merged.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__file")


def match_chain(entries: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], unknown: str) -> DataFrame:
    """Entries with ``card_id`` and ``match_kind``: the first step that knows the key, else the unknown card.

    A step is (kind, table of key columns and card_id, key columns). A key that a step's table has
    twice is ambiguous and matches nothing there.
    """
    out, found, kind = entries, F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, known, keys) in enumerate(steps):
        once = known.groupBy(*keys).agg(F.min("card_id").alias(f"__id{i}"), F.count_distinct("card_id").alias("__n")).where("__n = 1").drop("__n")
        out = out.join(once, keys, "left")
        hit = F.col(f"__id{i}")
        kind = F.coalesce(kind, F.when(hit.isNotNull(), F.lit(name)))
        found = F.coalesce(found, hit.cast("string"))
    return out.select(*entries.columns, F.coalesce(found, F.lit(unknown)).alias("card_id"), F.coalesce(kind, F.lit("unknown")).alias("match_kind"))


def version_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """(version, n_rows): a hash of all content, whatever the order or partitioning of rows.

    Row hashes are summed up in four 48-bit lanes, so no task ever sees the whole table.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    s = table.agg(*[F.coalesce(x, F.lit(0).cast("decimal(38,0)")).alias(f"l{k}") for k, x in enumerate(lanes)], F.count(F.lit(1)).alias("n_rows"))
    return s.select(F.sha2(F.concat_ws(":", "l0", "l1", "l2", "l3", "n_rows"), 256).alias("version"), "n_rows")


def dense_index(ids: DataFrame, key: str, most: int = 65_536, width: int = 3) -> DataFrame:
    """(key, card_index): ids in order as 0, 1, ...; more than ``most`` raise.

    Ids are numbered within groups that follow each other (texts by their first ``width`` characters,
    numbers by thousands), and the groups' sizes are summed up before them: no task has all ids.
    """
    one = ids.select(key).where(F.col(key).isNotNull()).distinct()
    text = dict(one.dtypes)[key] == "string"
    one = one.withColumn("__group", F.substring(key, 1, width) if text else F.floor(F.col(key) / 1000))
    sizes = one.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)  # one row per group
    starts = sizes.select("__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__group").orderBy(key)) - 1
    out = one.withColumn("__at", place).join(starts, "__group").select(key, (F.col("__start") + F.col("__at")).cast("int").alias("card_index"))
    return out.withColumn("card_index", F.when(F.col("card_index") >= most, F.raise_error(F.lit("too many cards")).cast("int")).otherwise(F.col("card_index")))


def deck_snapshot(copies: DataFrame, index: DataFrame, deck: str, card: str, unknown_index: int) -> DataFrame:
    """(deck, cards array<struct<card_index,count>>): misses merged under the unknown card, counts at most 255."""
    known = copies.join(index, copies[card] == index[index.columns[0]], "left").select(copies[deck], F.coalesce("card_index", F.lit(unknown_index)).alias("card_index"))
    n = known.groupBy(deck, "card_index").agg(F.least(F.count(F.lit(1)), F.lit(255)).cast("int").alias("count"))
    return n.groupBy(deck).agg(F.array_sort(F.collect_list(F.struct("card_index", "count"))).alias("cards"))


def majority_content(printings: DataFrame, group: list[str], fields: list[str], newest: str) -> DataFrame:
    """For each group and field the value that most printings have, of equal ones the newest."""
    long = printings.select(*group, newest, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))).where("value is not null")
    votes = long.groupBy(*group, "field", "value").agg(F.count(F.lit(1)).alias("n"), F.max(newest).alias("at"))
    best = votes.groupBy(*group, "field").agg(F.max_by("value", F.struct("n", "at", "value")).alias("value"))
    return best.groupBy(*group).pivot("field", fields).agg(F.first("value"))


def representative(printings: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The printing of each group that is least by the order columns."""
    rest = [c for c in printings.columns if c not in group]
    return printings.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*group, "r.*")


def compare(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Keys that one side lacks or whose values differ by more than the tolerance."""
    both = a.select(*keys, F.struct(*values).alias("a")).join(b.select(*keys, F.struct(*values).alias("b")), keys, "full_outer")
    differs = F.lit(False)
    for v in values:
        x, y = F.col(f"a.{v}").cast("double"), F.col(f"b.{v}").cast("double")
        differs = differs | ~((F.abs(x - y) <= tolerance) | (x.isNull() & y.isNull())) | (x.isNull() != y.isNull())
    kind = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(differs, "differs")
    return both.select(*keys, kind.alias("kind")).where("kind is not null")


def partitions(spark, root: str, by: list[str]) -> DataFrame:
    """The partitions of a table of files: their columns, once each."""
    return spark.read.parquet(root).select(*by).distinct()


def fingerprint(spark, path: str, version: str = "") -> DataFrame:
    """(fingerprint, n_files): a hash of a version and of every file's path, size and time; contents are not read.

    File hashes are summed up in lanes, so no task sees all of them. Equal fingerprints mean that
    what was built from the files can be used again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return version_of(files, ["path"]).select(F.sha2(F.concat(F.lit(version + ":"), "version"), 256).alias("fingerprint"), F.col("n_rows").alias("n_files"))


def compare_trees(reference: dict[str, DataFrame], candidate: dict[str, DataFrame], keys: dict[str, list[str]], tolerance: float) -> dict[str, object]:
    """Of each table name: ``only_reference``, ``only_candidate``, or the rows that ``compare`` finds to differ."""
    out: dict[str, object] = {n: "only_reference" for n in reference if n not in candidate} | {n: "only_candidate" for n in candidate if n not in reference}
    for n in reference.keys() & candidate.keys():
        values = [c for c in reference[n].columns if c not in keys[n]]
        out[n] = compare(reference[n], candidate[n], keys[n], values, tolerance)
    return out
