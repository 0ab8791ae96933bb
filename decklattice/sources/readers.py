"""Readers of landed raw files, and sinks."""

from __future__ import annotations

import base64
import re
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (gzip as well) with a stated schema; broken lines have nulls."""
    return spark.read.schema(schema).json(path)


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def wide_csv(spark: SparkSession, path: str, counts: str) -> DataFrame:
    """A wide CSV whose header gives the columns; those that match ``counts`` become integers."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast("int").alias(c) if re.fullmatch(counts, c) else F.col(f"`{c}`") for c in raw.columns])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): one row per HTML file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def archive_members(spark: SparkSession, path: str, suffix: str = "", stream: bool = False) -> DataFrame:
    """(archive, member, text) of tar archives, compressed or not: one archive per task, member by member.

    An archive of up to 2 GB is one value that Spark reads. With ``stream`` tasks read larger ones
    piece by piece themselves, from where Arrow's file systems reach.
    """

    def members(batches):
        import io

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if stream:
                    system, own = fs.FileSystem.from_uri(name)
                    raw = system.open_input_stream(own, compression=None)
                else:
                    raw = io.BytesIO(content)
                with raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(suffix):
                            text = tar.extractfile(m).read().decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.name]), pa.array([text])], ["archive", "member", "text"])

    raw = spark.read.format("binaryFile").load(path)
    raw = raw.select(F.replace("path", F.lit("file:/"), F.lit("file:///")).alias("path"), F.lit(None).cast("binary")) if stream else raw.select("path", "content")
    return raw.mapInArrow(members, "archive string, member string, text string")


def newest_build(rows: DataFrame, keys: list[str], build: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), build).alias("r")).select(*keys, "r.*")


def text_of_html(column: Column) -> Column:
    """Text without scripts, styles, comments and tags; the common entities resolved."""
    t = F.regexp_replace(column, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def data_attributes(column: Column) -> Column:
    """The data-* attributes of the first tag that has some, as a map."""
    tag = F.regexp_extract(column, r"(<[^>]*\bdata-[^>]*>)", 1)
    names = F.regexp_extract_all(tag, F.lit(r'data-([\w-]+)="([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(r'data-([\w-]+)="([^"]*)"'), F.lit(2))
    return F.map_from_arrays(names, values)


def decode_deckstring(text: str) -> list[tuple[int, int]]:
    """(card number, copies) of a base64 varint deck code; a broken code gives no cards."""
    try:
        raw = base64.b64decode(text, validate=True)
    except (ValueError, TypeError):
        return []
    numbers, value, shift = [], 0, 0
    for byte in raw:
        value |= (byte & 127) << shift
        shift += 7
        if not byte & 128:
            numbers.append(value)
            value = shift = 0
    if len(numbers) < 4 or numbers[0] != 0:
        return []
    it = iter(numbers[3:])
    out: list[tuple[int, int]] = []
    try:
        for _ in range(next(it)):
            next(it)  # heroes
        for copies in (1, 2):
            out += [(next(it), copies) for _ in range(next(it))]
        for _ in range(next(it)):
            card = next(it)
            out.append((card, next(it)))
    except StopIteration:
        return []
    return out


def deckstrings(codes: Column) -> Column:
    """Deck codes as arrays of (card, n)."""

    @F.pandas_udf("array<struct<card:bigint,n:int>>")
    def decode(texts):
        return texts.map(lambda t: [{"card": c, "n": n} for c, n in decode_deckstring(t)] if t else [])

    return decode(codes)


def write_partitioned(frame: DataFrame, path: str, by: list[str], rows_per_file: int = 50_000) -> None:
    frame.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def write_json_shards(frame: DataFrame, path: str, rows_per_shard: int) -> None:
    frame.write.mode("append").option("maxRecordsPerFile", rows_per_shard).option("compression", "gzip").json(path)


def with_rejects(frame: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with their reason)."""
    r = frame.withColumn("reject_reason", reason)
    return r.where("reject_reason is null").drop("reject_reason"), r.where("reject_reason is not null")


def with_lineage(frame: DataFrame, versions: dict[str, str]) -> DataFrame:
    """The frame with versions in the metadata of its first column; Parquet keeps them."""
    c = frame.columns[0]
    return frame.withColumn(c, F.col(c).alias(c, metadata=versions))
