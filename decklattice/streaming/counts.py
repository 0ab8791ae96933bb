"""Streaming over mergeable count tables: files as they land, each counted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rates import RateSpec, counts, finished


def count_stream(spark: SparkSession, source: str, schema: str, spec: RateSpec, sink: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Count all files that are new since the last call into one partial count table per batch.

    A batch is written below its own number, so a batch that is repeated after a failure replaces
    itself and no row counts twice.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        counts(rows, spec).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current(spark: SparkSession, sink: str, spec: RateSpec) -> DataFrame:
    """The rate over all batches so far."""
    return finished([spark.read.parquet(sink)], spec.keys, spec.label)


def windowed_counts(events: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Events per window and keys, rows later than the watermark dropped (streams) or kept (batch)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
