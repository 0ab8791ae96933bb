"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters, nothing else.
SPACE_RX = r"[\x20\x09-\x0D]+"
NOT_SPACE_RX = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which an action removes its shuffle files.
CLEANUP = "spark.sql.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the files that a task writes at once before it sorts its rows by bucket.
OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Spark's setting of the rows of an Arrow batch.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RX), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session (one machine, as in tests) gets a temporary
    folder; any other one is an error, as executors would write where nobody else can read.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        named = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Actions in this context remove their shuffle files when they end: the result is written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(frame: DataFrame, kind: str, codec: str = "snappy") -> DataFrame:
    """Write the frame as Parquet below the shared folder and read it again; see ``discard``."""
    spark = frame.sparkSession
    path = fresh_path(spark, kind)
    with shuffles_removed(spark):
        frame.write.option("compression", codec).parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.scratch_path = path
    return out


def materialise_by(frame: DataFrame, kind: str, key: str, codec: str = "snappy") -> DataFrame:
    """``materialise`` in buckets by a key: joins on it read the rows where they are and do not shuffle them."""
    spark = frame.sparkSession
    path, n = fresh_path(spark, kind), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    before = spark.conf.get(OPEN_WRITERS, "0")
    spark.conf.set(OPEN_WRITERS, "8")  # a task has one bucket or few: they need not be sorted by bucket
    try:
        with shuffles_removed(spark):
            frame.write.format("parquet").option("compression", codec).option("path", path).bucketBy(n, key).saveAsTable(name)
    finally:
        spark.conf.set(OPEN_WRITERS, before)
    out = spark.table(name)
    out.scratch_path, out.scratch_table = path, name
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames; nothing may read them any more."""
    for f in frames:
        path = f.sparkSession._jvm.org.apache.hadoop.fs.Path(f.scratch_path)
        path.getFileSystem(f.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if hasattr(f, "scratch_table"):
            f.sparkSession.sql(f"DROP TABLE IF EXISTS {f.scratch_table}")


def give_back() -> None:
    """Give memory that the Python worker has freed back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can give memory back
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_STATE: list = [None, None]


def worker_state(key, make):
    """What ``make`` gives, kept by the Python worker from task to task until another key is asked for.

    Workers serve stage after stage, so what an earlier one held goes first, and the memory with
    it. None for both keeps nothing.
    """
    if _STATE[0] != key:
        _STATE[:] = [None, None]
        give_back()
        _STATE[:] = [key, make() if make else None]
    return _STATE[1]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2048):
    """Actions in this context pass texts to Python by at most so many rows at once."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
