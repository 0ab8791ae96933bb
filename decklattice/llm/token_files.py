"""Raw token-id shards with a minimal perfect hash index from document key to place."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, worker_state

#: Keys in a bucket of the index on average, and the slots tried for a group of keys at once.
BUCKET_KEYS, TRIES = 1024, 64


def _fs(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, ordinal bigint, shard int, at bigint, n_tokens bigint"


def _write_shards(root: str, tokenizer_path: str, end_id: int, dtype: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .encoders import piece_encoder

        task = TaskContext.get()
        encoder = piece_encoder(tokenizer_path, dtype)
        end, width = np.asarray([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        fs, path = _fs(root)
        shard = task.partitionId()
        name = f"{path}/ids/shard-{shard:06d}.bin"
        draft = f"{name}.{task.taskAttemptId()}"
        at, last, ordinal, wrote = 0, object(), 0, False
        fs.create_dir(f"{path}/ids", recursive=True)
        with fs.open_output_stream(draft) as out:
            for whole in batches:
                for begin in range(0, whole.num_rows, 2048):
                    b = whole.slice(begin, 2048)
                    keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                    sizes, ordinals = [], []
                    encoded = encoder.encode_all([t or "" for t in texts])
                    out.write(end.join([*encoded, b""]))
                    for key, ids in zip(keys, encoded):
                        sizes.append(len(ids) // width + 1)
                        ordinal = ordinal + 1 if key == last else 0
                        last = key
                        ordinals.append(ordinal)
                    wrote = True
                    ends = np.cumsum(sizes) + at
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(ordinals, pa.int64()), pa.array([shard] * len(keys), pa.int32()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())],
                        ["doc_id", "ordinal", "shard", "at", "n_tokens"],
                    )
                    at = int(ends[-1])
        if wrote:
            fs.move(draft, name)  # the same content whichever attempt comes last
        else:
            fs.delete_file(draft)

    return run


def key_hash(doc_id, ordinal):
    """Two independent 64-bit hashes of a document key, as columns."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), doc_id.isNull().cast("int").cast("string"), ordinal.cast("string"))
    return F.xxhash64(key), F.xxhash64(F.concat(F.lit("f"), key))


def _mix(h: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser over hashes xor a seed."""
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _groups(h: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h, 1) % np.uint64(max(1, -(-n // 4)))).astype(np.int64)


def build_block(h: np.ndarray) -> np.ndarray:
    """Displacement seeds that send n distinct hashes to n slots, one each (hash and displace)."""
    n = len(h)
    g = _groups(h, n)
    seeds = np.zeros(max(1, -(-n // 4)), np.uint32)
    order = np.argsort(g, kind="stable")
    begins = np.searchsorted(g[order], np.arange(len(seeds) + 1))
    taken = np.zeros(n, bool)
    size = np.uint64(max(n, 1))
    for k in np.argsort(-np.diff(begins), kind="stable"):
        own = h[order[begins[k] : begins[k + 1]]]
        if not len(own):
            break
        seed = 2
        while True:
            slots = (_mix(own[None, :], np.arange(seed, seed + TRIES, dtype=np.uint64)[:, None]) % size).astype(np.int64)
            free = ~taken[slots].any(1)
            if len(own) > 1:
                s = np.sort(slots, 1)
                free &= (s[:, 1:] != s[:, :-1]).all(1)
            hit = np.flatnonzero(free)
            if len(hit):
                seeds[k] = seed + hit[0]
                taken[slots[hit[0]]] = True
                break
            seed += TRIES
    return seeds


def slots_of(h: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    """The slot of each hash in a block of n keys, in constant time per key."""
    return (_mix(h, seeds[_groups(h, n)].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


BLOCK = "bucket bigint, n int, seeds binary, prints binary, shards binary, ats binary, sizes binary"


def _build(pdf):
    import pandas as pd

    worker_state(None, None)  # the encoder is not needed any more
    h = pdf["h"].to_numpy().view(np.uint64)
    seeds = build_block(h)
    at = np.argsort(slots_of(h, len(h), seeds), kind="stable")
    arrays = (pdf["print"].to_numpy().astype("<i8"), pdf["shard"].to_numpy().astype("<i4"), pdf["at"].to_numpy().astype("<i8"), pdf["n_tokens"].to_numpy().astype("<i8"))
    return pd.DataFrame([[int(pdf["bucket"].iloc[0]), len(h), seeds.astype("<u4").tobytes(), *[a[at].tobytes() for a in arrays]]], columns=[c.split()[0] for c in BLOCK.split(", ")])


class TokenStore:
    """Token-id files under one folder: ``ids/`` (shards), ``entries/`` and ``index/`` (Parquet).

    A shard holds the ids of its documents one after another as raw little-endian integers. The
    index has a block for each bucket of keys: displacement seeds that send the n keys of the block
    to n slots without collision, and at each slot the key's fingerprint (64 bits), shard, offset
    and length. A key that was never stored is refused by the fingerprint.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        fs, path = _fs(root)
        with fs.open_input_stream(f"{path}/meta.json") as f:
            self.meta = json.loads(f.read())

    @classmethod
    def write(cls, docs: DataFrame, tokenizer_path: str, end_id: int = 2, dtype: str = "<u2", root: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> "TokenStore":
        """Encode every text, append ``end_id`` and write shards in ascending order of the id.

        Null texts count as empty, a null id sorts first; rows of one id follow each other in order
        of the text, as ordinals 0, 1, ...; an empty table gives a store without shards. Other
        columns are not read. A shard is written under a draft name and moved into place, so that
        a repeated or lost task leaves one whole file.
        """
        spark = docs.sparkSession
        root = root or fresh_path(spark, "tokens")
        n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        kind = slim.schema["doc_id"].dataType.simpleString()
        laid = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
        with small_batches(spark):
            laid.mapInArrow(_write_shards(root, tokenizer_path, end_id, dtype), _schema(kind)).write.parquet(f"{root}/entries")
        entries = spark.read.schema(_schema(kind)).parquet(f"{root}/entries")
        buckets = max(1, -(-entries.count() // BUCKET_KEYS))
        keyed = cls._keyed(entries, buckets)
        keyed.groupBy("bucket").applyInPandas(_build, BLOCK).write.parquet(f"{root}/index")
        fs, path = _fs(root)
        with fs.open_output_stream(f"{path}/meta.json") as f:
            f.write(json.dumps({"buckets": buckets, "dtype": dtype, "end_id": end_id, "id_type": kind}).encode())
        return cls(spark, root)

    @staticmethod
    def _keyed(keys: DataFrame, buckets: int) -> DataFrame:
        h, p = key_hash(F.col("doc_id"), F.col("ordinal"))
        return keys.withColumns({"h": h, "print": p}).withColumn("bucket", F.pmod(F.col("print"), F.lit(buckets)).cast("bigint"))

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.schema(_schema(self.meta["id_type"])).parquet(f"{self.root}/entries")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, ordinal, shard, at, n_tokens) of each (doc_id, ordinal); nulls where not stored."""
        index = self.spark.read.schema(BLOCK).parquet(f"{self.root}/index")
        kind = self.meta["id_type"]

        def find(keys, blocks):
            import pandas as pd

            out = keys[["doc_id", "ordinal"]].copy()
            if not len(blocks) or not len(keys):
                return out.assign(shard=pd.array([None] * len(out), "Int32"), at=pd.array([None] * len(out), "Int64"), n_tokens=pd.array([None] * len(out), "Int64"))
            b = blocks.iloc[0]
            slot = slots_of(keys["h"].to_numpy().view(np.uint64), b["n"], np.frombuffer(b["seeds"], "<u4"))
            known = np.frombuffer(b["prints"], "<i8")[slot] == keys["print"].to_numpy()
            for name, column, dtype, of in (("shard", "shards", "Int32", "<i4"), ("at", "ats", "Int64", "<i8"), ("n_tokens", "sizes", "Int64", "<i8")):
                out[name] = pd.array(np.frombuffer(b[column], of)[slot], dtype)
                out.loc[~known, name] = None
            return out

        keyed = self._keyed(keys, self.meta["buckets"]).select("bucket", "doc_id", "ordinal", "h", "print")
        return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, _schema(kind))

    def read(self, keys: DataFrame) -> DataFrame:
        """``lookup`` with the payload: ``ids`` binary, raw little-endian ids; null where not stored."""
        places = self.lookup(keys)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        laid = places.repartition(n, "shard", (F.col("at") / 1_000_000).cast("bigint")).sortWithinPartitions("shard", "at")
        return laid.mapInArrow(_read(self.root, self.meta["dtype"], "ids"), _schema(self.meta["id_type"]) + ", ids binary")

    def digests(self, keys: DataFrame) -> DataFrame:
        """``read`` with ``ids_crc32``, of the ids as unsigned 32-bit integers, in place of the ids."""
        places = self.lookup(keys)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        laid = places.repartition(n, "shard", (F.col("at") / 1_000_000).cast("bigint")).sortWithinPartitions("shard", "at")
        return laid.mapInArrow(_read(self.root, self.meta["dtype"], "crc"), _schema(self.meta["id_type"]) + ", ids_crc32 bigint")

    def shard_starts(self) -> DataFrame:
        """(shard, shard_start): ids in all shards before; one row per file."""
        from pyspark.sql import Window

        totals = self.entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        return totals.select("shard", (F.sum("n").over(before) - F.col("n")).alias("shard_start"))


def _read(root: str, dtype: str, what: str):
    def run(batches):
        import zlib

        import pyarrow as pa

        worker_state(None, None)
        fs, path = _fs(root)
        width, name, f = np.dtype(dtype).itemsize, None, None
        for whole in batches:
            for begin in range(0, max(whole.num_rows, 1), 256):
                b = whole.slice(begin, 256)
                out = []
                for shard, at, n in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                    if shard is None:
                        out.append(None)
                        continue
                    if shard != name:
                        if f:
                            f.close()
                        name, f = shard, fs.open_input_file(f"{path}/ids/shard-{shard:06d}.bin")
                    ids = f.read_at(n * width, at * width)
                    out.append(zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes()) if what == "crc" else ids)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64() if what == "crc" else pa.binary())], [*b.schema.names, "ids_crc32" if what == "crc" else "ids"])
        if f:
            f.close()

    return run
