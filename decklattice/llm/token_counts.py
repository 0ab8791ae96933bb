"""Token counts of whole documents, huge ones by overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest text, in characters, that is encoded in one piece, and the first overlap of chunks.
CHUNK, OVERLAP = 65_536, 512


def _counts(path: str, chunk: int, overlap: int, limit: int):
    def run(batches):
        import pyarrow as pa

        from .encoders import word_counter

        counter = word_counter(path, chunk, overlap)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                texts = [t or "" for t in b.column(1).to_pylist()]
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    A document above ``chunk`` characters is encoded in overlapping chunks with offsets, which are
    spliced where both neighbours provably agree (``encoders.resync_ids``); its counts are those of
    the whole text. One task holds one text and its chunk at a time. Null and empty texts have 0
    bytes and tokens; a null id stays null; repeated rows are counted each; an empty table gives no
    rows; other columns are not read. ``tokenizer_path`` must be readable on the executors.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_counts(tokenizer_path, chunk, overlap, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
