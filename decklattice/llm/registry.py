"""Queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, mixing, pii, quality, simhash, token_counts, token_files, toxicity, url_filter
from .common import table


#: The key of the registered query; a real run takes its own from a secret store.
PII_KEY = "demonstration key"
#: (rule, verdict) of op1: fixed values.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.labelled_by_rules(pages, URL_RULES), URL_RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.ratio_table(docs, table(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_files.TokenStore.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    read = store.digests(store.entries.select("doc_id", "ordinal"))
    return read.join(F.broadcast(store.shard_starts()), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS nul,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, md5(coalesce(text, '')) AS tie
  FROM documents),
s0 AS (SELECT src, nul, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src, nul),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY nul, src) - 1) % 3 + 1)::INT] AS w,
              CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS top FROM s0),
s2 AS (SELECT *, top / w AS fill FROM s1),
s3 AS (SELECT *, sum(top) OVER up - top AS before,
              sum(w) OVER (ORDER BY fill, nul, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
              CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS want
       FROM s2 WINDOW up AS (ORDER BY fill, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s4 AS (SELECT *, (want - before) / w_left AS lev FROM s3),
s5 AS (SELECT *, max(CASE WHEN lev <= fill THEN lev END) OVER () AS fin FROM s4),
s6 AS (SELECT src, nul, source_size, least(top, coalesce(fin * w, top)) AS target,
              CAST(CAST('0x' || substr(md5('mix:' || CASE WHEN nul THEN 'n' ELSE 's' END || src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM s5),
r AS (SELECT d.*, source_size, target, u,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e,
             CAST(row_number() OVER (PARTITION BY d.src, d.nul ORDER BY size, h, doc_id, tie) AS DOUBLE) AS place
      FROM d JOIN s6 ON d.src = s6.src AND d.nul = s6.nul)
SELECT doc_id, size, source_size, target,
       CAST((floor(e * place + u) - floor(e * (place - 1) + u)) * size AS BIGINT) AS taken
FROM r
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {"op8_mixing": OP8_SQL}
