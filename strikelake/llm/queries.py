"""Registered queries of this folder, each the operator over its whole table, and their DuckDB texts."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .codes import read_documents, write_tokens
from .conversations import damaged, repair_conversations
from .decontaminate import CONTAMINATION_SQL, contamination
from .licenses import scan_licenses, scan_sql
from .mixing import mix
from .quality import quality_scores
from .repeats import without_repeats
from .search import top_k
from .shards import interleaved_shards
from .shared import fold_of
from .simhash import near_duplicates
from .spelling import spelling_variants, word_counts
from .token_counts import section_tokens
from .toxicity import toxicity_scores

#: The vocabulary file is the caller's to name; it is not part of this repository.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: White space after the end of a sentence: the next word's token starts with it, and so crosses.
SENTENCE_END = r"(?<=[.!?])\s+|\n"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_codes(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf, "documents"), path, TOKENIZER)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_interleaved_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = interleaved_shards(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_hash")


def _judged(scores: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scores.select(
        "doc_id",
        (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), 5, 0), 5, 0)


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return section_tokens(table(spark, sf, "documents"), TOKENIZER, separator=SENTENCE_END, rule="most")


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), 3, 1), 3, 1)


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf, "documents"), typo_every=97))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf, "conversations")))


def op13_repeat_removal(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeats(table(spark, sf, "documents"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before,
         sum(source_size) OVER () AS total, sum(w) OVER () AS w_all, row_number() OVER (ORDER BY 3 * source_size / w, source IS NULL, source) AS n
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT arg_min((total - cap_before) / (w_all - w_before), n) AS rate FROM r
  WHERE (total - cap_before) / (w_all - w_before) * w <= 3 * source_size),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, rate * w) AS target FROM r, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
g AS (SELECT source, k, sum(size) AS size FROM d GROUP BY ALL),
p AS (SELECT source, k, size, sum(size) OVER (PARTITION BY source ORDER BY k) - size AS before FROM g),
c AS (
  SELECT p.source, min(p.k) AS cut FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
  WHERE p.before + p.size / 2 > e.target - e.epochs * e.source_size GROUP BY p.source)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (CASE WHEN e.source_size > 0 THEN d.size * (e.epochs + CASE WHEN c.cut IS NULL OR d.k < c.cut THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

#: DuckDB has no crc32, so this text gives every column but text_crc32; a test holds both against the query.
SHARDS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
f AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY k) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, k) - 1 AS place, count(*) OVER () AS n FROM f),
s AS (SELECT *, (place * 8) // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, 'rows' AS law, shard::INTEGER AS shard, (place - (shard * n + 7) // 8)::BIGINT AS slot FROM s
"""

ENTRIES = {
    "op1_token_codes": (op1_token_codes, None),
    "op2_interleaved_shards": (op2_interleaved_shards, None),
    "op3_licenses": (op3_licenses, scan_sql()),
    "op4_decontamination": (op4_decontamination, CONTAMINATION_SQL),
    "op5_toxicity": (op5_toxicity, None),
    "op6_simhash": (op6_simhash, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_mixing": (op8_mixing, MIX_SQL),
    "op9_top_k": (op9_top_k, TOP_K_SQL),
    "op10_quality": (op10_quality, None),
    "op11_spelling_variants": (op11_spelling_variants, None),
    "op12_conversation_repair": (op12_conversation_repair, None),
    "op13_repeat_removal": (op13_repeat_removal, None),
}
