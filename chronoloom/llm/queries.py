"""The registered queries of the corpus operators: thin layers that derive result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, embedding_dedup, language_id, line_dedup, piece_count, sharding, simhash, substring_dedup, token_output
from .common import documents, fresh_dir


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "tokens")
    token_output.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), out, end_id=2)
    read = token_output.read_tokens(spark, out)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir), shards=40, overhead=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = piece_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    both = byte_bpe.decode(encoded, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH doc AS (SELECT *, row_number() OVER () AS n, md5(coalesce(text, '')) AS text_md5 FROM documents),
line AS (
  SELECT n, doc_id, text_md5, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM doc),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key
           HAVING count(DISTINCT (doc_id, text_md5)) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY n, doc_id
"""


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_hits(docs, benchmark, window=13)
    n_hit, n_words = decontaminate.hit_words("hits.runs"), F.col("hits.n_words")
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(n_hit, n_words, 20).alias("contaminated"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=20)
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": op1_token_output,
        "op2_sharding": op2_sharding,
        "op3_token_counts": op3_token_counts,
        "op4_language_id": op4_language_id,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_line_dedup": op6_line_dedup,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_simhash": op8_simhash,
        "op9_decontamination": op9_decontamination,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL}


__all__ = ["oracle_sql", "queries"]
