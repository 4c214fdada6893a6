"""The corpus pipeline: each stage works on what the one before it kept.

Every stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import byte_bpe, decontaminate, language_id, line_dedup, near_copies
from chronoloom.llm.common import documents, materialise, remove_dir, scratch, unique_names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; the rest goes."""
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all texts."""
    name, row = unique_names(docs, "kept", "row")
    rest = F.struct(F.lit(None).alias(name), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])  # whatever they are called
    kept = line_dedup.apply_bitmaps(docs.select("doc_id", "text", rest.alias(row)), line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1), kept=name)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col(name))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return kept.select(*[made[c].alias(c) if c in made else F.col(row)[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) stays, that of the smallest doc_id."""
    return near_copies.keep_one(docs, words=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), path), path)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Models, fingerprints and byte-pair merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before:
            remove_dir(spark, before)
        before = docs.table_path
    return docs
