"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), does its work on all rows that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. NULLs, empty tables and repeated rows are treated as the
operators say: documents without words fail the quality rules, of repeated rows one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import bpe, frames, mixing, quality, simhash, suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules."""
    return quality.drop_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated passages; what is left empty goes."""
    return suffixes.drop_repeated_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that all sources have equal shares of characters, in random order."""
    return mixing.replicate(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded): token ids of each document, and the text they decode to."""
    return bpe.encode(docs.select("doc_id", "text"), decoded_col="decoded").select("doc_id", "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("passage dedup", passage_dedup),
    ("mix sources", mix_sources),
    ("bpe", encode),
]

#: Neither SimHash groups nor passages can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; between stages their tables are in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{frames.shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}")
            frames.keep_until_end(spark, path)
            docs = spark.read.parquet(path)
    return docs
