"""The training-data operators as queries over whole tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, langid, licenses, media, mixing, quality, simhash, substring, suffixes, tokencount


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that goes for a near duplicate."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, copy, text): all documents replicated to equal weights of the sources, whole
    texts in the global random order."""
    mixed = mixing.replicate(_documents(spark, sf_dir), copy_col="copy")
    return mixed.select("doc_id", "source", "copy", "text")


def op3_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles and hashes of the images made of all documents."""
    images = media.rendered(_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "image")
    return media.tiles(images).drop("image")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, license, score) of all documents."""
    return licenses.find_licenses(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_word, end_word, longest_match) of all repeated passages."""
    return substring.repeated_substrings(_documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded): all documents encoded, and what their ids decode to."""
    return bpe.encode(_documents(spark, sf_dir).select("doc_id", "text"), decoded_col="decoded").select("doc_id", "ids", "decoded")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_word, end_word, is_copy, first_doc_id) of all repeated passages."""
    return suffixes.repeated_passages(_documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of all documents, which rules fail, and which documents to keep."""
    return quality.measure(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, predicted_lang, margin, ambiguous) of all documents."""
    docs = _documents(spark, sf_dir)
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs)).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of all documents."""
    return tokencount.count_tokens(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash_near_dedup, op2_mix_sources, op3_media_tiles, op4_license_scan, op5_substring_dedup, op6_bpe, op7_suffix_array_dedup, op8_quality_rules, op9_language_id, op10_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.oracle_sql(),
        "op4_license_scan": licenses.oracle_sql(),
        "op8_quality_rules": quality.oracle_sql(),
    }


