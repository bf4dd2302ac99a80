"""Registered queries of the operators over ``documents`` (and ``labels``), and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe,
    exact_dedup,
    lexical_search,
    license_scan,
    lm_scoring,
    near_dedup,
    packing,
    phrase_mining,
    quality_rules,
    secret_scan,
    substring_dedup,
    toxicity,
    warc_archive,
)
from .common import benchmark, documents, labels, pages

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files have ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file(WORD_BPE))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), tokenizer_file(BYTE_BPE), tokenizer_pattern())


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.page_records(pages(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(documents(spark, sf_dir), benchmark(spark, sf_dir))


QUERIES = (
    op1_near_dedup,
    op2_lm_scoring,
    op3_exact_dedup,
    op4_secret_scans,
    op5_quality_rules,
    op6_license_scans,
    op7_toxicity,
    op8_best_fit_packing,
    op9_substring_dedup,
    op10_byte_bpe,
    op11_phrase_mining,
    op12_warc,
    op13_lexical_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": near_dedup.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op9_substring_dedup": substring_dedup.ORACLE,
        "op11_phrase_mining": phrase_mining.ORACLE,
        "op12_warc": warc_archive.ORACLE,
        "op13_lexical_search": lexical_search.ORACLE,
    }
