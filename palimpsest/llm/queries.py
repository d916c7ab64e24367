"""The registered opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licences, mixing, ngram_join, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_checksums

    return token_checksums(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import stored_media_digests

    return stored_media_digests(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import substring_report

    return substring_report(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("placements")).cast("long").alias("taken"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .html_text import main_text

    return main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import passage_report

    return passage_report(_table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licence_matches

    return licence_matches(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_flac_media": op2_flac_media,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_ngram_join": op5_ngram_join,
    "op6_bpe": op6_bpe,
    "op7_html_text": op7_html_text,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_passages": op9_near_passages,
    "op10_licence_scan": op10_licence_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": suffixes.oracle_sql(),
    "op4_mix_sources": mixing.oracle_sql(),
    "op5_ngram_join": ngram_join.oracle_sql(),
    "op10_licence_scan": licences.oracle_sql(),
}
