"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blockanchors, fillmiddle, jaccard, langid, lmscore, mediatext, merkle, mixing, quality, recordfiles, sentencepieces, suffixdedup, urlrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the package is installed wherever tasks run."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mediatext.media_features(mediatext.with_media(_table(spark, sf_dir, "documents")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.train_and_score(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removal_report(_table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordfiles.tokenize_to_records(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(_table(spark, sf_dir, "pages"), urlrules.rules_table(spark, urlrules.STANDARD_RULES))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.train_language_identifier(docs))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).drop("ids")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockanchors.removal_report(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.middle_report(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_records": op3_token_records,
    "op4_url_filters": op4_url_filters,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": urlrules.FILTER_SQL,
    "op5_source_mixing": mixing.MIX_SQL,
    "op11_substring_dedup": blockanchors.REMOVAL_SQL,
    "op12_fill_in_middle": fillmiddle.MIDDLE_SQL,
    "op13_merkle_manifest": merkle.MANIFEST_SQL,
}
