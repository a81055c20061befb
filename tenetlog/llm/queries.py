"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetlog.llm import (common, decontamination, html_text, language, licenses, minhash, packing, quality_rules, rule_ensemble,
                          sharding, spelling, sqlforms, substrings, token_counts, whitening)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> tuple[str, str]:
    """Path and pre-token pattern of a public vocabulary."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from two thirds of the ids."""
    remainder = common.id_remainder(F.col("doc_id"), 3)
    return language.predict(common.documents(spark, sf_dir), remainder != 1, remainder == 1)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over four-word shingles."""
    return minhash.cluster(common.documents(spark, sf_dir), words=4)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents, learned from four fifths of the labelled ids."""
    remainder = common.id_remainder(F.col("doc_id"), 5)
    return rule_ensemble.classify(common.documents(spark, sf_dir), labels(spark, sf_dir), remainder != 0, remainder == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts stay together."""
    return sharding.shard_table(common.documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of all documents."""
    return quality_rules.judge(common.documents(spark, sf_dir), labels(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated 35-word windows cover, of all documents."""
    return substrings.digest(common.documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents."""
    return token_counts.count_tokens(common.documents(spark, sf_dir), token_counts.byte_pieces(tokenizer_file()[0]))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and the items."""
    return decontamination.contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of all documents."""
    return licenses.scan(common.documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids from all documents."""
    return packing.pack_table(common.documents(spark, sf_dir), *tokenizer_file())


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(common.prepared(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of all embeddings."""
    return whitening.whiten(common.prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language_id, op2_minhash_dedup, op3_quality_classifier, op4_sharding, op5_quality_rules, op6_substring_dedup,
        op7_token_counts, op8_decontamination, op9_license_scan, op10_packing, op11_html_extraction, op12_embedding_whitening,
        op13_spelling_variants)
}
ORACLE_SQL: dict[str, str] = sqlforms.ORACLE_SQL
