"""Training-corpus pipeline: five stages from raw documents to packed token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenetlog.llm import common, decontamination, minhash, packing, quality_rules, substrings
from tenetlog.llm.queries import labels, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.passing(docs, labels(common.prepared(spark), sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, over five-word shingles."""
    common.prepared(spark)
    return minhash.one_of_each(docs, words=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated 35-word windows cover; every document stays."""
    common.prepared(spark)
    return substrings.cleaned(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, common.prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    common.prepared(spark)
    return packing.pack_table(docs, *tokenizer_file())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packed_sequences),
]

# Forest, signatures and tokenizer have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written before the next one reads it."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
