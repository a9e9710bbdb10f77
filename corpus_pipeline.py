"""From raw documents to token files: quality rules, near duplicates, benchmark passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written
and read again before the next. All but the last give the columns of `documents`. Null, empty and
repeated rows, empty tables and further columns are as the five operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fenwright.llm import _store, decontaminate, mix_sources, near_dedup, quality_rules, token_output

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled threshold reject go."""
    return quality_rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more) stays."""
    return near_dedup.filter_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources share the budget by weight; a document taken twice is there twice."""
    return mix_sources.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and what they hold of each document."""
    import public_tokenizers

    return token_output.judge(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixture", mixture),
    ("token output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one is written; the last one stays, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = _store.new_path(spark, name.replace(" ", "-"))
        found = stage(spark, docs, sf_dir)
        found.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            _store.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
