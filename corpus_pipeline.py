"""The training-data pipeline: language ID, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import decontaminate, language, minhash, packing, substring
from tradewind.llm.common import stored, workers_import
from tradewind.llm.queries import word_tokenizer

#: SQL cannot express learned languages or a tokenizer; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """A text that was cut has a new length: n_chars follows it, if the table has it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from their labels; others go."""
    return language.in_known_language(docs, language.learned(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays, the one with the smallest id."""
    return minhash.deduplicated(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that start elsewhere too are cut; documents left without a word go."""
    cut = substring.without_repeats(docs)
    return _counted(cut.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents over the coverage limit go, shorter benchmark spans are cut from the others."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.decontaminated(docs, items), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.packed(docs, word_tokenizer())


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder that the next stage reads."""
    workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
