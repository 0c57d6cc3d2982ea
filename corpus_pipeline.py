"""From raw documents to packed training sequences, in five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, packing, perplexity, quality_rules, simhash, tokens
from attestra.llm.common import written
from attestra.llm.queries import tokenizer_path


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines, and ``n_chars`` follows the text."""
    judged = quality_rules.judge(docs).where("kept")
    return judged.withColumns({"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text").cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is over their language's threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return perplexity.classify(docs, labels).where("accepted").select(*docs.columns)


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def apply_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 2048 tokens."""
    made = tokens.pieces(docs, tokenizer_path(), end_id=0, capacity=2048)
    return packing.pack(made, order=["doc_id", "piece", "ids_crc32"], capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("simhash_near_dedup", apply_near_dedup),
    ("benchmark_decontamination", apply_decontamination),
    ("best_fit_packing", apply_packing),
]

#: SQL can express neither the model's perplexities nor the fingerprints; tests/llm checks the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
