"""Incremental auditing: new documents as a stream, each distinct text scored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_stream(docs: DataFrame, text: str = "text", seen_at: str | None = None, keep: str = "7 days") -> DataFrame:
    """Distinct texts with their sentence counts and claim types; with ``seen_at``, duplicates are remembered for ``keep``."""
    marked = docs.withColumn("content_hash", F.sha2(text, 256))
    fresh = marked.withWatermark(seen_at, keep).dropDuplicatesWithinWatermark(["content_hash"]) if seen_at else marked.dropDuplicates(["content_hash"])
    return fresh.select("content_hash", F.size(T.sentences(F.col(text))).alias("n_sentences"), T.claim_type(F.col(text)).alias("claim_type"), T.checkability(F.col(text)).alias("checkability"))
