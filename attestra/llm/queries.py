"""The queries of this subpackage and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, html_text, packing, perplexity, quality_rules, sharding, simhash, sql, tokens, url_rules, warc

SQL: dict[str, str] = {"op4_quality_rules": sql.QUALITY_RULES, "op6_url_filters": sql.URL_FILTERS, "op9_decontamination": sql.DECONTAMINATION}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path("word_bpe_49k.json")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", F.col("accepted").alias("kept"))


#: Rules of the URL query: verdict, host, start of the path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokens.pieces(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)
    return packing.pack(made, order=["doc_id", "piece", "ids_crc32"], capacity=2048)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_tokens": op8_tokens,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
}
