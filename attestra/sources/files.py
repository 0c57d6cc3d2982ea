"""Sources and sinks: typed JSON lines, checked reference files, fixtures, caches, configuration, reports."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.text import slug

CASES = (
    "case_id string, document_path string, claim_text string, claim_line int, source_fixture string, source_id string, source_url string, gold_relation string, gold_evidence_span string, "
    "claim_type string, mutation_type string, split string, provenance string, annotation_status string, annotation_notes string, source_sha256 string, case_hash string, "
    "source_length_stratum string, expected_chunk_count int, expected_route string"
)
SOURCES = "source_id string, url string, content string, provenance string, content_hash string, available boolean"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; blank lines are skipped and a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_line_problems(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line_no, problem) of lines that ``json_lines`` would fail on, with 1-based line numbers. Files are read whole, to number their lines."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    parsed = F.from_json("line", f"{schema}, __corrupt string", {"columnNameOfCorruptRecord": "__corrupt", "mode": "PERMISSIVE"})
    bad = whole.where(F.trim("line") != "").withColumn("p", parsed).where(F.col("p").isNull() | F.col("p.__corrupt").isNotNull())
    return bad.select("path", (F.col("pos") + 1).alias("line_no"), F.lit("malformed").alias("problem"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def reference_files(spark: SparkSession, path: str, suffixes: list[str], most_bytes: int = 5 << 20, expected: DataFrame | None = None) -> DataFrame:
    """(path, length, sha256, text, problem): files read as bytes; ``problem`` names the first broken rule.

    ``expected`` (name, sha256) holds the digests that files of these names must have. Empty files are
    not listed, as Spark's readers pass them over.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    right = F.greatest(*(F.lower("path").endswith(s) for s in suffixes), F.lit(False))
    problem = F.when(~right, "suffix").when(F.col("length") > most_bytes, "too_large").when(text.isNull(), "not_utf8")
    found = raw.select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))
    if expected is None:
        return found
    wanted = expected.select(F.col("name").alias("__name"), F.col("sha256").alias("__sha256"))
    named = found.withColumn("__name", F.element_at(F.split("path", "/"), -1)).join(wanted, "__name", "left")
    named = named.withColumn("problem", F.coalesce("problem", F.when(F.col("__sha256") != F.col("sha256"), "sha256")))
    return named.withColumn("text", F.when(F.col("problem").isNull(), F.col("text"))).select(*found.columns)


def preflight(found: DataFrame) -> DataFrame:
    """Checked files with ``safe_id`` and ``problem`` extended by duplicate (the same bytes twice) and collision (two files, one id)."""
    rows = found.withColumn("safe_id", safe_id(F.col("path")))
    same = rows.groupBy("sha256").agg(F.min("path").alias("__first"))
    ids = rows.groupBy("safe_id").agg(F.count(F.lit(1)).alias("__n"))
    joined = rows.join(same, "sha256").join(ids, "safe_id")
    problem = F.coalesce("problem", F.when(F.col("path") != F.col("__first"), "duplicate").when(F.col("__n") > 1, "collision"))
    return joined.withColumn("problem", problem).select(*found.columns, "safe_id")


def fixture_violations(sources: DataFrame) -> DataFrame:
    """(source_id, violation): contents that do not have their hash, and ids that occur twice."""
    wrong = sources.where(F.sha2("content", 256) != F.col("content_hash")).select("source_id", F.lit("hash_mismatch").alias("violation"))
    twice = sources.groupBy("source_id").count().where("count > 1").select("source_id", F.lit("duplicate_id").alias("violation"))
    return wrong.unionByName(twice)


def dataset_violations(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, violation): duplicate ids and claims, unknown sources, gold spans that are not in their source."""
    normal = F.regexp_replace(F.lower(F.trim("claim_text")), r"\s+", " ")
    ids = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate_id").alias("violation"))
    claims = cases.withColumn("k", normal).groupBy("k", "source_id").agg(F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", F.lit("duplicate_claim").alias("violation"))
    unknown = cases.join(sources, "source_id", "left_anti").select("case_id", F.lit("unknown_source").alias("violation"))
    spans = cases.where("gold_evidence_span is not null").join(sources, "source_id").where(F.instr("content", F.col("gold_evidence_span")) == 0).select("case_id", F.lit("span_not_in_source").alias("violation"))
    return ids.unionByName(claims).unionByName(unknown).unionByName(spans)


def cached(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached payload, rows still to compute)."""
    return wanted.join(cache, key), wanted.join(cache, key, "left_anti")


def upserted(cache: DataFrame, fresh: DataFrame, key: str = "cache_key") -> DataFrame:
    """The cache after an upsert: fresh rows replace those of their key."""
    return cache.join(fresh, key, "left_anti").unionByName(fresh)


def cache_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def bundle_hash(files: DataFrame, scope: str, order: str, digest: str, path: str) -> DataFrame:
    """SHA-256 over the rows ``<digest>  <path>`` in declared order, per scope."""
    from attestra.operators.datasets import ordered_digest

    return ordered_digest(files, scope, [order], F.concat(digest, F.lit("  "), path, F.lit("\n")), "bundle_sha256")


def config(path: str, defaults: dict) -> dict:
    """Defaults under the values of a TOML file; a missing file of the default name gives the defaults."""
    if not Path(path).exists():
        return dict(defaults)
    found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := set(found) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return {k: {**v, **found.get(k, {})} if isinstance(v, dict) else found.get(k, v) for k, v in defaults.items()}


def safe_id(path: Column) -> Column:
    """A readable id: slug of the name and the start of the path's digest."""
    return F.concat(slug(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")), F.lit("-"), F.left(F.sha2(path, 256), F.lit(8)))


def write_json_once(df: DataFrame, path: str) -> None:
    """JSON lines; an existing target is an error."""
    df.write.mode("errorifexists").json(path)


LEVELS = {"error": "error", "warning": "warning", "notice": "note"}


def sarif_results(verdicts: DataFrame) -> DataFrame:
    """(file, rule_id, level, fingerprint, result): one JSON result per finding with a severity.

    The report's order is file, line_start, line_end, rule_id, fingerprint. Needs file, line_start, line_end, claim_text, relation, severity. The fingerprint is the SHA-256 of
    file, line, claim and relation, parted by NUL.
    """
    level = F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("severity"))
    mark = F.sha2(F.concat_ws("\u0000", "file", F.col("line_start").cast("string"), "claim_text", "relation"), 256)
    base = verdicts.where(F.col("severity").isin(*LEVELS)).withColumns({"level": level, "fingerprint": mark, "rule_id": F.concat(F.lit("claim/"), "relation")})
    region = F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"))
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.to_json(F.struct(F.col("rule_id").alias("ruleId"), F.col("level"), F.struct(F.col("claim_text").alias("text")).alias("message"), place.alias("locations"), F.create_map(F.lit("claim/v1"), F.col("fingerprint")).alias("partialFingerprints")))
    return base.withColumn("result", result).select("file", "line_start", "line_end", "rule_id", "level", "fingerprint", "result")


def report_rows(verdicts: DataFrame) -> DataFrame:
    """Lines of a Markdown table, one a claim, with their sort keys."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), r"\s+", " ")
    return verdicts.select("file", "line_start", F.format_string("| %s:%d | %s | %s | %s |", "file", "line_start", cell("severity"), cell("relation"), cell("claim_text")).alias("line"))


def rollup_status(statuses: DataFrame, scope: str, status: str = "status") -> DataFrame:
    """fatal if all failed, complete if none did, else partial."""
    failed = F.col(status) == "failed"
    return statuses.groupBy(scope).agg(F.when(F.bool_and(failed), "fatal").when(F.bool_or(failed), "partial").otherwise("complete").alias("rollup"))
