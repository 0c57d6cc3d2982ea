"""URL allow and block lists by hashed host-suffix and path-prefix expressions.

A URL is expanded into every pair of a host suffix and a path prefix that a rule could have; each
pair's SHA-256 digest is looked up by its first 32 bits, then confirmed by the full digest. Of the
rules that fit, the longest wins. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import field

#: Rules up to this many are broadcast (a rule takes some 200 bytes); more are joined by a shuffle.
BROADCAST_RULES = 50_000
RULES_SCHEMA = "verdict string, host string, path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as the table that ``judge`` takes."""
    return spark.createDataFrame(rules, RULES_SCHEMA)


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns that must not clash).

    A rule (verdict allow or block, host, path) fits its host and all subdomains of it where the
    URL's path starts with the rule's path. The longest rule wins (host and path together, then the
    host); of equal rules with both verdicts, block wins. Without a rule the verdict is ``default``
    and ``rule`` null. Null URLs and URLs without ``://`` have empty host and path and fit no rule.
    Rules with a null or empty host are left out, a null path counts as empty. Repeated rows stay.

    Equal (host, path) pairs are judged once, so a URL that many rows share is one row in the join.
    """
    if clash := {"host", "path", "rule", "verdict"} & {c.lower() for c in pages.columns}:
        raise ValueError(f"pages already have {sorted(clash)}")
    host, path = host_and_path(field(url_col).cast("string"))
    given = F.struct(*(field(c) for c in pages.columns)).alias("row")
    pages = pages.select(given, host.alias("host"), path.alias("path"))
    known = rules.select(F.lower("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host != ''")
    known = known.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block after allow
    known = known.withColumn("rule", F.concat("r_host", "r_path")).withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.left("digest", F.lit(8)))
    shapes = known.groupBy(F.size(F.split("r_host", "\\.")).alias("labels")).agg(F.collect_set(F.length("r_path")).alias("lengths")).collect()  # a row for each label count, its path lengths
    many = known.count()
    known = F.broadcast(known) if many <= BROADCAST_RULES else known

    urls = pages.where("host != ''").select("host", "path").distinct()
    whole = F.array(*(F.struct(F.lit(s.labels).alias("labels"), F.array(*(F.lit(x) for x in sorted(s.lengths))).alias("lengths")) for s in sorted(shapes))) if shapes else None
    count, size = F.size(F.split("host", "\\.")), F.length("path")

    def prefixes(s: Column) -> Column:
        suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"])
        return F.transform(F.filter(s["lengths"], lambda n: n <= size), lambda n: F.concat(suffix, F.substr(F.col("path"), F.lit(1), n)))

    terms = F.flatten(F.transform(F.filter(whole, lambda s: s["labels"] <= count), prefixes)) if shapes else F.array().cast("array<string>")
    terms = urls.select("host", "path", F.explode(terms).alias("term")).withColumn("t_digest", F.sha2("term", 256))
    fits = terms.join(known, (F.left("t_digest", F.lit(8)) == F.col("prefix")) & (F.col("t_digest") == F.col("digest")))
    order = F.struct(F.length("rule"), F.length("r_host"), F.col("r_verdict"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "r_verdict"), order).alias("best"))
    judged = pages.where("host != ''").join(best, ["host", "path"], "left").select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
    # without a host no rule can fit: these rows stay out of the join, where they would all share one key
    rest = pages.where("host = ''").select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(rest).select("row.*", "host", "path", "rule", "verdict")
