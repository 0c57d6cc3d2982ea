"""Predicates for fetched URLs and addresses, the fetch table, patches and evaluation artifacts."""

from __future__ import annotations

import ipaddress
import socket
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds of content that can be read.
MIME_TYPES = ["text/html", "text/plain", "application/xhtml+xml"]


def address_problem(host: str) -> str | None:
    """Why an address must not be fetched; null for public ones and for names. Legacy numeric spellings count as addresses."""
    bare = host.split("%", 1)[0].strip("[]")
    try:
        address = ipaddress.ip_address(bare)
    except ValueError:
        try:
            address = ipaddress.IPv4Address(socket.inet_aton(bare)) if ":" not in bare else None
        except OSError:
            address = None
    if address is None:
        return None
    address = getattr(address, "ipv4_mapped", None) or address
    open_ = address.is_global and not (address.is_private or address.is_loopback or address.is_link_local or address.is_reserved or address.is_multicast or address.is_unspecified)
    return None if open_ else "private_address"


def url_problem_of(url: str | None) -> str | None:
    """The first rule that a URL breaks: scheme, credentials, missing host, local name, private address, port."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname, parts.port
    except ValueError:
        return "malformed"
    if parts.scheme not in ("http", "https"):
        return "scheme"
    if parts.username or parts.password:
        return "credentials"
    if not host:
        return "no_host"
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return "local_name"
    return address_problem(host) or ("port" if port not in (None, 80, 443) else None)


@F.pandas_udf(StringType())
def url_problem(urls: pd.Series) -> pd.Series:
    return urls.map(url_problem_of)


def fetched(wanted: DataFrame, pages: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """Wanted URLs with the stored page and ``problem``: a rule that the URL breaks, not_fetched, mime_type or too_large; content only where there is none.

    ``pages``: url, mime_type, content.
    """
    joined = wanted.join(pages.select("url", "mime_type", "content"), "url", "left")
    problem = F.coalesce(url_problem("url"), F.when(F.col("content").isNull(), "not_fetched").when(~F.col("mime_type").isin(MIME_TYPES), "mime_type").when(F.octet_length("content") > most_bytes, "too_large"))
    return joined.withColumn("problem", problem).withColumn("content", F.when(F.col("problem").isNull(), F.col("content")))


def patches(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, path, patch) of stored patch files, for the diff parser; ids go by path."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return raw.select(F.xxhash64(F.col("_metadata.file_path")).alias("diff_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("patch"))


def write_eval_artifacts(results: DataFrame, metrics: DataFrame, manifest: dict[str, str], path: str) -> None:
    """Results and metrics as JSON lines and the run's manifest beside them; an existing run is an error."""
    results.write.mode("errorifexists").json(f"{path}/results")
    metrics.write.mode("errorifexists").json(f"{path}/metrics")
    rows = [(k, v) for k, v in sorted(manifest.items())]
    results.sparkSession.createDataFrame(rows, "name string, value string").write.mode("errorifexists").json(f"{path}/manifest")


def batch_manifest(items: DataFrame, scope: str) -> DataFrame:
    """(scope, status, n, n_failed, inputs_sha256): fatal if all failed, complete if none did, else partial, with a digest of the inputs' digests."""
    failed = F.col("status") == "failed"
    marks = F.hex(F.bit_xor(F.xxhash64("sha256")))
    return items.groupBy(scope).agg(F.when(F.bool_and(failed), "fatal").when(F.bool_or(failed), "partial").otherwise("complete").alias("rollup"), F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"), marks.alias("inputs_mark"))
