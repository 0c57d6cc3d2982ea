"""Hashes, validation and building of datasets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.operators import spans


def canonical_json(value: Column, optional: list[str] | None = None) -> Column:
    """A struct as JSON with sorted names, no spaces and ASCII escapes; ``optional`` names are left out where they are null."""
    drop = set(optional or [])

    @F.pandas_udf("string")
    def dump(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else json.dumps({k: v for k, v in json.loads(x).items() if v is not None or k not in drop}, sort_keys=True, separators=(",", ":")))

    return dump(F.to_json(value, {"ignoreNullFields": "false"}))


def ordered_digest(rows: DataFrame, scope: str, order: list[str], line: Column, name: str, head: str = "", between: str = "", tail: str = "") -> DataFrame:
    """(scope, name): SHA-256 over the lines of each scope in order.

    A digest is sequential, so a scope's lines go through one task, sorted, in a stream: none is collected.
    """
    dealt = rows.select(scope, *order, line.alias("__line")).repartition(scope).sortWithinPartitions(scope, *order).select(scope, "__line")
    kind = rows.schema[scope].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None

        def out() -> pa.RecordBatch:
            digest.update(tail.encode())
            return pa.RecordBatch.from_arrays([last, pa.array([digest.hexdigest()])], names=[scope, name])

        for batch in batches:
            keys = batch.column(0)
            for k, text in enumerate(batch.column(1).to_pylist()):
                key = keys.slice(k, 1)
                if digest is None or not key.equals(last):
                    if digest is not None:
                        yield out()
                    last, digest, first = key, hashlib.sha256(head.encode()), True
                digest.update(((text or "") if first else between + (text or "")).encode())
                first = False
        if digest is not None:
            yield out()

    return dealt.mapInArrow(run, f"{scope} {kind.simpleString()}, {name} string")


def split_hash(cases: DataFrame, split: str = "split") -> DataFrame:
    """(split, split_sha256): the digest of the canonical JSON list of (case_hash, case_id, split) by case_id."""
    line = canonical_json(F.struct("case_hash", "case_id", split))
    return ordered_digest(cases, split, ["case_id"], line, "split_sha256", "[", ",", "]")


def line_at(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def document_violations(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """(document_id, claim, violation): contents without their hash, claims that are no slice of their document, wrong lines, wrong claim counts.

    Documents: document_id, content, content_sha256, gold_claim_count; claims: document_id, claim, text, offset_start, offset_end, line_start, line_end.
    """
    wrong = documents.where(F.sha2("content", 256) != F.col("content_sha256")).select("document_id", F.lit(None).cast("bigint").alias("claim"), F.lit("content_hash").alias("violation"))
    each = claims.join(documents.select("document_id", "content"), "document_id")
    piece = F.substring("content", F.col("offset_start") + 1, F.col("offset_end") - F.col("offset_start"))
    tests = [
        (piece != F.col("text"), "not_a_slice"), (line_at(F.col("content"), F.col("offset_start")) != F.col("line_start"), "line_start"),
        (line_at(F.col("content"), F.greatest(F.col("offset_start"), F.col("offset_end") - 1)) != F.col("line_end"), "line_end"),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests)))
    broken = each.select("document_id", "claim", F.explode(found).alias("violation"))
    counts = claims.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    miscounted = documents.join(counts, "document_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("gold_claim_count")).select("document_id", F.lit(None).cast("bigint").alias("claim"), F.lit("claim_count").alias("violation"))
    return wrong.unionByName(broken).unionByName(miscounted)


def corpus_violations(claims: DataFrame, corpus: DataFrame, most: int = 3) -> DataFrame:
    """(claim_id, violation): repeated ids, cited documents that the corpus lacks, sentences out of bounds, too many or repeated documents.

    Claims: claim_id, doc_ids (array), evidence (array of (doc_id, sentence)); corpus: doc_id, n_sentences.
    """
    twice = claims.groupBy("claim_id").count().where("count > 1").select("claim_id", F.lit("duplicate_id").alias("violation"))
    unknown = claims.select("claim_id", F.explode("doc_ids").alias("doc_id")).join(corpus, "doc_id", "left_anti").select("claim_id", F.lit("unknown_document").alias("violation"))
    outside = claims.select("claim_id", F.inline("evidence")).join(corpus, "doc_id").where((F.col("sentence") < 0) | (F.col("sentence") >= F.col("n_sentences"))).select("claim_id", F.lit("sentence_out_of_bounds").alias("violation"))
    listed = claims.where((F.size("doc_ids") > most) | (F.size(F.array_distinct("doc_ids")) < F.size("doc_ids"))).select("claim_id", F.lit("document_list").alias("violation"))
    return twice.unionByName(unknown).unionByName(outside).unionByName(listed)


def collisions(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, value) that two corpora share: ids, digests of texts, digests of normalised texts."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    views = {"id": F.col(key).cast("string"), "text": F.sha2(text, 256), "normalized": F.sha2(plain, 256)}
    long = lambda frame: frame.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in views.items()))).alias("x")).select("x.*").distinct()
    return long(left).join(long(right), ["kind", "value"], "left_semi")


def sentence_groups(sentences: DataFrame, scope: str, number: str = "sentence", text: str = "text") -> DataFrame:
    """(scope, first, last, group_text, sentence_offsets): runs of consecutive sentences joined by line ends, with each sentence's place inside.

    A run is a part of one document.
    """
    run = F.col(number) - F.row_number().over(Window.partitionBy(scope).orderBy(number))
    parts = sentences.withColumn("__run", run)
    before = Window.partitionBy(scope, "__run").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct(F.col(number).alias("sentence"), F.col("start").alias("char_start"), (F.col("start") + F.length(text)).alias("char_end"), F.col(text).alias("text"))))
    grouped = placed.groupBy(scope, "__run").agg(F.min(number).alias("first"), F.max(number).alias("last"), listed.alias("l"))
    return grouped.select(scope, "first", "last", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("group_text"), F.transform("l", lambda x: F.struct(x["sentence"].alias("sentence"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"))).alias("sentence_offsets"))


def cited_sentences(group_text: Column, offsets: Column, span: Column) -> Column:
    """(status, sentences): the sentences that a cited text covers with visible characters; ambiguous if its occurrences cover different ones."""

    @F.arrow_udf("status string, sentences array<bigint>")
    def find(texts: pa.Array, places: pa.Array, cited: pa.Array) -> pa.Array:
        out = []
        for text, given, piece in zip(texts.to_pylist(), places.to_pylist(), cited.to_pylist(), strict=True):
            found: set[tuple[int, ...]] = set()
            at = text.find(piece) if text and piece else -1
            while at >= 0:
                end = at + len(piece)
                if over := tuple(x["sentence"] for x in given if text[max(at, x["char_start"]) : min(end, x["char_end"])].strip()):
                    found.add(over)
                at = text.find(piece, at + 1)
            status = "mapped" if len(found) == 1 else "ambiguous" if found else "out_of_scope"
            out.append({"status": status, "sentences": list(*found) if len(found) == 1 else None})
        return pa.array(out, pa.struct([("status", pa.string()), ("sentences", pa.list_(pa.int64()))]))

    return find(group_text, offsets, span)


def evidence_pack(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """(claim_id, doc_rank, doc_id, content, spans, content_sha256): cited documents as text, a line a sentence, with each sentence's span.

    Claims: claim_id, doc_ids; corpus: doc_id, sentences (array).
    """
    text = F.array_join("sentences", "\n")
    step = lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.array_append(s["spans"], F.struct(s["at"].alias("char_start"), (s["at"] + F.length(x)).alias("char_end"))).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char_start:int,char_end:int>>").alias("spans"))
    rendered = corpus.select("doc_id", text.alias("content"), F.aggregate("sentences", start, step)["spans"].alias("spans"), F.sha2(text, 256).alias("content_sha256"))
    return claims.select("claim_id", F.posexplode("doc_ids").alias("doc_rank", "doc_id")).join(rendered, "doc_id")


def synthetic_claims(spark: SparkSession, count: int, templates: list[str], strata: list[str]) -> DataFrame:
    """(claim_id, template, stratum, text): numbered claims from templates with {n}, every template in every stratum in turn."""
    rows = spark.range(count).select(F.col("id").alias("claim_id"), (F.col("id") % len(templates)).cast("int").alias("template"), F.get(F.array(*map(F.lit, strata)), F.floor(F.col("id") / len(templates)).cast("int") % len(strata)).alias("stratum"))
    return rows.withColumn("text", F.replace(F.get(F.array(*map(F.lit, templates)), F.col("template")), F.lit("{n}"), F.col("claim_id").cast("string")))


def strict_json(text: Column, required: list[str], allowed: list[str]) -> Column:
    """Why a JSON object is refused: malformed, duplicate_key, not_finite, not_an_object, unknown_field, missing_field; null for a good one."""

    class Twice(ValueError):
        pass

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise Twice
        return dict(pairs)

    def refuse(_: str):
        raise OverflowError

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        def reason(x: str | None) -> str | None:
            try:
                found = json.loads(x or "", object_pairs_hook=once, parse_constant=refuse)
            except Twice:
                return "duplicate_key"
            except OverflowError:
                return "not_finite"
            except ValueError:
                return "malformed"
            if not isinstance(found, dict):
                return "not_an_object"
            return "unknown_field" if set(found) - set(allowed) else "missing_field" if set(required) - set(found) else None

        return texts.map(reason)

    return check(text)


def budget_guard(calls: DataFrame, scope: str, order: str, most_calls: int, most_tokens: int) -> DataFrame:
    """Calls with ``allowed``: whether it and all before it stay within the number of calls and the reported tokens; unknown tokens end the budget."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = (F.count(F.lit(1)).over(w) <= most_calls) & (F.coalesce(F.sum("tokens").over(w), F.lit(0)) <= most_tokens) & (F.count("tokens").over(w) == F.count(F.lit(1)).over(w))
    return calls.withColumn("allowed", within)


def bind_claims(claims: DataFrame, cites: DataFrame) -> DataFrame:
    """Claims with the ids of their citations: those between a claim's end and the next claim's start, else the paragraph's only one.

    Claims: paragraph, claim, start, end, paragraph_end; citations: paragraph, citation, at.
    """
    w = Window.partitionBy("paragraph").orderBy("start")
    ranged = claims.withColumn("until", F.coalesce(F.lead("start").over(w), F.col("paragraph_end") + 1))
    inside = spans.overlapping(ranged.select("paragraph", "claim", F.col("end").alias("l_start"), F.col("until").alias("l_end")), cites.select("paragraph", "citation", F.col("at").alias("r_start"), (F.col("at") + 1).alias("r_end")), "paragraph", 4096)
    own = inside.groupBy("paragraph", "claim").agg(F.array_sort(F.collect_list(F.struct("r_start", "citation"))).alias("own"))
    only = cites.groupBy("paragraph").agg(F.count(F.lit(1)).alias("n"), F.min("citation").alias("only"))
    joined = ranged.join(own, ["paragraph", "claim"], "left").join(only, "paragraph", "left")
    found = F.when(F.col("own").isNotNull(), F.transform("own", lambda x: x["citation"])).when(F.col("n") == 1, F.array("only")).otherwise(F.array().cast(f"array<{cites.schema['citation'].dataType.simpleString()}>"))
    return joined.select("paragraph", "claim", found.alias("citations"))
