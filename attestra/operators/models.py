"""Lexical features, a linear score, grid sweeps and the seams where a model or a person answers.

A seam takes any function of a batch; the ones given here are deterministic and serve tests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators.retrieval import bm25, top_k


def word_grams(text: Column) -> Column:
    """Words of two characters or more and pairs of neighbours, in lower case."""
    words = T.matches(F.lower(text), r"[\p{L}\p{N}_]{2,}")
    pairs = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return T.let(words, lambda w: F.concat(w, pairs(w)))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded by a space on both sides."""
    cut = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array(w))
    words = F.transform(T.matches(F.lower(text), r"\S+"), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(words, lambda w: F.concat(*(cut(w, n) for n in range(low, high + 1)))))


def pair_cosines(pairs: DataFrame, key: str, left: str, right: str, fit: str, grams: Callable[[Column], Column], name: str) -> DataFrame:
    """``pairs`` (unique ``key``) with ``name``: the TF-IDF cosine of two texts, weights fitted only on texts of rows where ``fit`` holds.

    1 + ln(tf), ln((1 + n) / (1 + df)) + 1, unit length; grams that no fitted text has do not count.
    """
    sides = F.array(F.struct(F.lit("l").alias("side"), F.col(left).alias("t")), F.struct(F.lit("r").alias("side"), F.col(right).alias("t")))
    long = pairs.select(key, fit, F.inline(sides)).where("t is not null")
    terms = long.select(key, fit, "side", F.explode(grams(F.col("t"))).alias("term")).groupBy(key, fit, "side", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    n = long.where(F.col(fit)).agg(F.count(F.lit(1)).alias("n"))
    idf = terms.where(F.col(fit)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    weighted = terms.join(idf, "term").select(key, "side", "term", (F.col("tf") * F.col("idf")).alias("w"))
    both = weighted.groupBy(key, "term").agg(F.sum(F.when(F.col("side") == "l", F.col("w"))).alias("a"), F.sum(F.when(F.col("side") == "r", F.col("w"))).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    dot, norms = F.sum(zero(F.col("a")) * zero(F.col("b"))), F.sqrt(F.sum(zero(F.col("a") * F.col("a")))) * F.sqrt(F.sum(zero(F.col("b") * F.col("b"))))
    cosine = both.groupBy(key).agg(F.when(norms > 0, dot / norms).otherwise(0.0).alias(name))
    return pairs.join(cosine, key, "left").na.fill({name: 0.0})


# The weights of the linear lexical score.
LEXICAL_WEIGHTS = {
    "word_tfidf_cosine": 0.30, "char_tfidf_cosine": 0.20, "word_jaccard": 0.15, "claim_token_coverage": 0.10, "sentence_token_coverage": 0.05, "numeric_token_set_match": 0.05,
    "negation_presence_match": 0.05, "length_ratio": 0.04, "reciprocal_doc_rank": 0.04,
}
POSITION_WEIGHT = 0.02


def lexical_score() -> Column:
    """The fixed linear score of the feature columns; earlier sentences score more."""
    total = F.lit(POSITION_WEIGHT) * (1.0 - F.col("normalized_sentence_position"))
    for name, w in LEXICAL_WEIGHTS.items():
        total = total + F.lit(w) * F.col(name).cast("double")
    return total


def claim_weights(rows: DataFrame, claim: str, label: str) -> DataFrame:
    """Rows with ``weight``: every claim counts one, shared equally by its classes and by the rows of each."""
    per = Window.partitionBy(claim, label)
    classes = F.size(F.collect_set(label).over(Window.partitionBy(claim)))
    return rows.withColumn("weight", 1.0 / (classes * F.count(F.lit(1)).over(per)))


def weighted_scaler(rows: DataFrame, features: list[str], weight: str = "weight") -> dict[str, tuple[float, float]]:
    """Weighted mean and population deviation of each feature (a deviation of zero counts as one)."""
    w = F.col(weight)
    mean = {c: F.sum(w * F.col(c)) / F.sum(w) for c in features}
    first = rows.agg(*(mean[c].alias(c) for c in features)).first()  # one row
    spread = rows.agg(*(F.sqrt(F.sum(w * (F.col(c) - F.lit(first[c])) ** 2) / F.sum(w)).alias(c) for c in features)).first()
    return {c: (first[c], spread[c] or 1.0) for c in features}


def grid_sweep(scored: DataFrame, folds: str, grid: DataFrame, metric: Callable[[DataFrame, list[str]], DataFrame], floor: Column, order: list[Column]) -> DataFrame:
    """(fold, the grid's columns and the metrics of the best point): points under ``floor`` are out, the greatest ``order`` wins.

    ``scored`` rows meet every grid point (a few); ``metric`` aggregates by fold and point.
    """
    points = grid.columns
    each = metric(scored.crossJoin(F.broadcast(grid)), [folds, *points]).where(floor)
    whole = F.struct(*(F.col(c) for c in each.columns if c != folds))
    return each.groupBy(folds).agg(F.max_by(whole, F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))).alias("best")).select(folds, "best.*")


def swapped_average(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Mean probability of each label over a pair asked in both orders; the second order has its labels the other way round."""
    turned = lambda k: F.when(F.col("swapped"), F.col(names[len(names) - 1 - k])).otherwise(F.col(names[k]))
    return rows.groupBy(key).agg(*(F.avg(turned(k)).alias(name) for k, name in enumerate(names)), F.count(F.lit(1)).alias("n"))


def scorer(score_many: Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]], most_tokens: int = 512, batch: int = 32) -> Callable[[Column, Column], Column]:
    """A column function (premise, claim) to (entailment, neutral, contradiction, rejected): batched, never truncated; pairs over ``most_tokens`` words are rejected."""
    kind = pa.struct([("entailment", pa.float64()), ("neutral", pa.float64()), ("contradiction", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("entailment double, neutral double, contradiction double, rejected boolean")
    def run(premises: pa.Array, claims: pa.Array) -> pa.Array:
        pairs = list(zip(premises.to_pylist(), claims.to_pylist(), strict=True))
        fits = [k for k, (p, c) in enumerate(pairs) if p is not None and c is not None and len(p.split()) + len(c.split()) <= most_tokens]
        out: list[dict] = [{"rejected": True}] * len(pairs)
        for at in range(0, len(fits), batch):
            some = fits[at : at + batch]
            for k, (e, n, c) in zip(some, score_many([pairs[i] for i in some]), strict=True):
                out[k] = {"entailment": e, "neutral": n, "contradiction": c, "rejected": False}
        return pa.array(out, kind)

    return run


def overlap_scores(pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
    """A deterministic stand-in for a scorer: shared words for, negation against."""
    out = []
    for premise, claim in pairs:
        a, b = {*premise.lower().split()}, {*claim.lower().split()}
        share = len(a & b) / max(1, len(b))
        against = 0.8 * share if ("not" in a) != ("not" in b) else 0.0
        out.append((share - against, 1 - share, against))
    return out


def complete(client: Callable[[str, dict], str], required: list[str], retries: int = 1) -> Callable[[Column, Column], Column]:
    """A column function (task, payload JSON) to (answer, attempts, failed): a model's answer that has the required fields, asked again at most ``retries`` times."""
    kind = pa.struct([("answer", pa.string()), ("attempts", pa.int32()), ("failed", pa.bool_())])

    @F.arrow_udf("answer string, attempts int, failed boolean")
    def run(tasks: pa.Array, payloads: pa.Array) -> pa.Array:
        out = []
        for task, payload in zip(tasks.to_pylist(), payloads.to_pylist(), strict=True):
            row = {"answer": None, "attempts": 0, "failed": True}
            given = json.loads(payload or "{}")
            while row["failed"] and row["attempts"] <= retries:
                answer = client(task, given | ({"retry": row["attempts"]} if row["attempts"] else {}))
                row["attempts"] += 1
                try:
                    row["failed"] = not set(required) <= set(json.loads(answer))
                except (TypeError, ValueError):
                    continue
                row["answer"] = None if row["failed"] else answer
            out.append(row)
        return pa.array(out, kind)

    return run


def fake_client(task: str, payload: dict) -> str:
    """A deterministic stand-in for a model: a label from the payload's digest; tasks named flaky fail once."""
    if task == "flaky" and "retry" not in payload:
        return "not json"
    mark = hashlib.sha256(json.dumps({k: v for k, v in payload.items() if k != "retry"}, sort_keys=True).encode()).digest()[0]
    return json.dumps({"label": ["entailed", "contradicted", "not_in_source"][mark % 3], "confidence": round(mark / 255, 3)})


def evidence_lookup(claims: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(reference, claim_id, chunk_id, rank, score): the best chunks of each local reference for a claim; chunks without lexical score are no evidence."""
    queries = claims.select("source_id", F.col("claim_id").alias("query_id"), F.col("claim_text").alias("query_text"))
    found = bm25(queries, chunks).where("score > 1e-9")
    return top_k(found, k, ["source_id", "query_id"]).withColumnRenamed("query_id", "claim_id")


def resolved(options: DataFrame, decisions: DataFrame) -> DataFrame:
    """Options with ``chosen``: a person's recorded decision for the claim, null where there is none; a decision for an option that is not offered counts as none."""
    offered = decisions.join(options.select("claim_id", "option_id"), ["claim_id", "option_id"], "left_semi")
    return options.join(offered.select("claim_id", F.col("option_id").alias("picked")), "claim_id", "left").select(*options.columns, (F.col("option_id") == F.col("picked")).alias("chosen"))
