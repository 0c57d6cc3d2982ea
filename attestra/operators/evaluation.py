"""Evaluation of runs, selections, evidence and documents, with resampling and gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.numbers import ratio
from attestra.operators import metrics, spans


def run_resources(results: DataFrame, by: list[str]) -> DataFrame:
    """Calls, usage status, tokens (null unless every call reported them), median and 95th percentile of all call latencies.

    Needs model_calls, usage_status, input_tokens, output_tokens, latencies (array).
    """
    complete = F.bool_and((F.col("model_calls") == 0) | F.coalesce(F.col("usage_status") == "reported", F.lit(False)))
    tokens = lambda c: F.when(complete, F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0))).alias(c)
    plain = results.groupBy(*by).agg(F.sum("model_calls").alias("calls"), F.when(complete, "reported").otherwise("incomplete").alias("usage_status"), tokens("input_tokens"), tokens("output_tokens"))
    each = results.select(*by, F.explode("latencies").alias("latency"))
    middle = metrics.linear_percentiles(each, "latency", {"latency_p50": 0.5}, by)
    return plain.join(middle, by, "left").join(metrics.floor_percentiles(each, "latency", {"latency_p95": 0.95}, by), by, "left")


def configuration(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """The value of each field over rows with model calls, null unless it is the only one; ``consistent`` if no field has several."""
    called = F.col("model_calls") > 0
    n = {c: F.count_distinct(F.when(called, F.col(c))) for c in fields}
    only = [F.when(n[c] == 1, F.max(F.when(called, F.col(c)))).alias(c) for c in fields]
    return rows.groupBy(*by).agg(*only, F.greatest(*(n[c] for c in fields), F.lit(0)).__le__(1).alias("consistent"))


def align_claims(gold: DataFrame, predicted: DataFrame, scope: str) -> DataFrame:
    """(scope, g, p, score, exact): claims matched one to one, equal text and offsets first, then by token F1, distance of lines, place.

    Needs g or p (places in the document), text, offset_start, offset_end, line_start.
    """
    names = ["text", "offset_start", "offset_end"]
    number = lambda frame, place: frame.withColumn("__turn", F.row_number().over(Window.partitionBy(scope, *names).orderBy(place)))
    same = number(gold, "g").join(number(predicted, "p").select(scope, *names, "__turn", "p"), [scope, *names, "__turn"]).select(scope, "g", "p", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    left = gold.join(same, [scope, "g"], "left_anti").select(scope, "g", F.col("line_start").alias("gl"), T.token_set(F.col("text")).alias("gw"))
    right = predicted.join(same, [scope, "p"], "left_anti").select(scope, "p", F.col("line_start").alias("pl"), T.token_set(F.col("text")).alias("pw"))
    scored = left.join(right, scope).select(scope, "g", "p", F.abs(F.col("gl") - F.col("pl")).alias("far"), T.set_f1(F.col("pw"), F.col("gw")).alias("score")).where("score > 0")
    # greedy by (score, lines apart, places): the rank in that order stands for it
    ordered = scored.withColumn("turn", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), "far", "g", "p")))
    near = spans.greedy_match(ordered.withColumn("weight", 1.0 / F.col("turn")), scope, "g", "p", "weight")
    return same.unionByName(near.join(scored, [scope, "g", "p"]).select(scope, "g", "p", "score", F.lit(False).alias("exact")))


def document_metrics(gold: DataFrame, predicted: DataFrame, scope: str, by: list[str]) -> DataFrame:
    """Extraction, binding, evidence and end-to-end figures of claims in whole documents, per group of ``by``.

    Beyond what ``align_claims`` needs: line_end, urls, relation, and evidence (gold: the span, may be null;
    predicted: its first span). A missing claim counts as wrong everywhere.
    """
    pairs = align_claims(gold, predicted, scope)
    p = predicted.select(scope, "p", *(F.col(c).alias(f"p_{c}") for c in ("line_start", "line_end", "urls", "relation", "evidence")))
    rows = gold.join(pairs, [scope, "g"], "left").join(p, [scope, "p"], "left")
    hit = F.col("p").isNotNull()
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    evidence = F.when(F.col("evidence") != "", F.when(hit, T.token_f1(F.col("p_evidence"), F.col("evidence"))).otherwise(0.0))
    matched = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_gold"), count(F.col("exact")).alias("n_exact"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("relaxed"), count(hit & F.col("p_urls").eqNullSafe(F.col("urls"))).alias("n_cited"),
        count((F.col("p_line_start") == F.col("line_start")) & (F.col("p_line_end") == F.col("line_end"))).alias("n_located"), count(F.col("exact") & (F.col("p_relation") == F.col("relation"))).alias("n_whole"),
        ratio(F.sum(evidence), F.count(evidence)).alias("evidence_span_f1"),
    )
    doubled = spans.overlapping(predicted.select(scope, *[c for c in by if c != scope], "p", F.col("offset_start").alias("l_start"), F.col("offset_end").alias("l_end")), gold.select(scope, F.col("offset_start").alias("r_start"), F.col("offset_end").alias("r_end")), scope, 1024)
    doubled = doubled.groupBy(*{*by, scope}, "p").count().where("count > 1").groupBy(*by).agg(F.count(F.lit(1)).alias("n_doubled"))
    whole = matched.join(predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("n_predicted")), by, "left").join(doubled, by, "left").na.fill(0, ["n_predicted", "n_doubled"])
    ratios = {"exact": ("n_exact", "n_exact"), "relaxed": ("relaxed", "relaxed"), "end_to_end": ("n_whole", "n_whole")}
    out = whole.withColumns({f"{k}_precision": ratio(F.col(a), F.col("n_predicted")) for k, (a, _) in ratios.items()} | {f"{k}_recall": ratio(F.col(b), F.col("n_gold")) for k, (_, b) in ratios.items()})
    out = out.withColumns({f"{k}_f1": ratio(2 * F.col(f"{k}_precision") * F.col(f"{k}_recall"), F.col(f"{k}_precision") + F.col(f"{k}_recall")) for k in ratios})
    out = out.withColumns({"atomicity_violation_rate": ratio(F.col("n_doubled"), F.col("n_predicted")), "citation_binding_accuracy": ratio(F.col("n_cited"), F.col("n_gold")), "line_locator_accuracy": ratio(F.col("n_located"), F.col("n_gold"))})
    return out.select(*by, *(f"{k}_{x}" for k in ratios for x in ("precision", "recall", "f1")), "atomicity_violation_rate", "citation_binding_accuracy", "line_locator_accuracy", "evidence_span_f1")


def compare_runs(runs: DataFrame, run: str, first: str, second: str, by: list[str], names: list[str]) -> DataFrame:
    """``<name>_delta`` = second minus first for each metric; null where either is."""
    side = lambda which, prefix: runs.where(F.col(run) == which).select(*by, *(F.col(c).alias(f"{prefix}{c}") for c in names))
    both = side(first, "__a_").join(side(second, "__b_"), by)
    return both.select(*by, *((F.col(f"__b_{c}") - F.col(f"__a_{c}")).alias(f"{c}_delta") for c in names))


def best_rationale(predicted: Column, rationales: Column) -> Column:
    """The best set F1 of predicted sentence keys against any rationale, and its index (the first of equals)."""
    scored = F.transform(rationales, lambda r, i: F.struct(T.set_f1(predicted, r).alias("f1"), (-i).alias("place")))
    return T.let(F.array_max(scored), lambda best: F.struct(best["f1"].alias("f1"), (-best["place"]).alias("index")))


def complete(predicted: Column, rationales: Column) -> Column:
    """Whether the predicted keys hold all of any rationale."""
    return F.exists(rationales, lambda r: F.size(F.array_except(r, predicted)) == 0)


def evidence_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sentence-set F1, complete-rationale coverage and joint score over cases with rationales; abstention over the others.

    Needs predicted (array of keys), rationales (array of arrays, empty without evidence), gold, label.
    """
    eligible, n = F.size("rationales") > 0, F.count(F.lit(1))
    done = complete(F.col("predicted"), F.col("rationales"))
    base = rows.withColumns({"__eligible": eligible, "__f1": best_rationale(F.col("predicted"), F.col("rationales"))["f1"], "__done": done, "__empty": F.size("predicted") == 0})
    e = F.col("__eligible")
    return base.groupBy(*by).agg(
        n.alias("n"), F.count_if(e).alias("n_eligible"), ratio(F.sum(F.when(e, F.col("__f1"))), F.count_if(e)).alias("sentence_f1"), ratio(F.count_if(e & F.col("__done")), F.count_if(e)).alias("complete_coverage"),
        ratio(F.count_if(e & F.col("__done") & (F.col("gold") == F.col("label"))), F.count_if(e)).alias("joint"), ratio(F.count_if(~e & F.col("__empty")), F.count_if(~e)).alias("empty_rate"),
    )


def hit_metrics(rows: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Hit rates at k and MRR of ranked lists of sentence keys against the union of the rationales; cases without rationales are left out."""
    gold = F.array_distinct(F.flatten("rationales"))
    first = F.array_min(F.filter(F.transform("ranked", lambda keys, i: F.when(F.arrays_overlap(keys, gold), i + 1)), lambda x: x.isNotNull()))
    base = rows.where(F.size("rationales") > 0).withColumn("__first", first)
    hits = [ratio(F.count_if(F.coalesce(F.col("__first") <= k, F.lit(False))), F.count(F.lit(1))).alias(f"hit_at_{k}") for k in ks]
    return base.groupBy(*by).agg(*hits, F.avg(F.coalesce(1 / F.col("__first"), F.lit(0.0))).alias("mrr"))


def three_way(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Accuracy, macro F1 over the fixed labels and the share of predictions outside them."""
    each = metrics.per_label(rows, by=by, names=names).groupBy(*by).agg((F.sum("f1") / len(names)).alias("macro_f1"))
    off = ~F.col("predicted").isin(names)
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"), ratio(F.count_if(off), F.count(F.lit(1))).alias("off_taxonomy_rate"))
    return plain.join(each, by) if by else plain.crossJoin(each)  # one row each


def majority(rows: DataFrame, label: str, by: list[str], names: list[str]) -> DataFrame:
    """(by, majority): the most frequent label, the earlier in ``names`` of equals."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(label))
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by(label, F.struct("n", -place)).alias("majority"))


def over_majority(rows: DataFrame, names: list[str], by: list[str], least_recall: float = 0.6, least_gain: float = 0.05) -> DataFrame:
    """Macro F1 of predictions and of the majority label, the gain, and whether every recall and the gain reach their floors."""
    own = metrics.per_label(rows, by=by, names=names).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.min("recall").alias("least_recall"))
    base = rows.join(majority(rows, "gold", by, names), by).withColumn("predicted", F.col("majority"))
    plain = metrics.per_label(base, by=by, names=names).groupBy(*by).agg(F.avg("f1").alias("majority_f1"))
    joined = own.join(plain, by).withColumn("gain", F.col("macro_f1") - F.col("majority_f1"))
    return joined.withColumn("status", F.when((F.col("least_recall") >= least_recall) & (F.col("gain") >= least_gain), "go").otherwise("no_go"))


def arm_efficiency(calls: DataFrame, arm: str) -> DataFrame:
    """Calls, token sums (null if any call lacks them), nearest-rank latencies and failure rate of each arm."""
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)
    plain = calls.groupBy(arm).agg(F.count(F.lit(1)).alias("n_calls"), whole("input_tokens"), whole("output_tokens"), ratio(F.count_if("failed"), F.count(F.lit(1))).alias("failure_rate"))
    return plain.join(metrics.nearest_rank_percentiles(calls, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95}, [arm]), arm, "left")


def binned(rows: DataFrame, value: Column, edges: list[int], by: list[str]) -> DataFrame:
    """(by, bin, n, n_correct, accuracy): counts in fixed bins; a bin is named by its lower edge, the one below the first edge by ``<``."""
    bin_ = F.lit(f"<{edges[0]}")
    for edge in edges:
        bin_ = F.when(value >= edge, F.lit(f">={edge}")).otherwise(bin_)
    hit = F.col("gold") == F.col("predicted")
    return rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_correct"), F.avg(hit.cast("double")).alias("accuracy"))


def poisson_steps() -> list[float]:
    """Where a uniform 32-bit number passes from one Poisson(1) count to the next, as far as 32 bits tell them apart."""
    steps, term, upto, k = [], math.exp(-1), 0.0, 0
    while upto + term < 1 - 2.0**-33:
        upto += term
        steps.append(upto)
        k += 1
        term /= k
    return steps


def weight(draw: Column, unit: Column, seed: int) -> Column:
    """How often a unit is in a resample: Poisson(1), from a SHA-256 of (draw, unit, seed)."""
    mark = F.substring(F.sha2(F.concat_ws(":", draw.cast("string"), unit.cast("string"), F.lit(str(seed))), 256), 1, 8)
    u = (F.conv(mark, 16, 10).cast("double") + 0.5) / 2.0**32
    return T.let(u, lambda x: F.aggregate(F.array(*map(F.lit, poisson_steps())), F.lit(0), lambda n, s: n + (x > s).cast("int")))


def bootstrap_interval(rows: DataFrame, unit: str, deltas: dict[str, Column], draws: int, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(metric, mean, low, high): the mean of paired differences and its percentile interval over resampled units.

    A unit is a row, or a cluster of rows (a connected component): its sums are made first, and each
    resample is a weighted sum of them, so no row is collected. Null differences are left out.
    """
    each = rows.groupBy(unit).agg(*(x for k, d in deltas.items() for x in (F.sum(d).alias(f"{k}__s"), F.count(d).alias(f"{k}__n"))))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"{k}__s").alias("s"), F.col(f"{k}__n").alias("n")) for k in deltas))).alias("m")
    each = each.select(unit, long).select(unit, "m.*")
    seen = each.groupBy("metric").agg(ratio(F.sum("s"), F.sum("n")).alias("mean"))
    drawn = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", weight(F.col("draw"), F.col(unit), seed))
    means = drawn.groupBy("metric", "draw").agg(ratio(F.sum(F.col("w") * F.coalesce("s", F.lit(0.0))), F.sum(F.col("w") * F.col("n"))).alias("mean"))
    tail = (1 - level) / 2
    return seen.join(metrics.linear_percentiles(means, "mean", {"low": tail, "high": 1 - tail}, ["metric"]), "metric")


def mining_rollup(windows: DataFrame, scope: str) -> DataFrame:
    """A paragraph's status from its windows: complete, partial or needs_human, with reasons in order of appearance and coverage sums.

    Needs ordinal, status, n_accepted, failure_codes (array), total, covered.
    """
    codes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "failure_codes"))), lambda x: x["failure_codes"]))
    each = windows.groupBy(scope).agg(F.array_distinct(codes).alias("codes"), F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("status") == "complete").alias("n_complete"), F.sum("n_accepted").alias("n_accepted"))
    reasons = F.when((F.size("codes") == 0) & (F.col("covered") < F.col("total")), F.array(F.lit("coverage_incomplete"))).otherwise(F.col("codes"))
    each = each.withColumn("reason_codes", reasons)
    status = F.when((F.size("reason_codes") == 0) & (F.col("n_complete") == F.col("n_windows")), "complete").when(F.col("n_accepted") > 0, "partial").otherwise("needs_human")
    return each.select(scope, status.alias("status"), "n_windows", "n_complete", "n_accepted", "reason_codes", "total", "covered")


def bag_coverage(available: DataFrame, emitted: DataFrame, scope: str, key: str) -> DataFrame:
    """(scope, covered): for each key the lesser of how often it is available and emitted, summed."""
    a = available.groupBy(scope, key).agg(F.count(F.lit(1)).alias("a"))
    b = emitted.groupBy(scope, key).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, [scope, key], "left").groupBy(scope).agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("covered"))


def ladder(metrics_row: DataFrame, primary: str, steps: list[tuple[float, str]], otherwise: str, floors: dict[str, float] | None = None) -> DataFrame:
    """``status`` by the first threshold that the primary metric reaches; ``failed`` names the metrics under their floor, which give the last status."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(k) >= x, F.lit(False)), F.lit(k)) for k, x in sorted((floors or {}).items())))) if floors else F.array().cast("array<string>")
    status = F.lit(otherwise)
    for least, name in sorted(steps):
        status = F.when(F.col(primary) >= least, F.lit(name)).otherwise(status)
    return metrics_row.withColumn("failed", failed).withColumn("status", F.when(F.size("failed") > 0, F.lit(otherwise)).otherwise(status))


def accepted(deltas: DataFrame, least_gain: float, worst_fold: float) -> DataFrame:
    """Whether a selector is accepted: gains over all baselines with intervals over zero, and no fold worse than ``worst_fold``.

    Needs gain, low (the interval's lower end) and fold_deltas (array), one row per baseline and selector.
    """
    ok = (F.col("gain") >= least_gain) & (F.col("low") > 0) & F.forall("fold_deltas", lambda x: x >= worst_fold)
    return deltas.groupBy("selector").agg(F.bool_and(ok).alias("accepted"), F.count_if(~ok).alias("n_failed"))


def alternation(cases: DataFrame, order: str, names: tuple[str, str]) -> DataFrame:
    """Cases with ``first_branch``, which alternates by their place."""
    numbered = cases.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(order)) - 1)
    return numbered.withColumn("first_branch", F.when(F.col("place") % 2 == 0, names[0]).otherwise(names[1]))


def identity_violations(rows: DataFrame, case: str, payload: Column) -> DataFrame:
    """Cases whose systems were not given the same payload."""
    return rows.groupBy(case).agg(F.count_distinct(payload).alias("n_payloads")).where("n_payloads > 1")


def rederived(claimed: DataFrame, computed: DataFrame, by: list[str], names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(by, metric, claimed, computed) of the metrics that differ from their own rows by more than ``tolerance``, or that only one side has."""
    long = lambda frame, as_: frame.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(as_)) for c in names))).alias("m")).select(*by, "m.*")
    both = long(claimed, "claimed").join(long(computed, "computed"), [*by, "metric"], "full")
    return both.where(~F.coalesce(F.abs(F.col("claimed") - F.col("computed")) <= tolerance, F.col("claimed").isNull() & F.col("computed").isNull()))


def pooled(rows: DataFrame, arm: str) -> DataFrame:
    """Pooled precision, recall and F1 of each arm from counts of relevant, retrieved and correct."""
    each = rows.groupBy(arm).agg(*(F.sum(c).alias(c) for c in ("relevant", "retrieved", "correct")))
    each = each.withColumns({"precision": ratio(F.col("correct"), F.col("retrieved")), "recall": ratio(F.col("correct"), F.col("relevant"))})
    return each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
