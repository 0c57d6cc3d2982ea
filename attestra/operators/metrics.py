"""Evaluation metrics as grouped aggregates. Frames are in long form, one row per case (and run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.numbers import poisoned_sum, ratio
from attestra.operators.verdicts import RELATIONS


def labels(frame: DataFrame, names: list[str] | None = None) -> DataFrame:
    return frame.sparkSession.createDataFrame([(x,) for x in names or RELATIONS], "label string")


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", names: list[str] | None = None) -> DataFrame:
    """(gold, predicted, n) for every pair of labels, zeros too; labels outside ``names`` stay."""
    grid = labels(rows, names).withColumnRenamed("label", "gold").crossJoin(labels(rows, names).withColumnRenamed("label", "predicted"))  # a few fixed labels
    found = rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(grid), ["gold", "predicted"], "full").select("gold", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _by_label(rows: DataFrame, gold: str, predicted: str, by: list[str], names: list[str], extra: dict[str, Column]) -> DataFrame:
    """(by, label, support, tp, n_predicted, extra counts): one pass over ``rows``.

    Rows are counted per pair of labels first, and only these few counts are spread over the labels.
    Every label has a row in every group; the extra counts stand in the group's row without a label.
    """
    cells = rows.groupBy(*by, F.col(gold).alias("__gold"), F.col(predicted).alias("__predicted")).agg(F.count(F.lit(1)).alias("__n"), *(c.alias(k) for k, c in extra.items()))
    zero, n = F.lit(0).cast("bigint"), F.col("__n")

    def row(label: Column, support: Column = zero, tp: Column = zero, n_predicted: Column = zero, keep: bool = False) -> Column:
        return F.struct(label.cast("string").alias("label"), support.alias("support"), tp.alias("tp"), n_predicted.alias("n_predicted"), *((F.col(k) if keep else zero).alias(k) for k in extra))

    hit = F.when(F.col("__gold") == F.col("__predicted"), n).otherwise(zero)
    spread = F.array(row(F.col("__gold"), n, hit), row(F.col("__predicted"), n_predicted=n), *(row(F.lit(x)) for x in names), *([row(F.lit(None), keep=True)] if extra else []))
    counts = ["support", "tp", "n_predicted", *extra]
    each = cells.select(*by, F.explode(spread).alias("f")).select(*by, "f.*").where(F.col("label").isin(names) | (F.col("label").isNull() & F.lit(bool(extra))))
    if not by:  # without groups every label has a row even where there are no rows
        none = labels(rows, [*names]).select("label", *(zero.alias(k) for k in counts))
        each = each.unionByName(none)
    whole = each.groupBy(*by, "label").agg(*(F.sum(k).alias(k) for k in counts))
    p, r = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("support"))
    return whole.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_label(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each label (per group of ``by``); 0.0 without a denominator."""
    return _by_label(rows, gold, predicted, by or [], names or RELATIONS, {}).select(*(by or []), "label", "precision", "recall", "f1", "support")


def summary(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", confidence: str = "confidence", by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Macro F1 over observed and over all labels, weighted F1, balanced accuracy, high-confidence errors and abstentions."""
    by, names = by or [], names or RELATIONS
    high = F.col(confidence) >= 0.8
    extra = {"n": F.count(F.lit(1)), "n_high": F.count_if(high), "n_high_wrong": F.count_if(high & (F.col(gold) != F.col(predicted))), "n_abstained": F.count_if(F.col(predicted).isin("not_in_source", "source_unavailable"))}
    each = _by_label(rows, gold, predicted, by, names, extra)
    whole, labelled = F.col("label").isNull(), F.col("label").isNotNull()
    seen = labelled & (F.col("support") > 0)
    of = lambda test, value: F.sum(F.when(test, value))
    n = of(whole, F.col("n"))
    return each.groupBy(*by).agg(
        F.coalesce(n, F.lit(0)).alias("n"), ratio(of(whole, F.col("n_high_wrong")), of(whole, F.col("n_high"))).alias("high_confidence_error_rate"), ratio(of(whole, F.col("n_abstained")), n).alias("abstention_rate"),
        ratio(of(seen, F.col("f1")), F.count_if(seen)).alias("observed_macro_f1"), (F.coalesce(of(labelled, F.col("f1")), F.lit(0.0)) / len(names)).alias("fixed_macro_f1"),
        ratio(of(labelled, F.col("f1") * F.col("support")), of(labelled, F.col("support"))).alias("weighted_f1"), ratio(of(seen, F.col("recall")), F.count_if(seen)).alias("balanced_accuracy"),
    )


def floor_percentiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """The element at index min(n-1, floor(n*q)) of each group, from counts per distinct value."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = counts.withColumns({"upto": upto, "total": total})
    at = lambda q: F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(q)))
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > at(q), F.col(value))).alias(name) for name, q in quantiles.items()))


def linear_percentiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Linear interpolation at (n-1)q between the elements of each group, from counts per distinct value."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy(*by).orderBy(value)), "total": F.sum("n").over(Window.partitionBy(*by))})
    at = lambda q: (F.col("total") - 1) * F.lit(q)
    ends = [x for name, q in quantiles.items() for x in (F.min(F.when(F.col("upto") > F.floor(at(q)), F.col(value))).alias(f"{name}__a"), F.min(F.when(F.col("upto") > F.ceil(at(q)), F.col(value))).alias(f"{name}__b"), F.max(at(q) - F.floor(at(q))).alias(f"{name}__f"))]
    line = lambda k: (F.col(f"{k}__a") + (F.col(f"{k}__b") - F.col(f"{k}__a")) * F.col(f"{k}__f")).alias(k)
    return ranked.groupBy(*by).agg(*ends).select(*by, *(line(k) for k in quantiles))


def nearest_rank_percentiles(rows: DataFrame, value: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """The element at rank ceil(n*q) of each group, from counts per distinct value."""
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value))
    ranked = counts.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(*by))})
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(q))), F.col(value))).alias(name) for name, q in quantiles.items()))


def retrieval(rows: DataFrame, retrieved: str = "retrieved", gold: str = "gold_span", k: int = 5, by: list[str] | None = None) -> DataFrame:
    """Recall at k, MRR by the first hit and evidence coverage (best token F1), over rows with a gold span."""
    top = F.slice(F.coalesce(F.col(retrieved), F.array().cast("array<string>")), 1, k)
    hit = lambda x: (F.instr(x, F.col(gold)) > 0) | (F.instr(F.col(gold), x) > 0)
    rank = F.array_min(F.filter(F.transform(top, lambda x, i: F.when(hit(x), i + 1)), lambda x: x.isNotNull()))
    best = F.coalesce(F.array_max(F.transform(top, lambda x: T.token_f1(x, F.col(gold)))), F.lit(0.0))
    base = rows.where(F.coalesce(F.col(gold), F.lit("")) != "").withColumns({"__rank": rank, "__best": best})
    n = F.count(F.lit(1))
    return base.groupBy(*(by or [])).agg(ratio(F.count_if(F.col("__rank").isNotNull()), n).alias("recall_at_k"), ratio(F.sum(F.coalesce(1 / F.col("__rank"), F.lit(0.0))), n).alias("mrr"), ratio(F.sum("__best"), n).alias("evidence_coverage"))


def extraction(rows: DataFrame, predicted: str, gold: str, predicted_line: str, gold_line: str, by: list[str] | None = None) -> DataFrame:
    tp = F.sum(F.least(predicted, gold))
    out = rows.groupBy(*(by or [])).agg(
        ratio(tp, F.sum(predicted)).alias("precision"), ratio(tp, F.sum(gold)).alias("recall"), ratio(F.count_if(F.col(predicted) != F.col(gold)), F.count(F.lit(1))).alias("atomicity_error_rate"),
        ratio(F.count_if(F.col(predicted_line).eqNullSafe(F.col(gold_line))), F.count(F.lit(1))).alias("line_mapping_accuracy"),
    )
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def engineering(rows: DataFrame, by: list[str]) -> DataFrame:
    """Calls, usage status, tokens that null poisons, cost under one price list, cache hits and false blocks per group.

    Columns: model_calls, usage_status, input_tokens, output_tokens, cost_usd, pricing_id, cache_hit, gold, predicted.
    """
    called = F.col("model_calls") > 0
    status = (
        F.when(F.sum("model_calls") == 0, "not_applicable").when(F.count_if(called & (F.col("usage_status") == "malformed")) > 0, "malformed")
        .when(F.count_if(called & (F.coalesce("usage_status", F.lit("missing")) != "reported")) == 0, "reported").otherwise("missing")
    )
    whole = lambda c: F.count_if(called & F.col(c).isNull()) == 0
    tokens = lambda c: F.when(F.sum("model_calls") == 0, 0).when((status == "reported") & whole("input_tokens") & whole("output_tokens"), F.sum(F.when(called, F.col(c))))
    priced = (F.count_if(called) > 0) & (F.count_distinct(F.when(called, F.col("pricing_id"))) == 1) & whole("cost_usd")
    open_ = F.col("gold") != "contradicted"
    return rows.groupBy(*by).agg(
        F.sum("model_calls").alias("model_calls"), status.alias("usage_status"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"),
        F.when(priced, F.sum(F.when(called, F.col("cost_usd")))).alias("cost_usd"), ratio(F.count_if("cache_hit"), F.count(F.lit(1))).alias("cache_hit_rate"),
        ratio(F.count_if(open_ & (F.col("predicted") == "contradicted")), F.count_if(open_)).alias("false_block_rate"),
    )


def tagged(rows: DataFrame, tags: Column) -> DataFrame:
    """One row for each subset a row belongs to (column ``subset``): overlapping reports with one aggregation."""
    return rows.withColumn("subset", F.explode(tags))


def coverage_gate(each: DataFrame, required: list[str], least: int, by: list[str] | None = None) -> DataFrame:
    """Whether every required label has ``least`` cases."""
    few = F.col("label").isin(required) & (F.col("support") < least)
    return each.groupBy(*(by or [])).agg((F.count_if(few) == 0).alias("achieved"), F.array_sort(F.collect_list(F.when(few, F.col("label")))).alias("insufficient_labels"))


def error_patterns(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", most: int = 3) -> DataFrame:
    """The most frequent wrong pairs, by (count descending, name)."""
    # the test is an aggregate: as a filter it would be pushed below the rows' own expressions and work them out twice
    each = rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(gold) != F.col(predicted)).alias("wrong"))
    return each.where("wrong").select(F.concat_ws("->", gold, predicted).alias("pattern"), "n").orderBy(F.desc("n"), "pattern").limit(most)


def stability(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population deviation, least and most of a metric over runs."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), F.min(value).alias("least"), F.max(value).alias("most"))


def agreement(rows: DataFrame, case: str, run: str, predicted: str, runs: int) -> DataFrame:
    """Over cases that all runs have: how many, and the share on which they agree."""
    each = rows.groupBy(case).agg(F.count_distinct(run).alias("seen"), F.count_distinct(predicted).alias("answers")).where(F.col("seen") == runs)
    return each.agg(F.count(F.lit(1)).alias("n_common"), ratio(F.count_if(F.col("answers") == 1), F.count(F.lit(1))).alias("agreement"))


def telemetry(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens that null poisons, failures and the median latency per group."""
    plain = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), poisoned_sum(F.col("tokens")).alias("tokens"), F.count_if("failed").alias("n_failed"))
    return plain.join(linear_percentiles(calls, "latency_ms", {"latency_p50": 0.5}, by), by, "left")
