"""Windows and joins over spans: running offsets, islands, merged intervals, overlap, containment, as-of and greedy matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minted(rows: DataFrame, scope: str, order: list[str], prefix: str, name: str = "id") -> DataFrame:
    """Ids ``prefix_0001``, ... by order of appearance in each scope."""
    return rows.withColumn(name, F.format_string(f"{prefix}_%04d", F.row_number().over(Window.partitionBy(scope).orderBy(*order))))


def offsets(rows: DataFrame, scope: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """char_start and char_end of parts joined by a separator of ``gap`` characters."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0))
    return rows.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(text))


def islands(rows: DataFrame, scope: str, number: str) -> DataFrame:
    """(scope, first, last, n): runs of consecutive distinct numbers."""
    ranked = rows.select(scope, number).distinct().withColumn("__run", F.col(number) - F.row_number().over(Window.partitionBy(scope).orderBy(number)))
    return ranked.groupBy(scope, "__run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def merged(rows: DataFrame, scope: str, start: str, end: str, touch: int = 1) -> DataFrame:
    """(scope, start, end): intervals united where they overlap or start within ``touch`` of the end before."""
    w = Window.partitionBy(scope).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0)
    marked = rows.withColumn("__fresh", fresh).withColumn("__group", F.sum("__fresh").over(w))
    return marked.groupBy(scope, "__group").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__group")


def clashing(rows: DataFrame, scope: str, start: str, end: str) -> DataFrame:
    """Rows with ``clashes``: whether the half-open span overlaps another of its scope."""
    w = Window.partitionBy(scope).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(start).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("clashes", F.coalesce(before > F.col(start), F.lit(False)) | F.coalesce(after < F.col(end), F.lit(False)))


def overlapping(left: DataFrame, right: DataFrame, scope: str, size: int, l: tuple[str, str] = ("l_start", "l_end"), r: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Pairs of half-open spans of a scope that overlap, once each.

    Spans are put into every cell of ``size`` positions that they touch and joined on (scope, cell), so a scope
    with very many spans is spread; a pair counts in the first cell both touch.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / size)))
    a = left.withColumn("__cell", cells(*l))
    b = right.withColumn("__cell", cells(*r))
    first = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / size)
    return a.join(b, [scope, "__cell"]).where((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])) & (F.col("__cell") == first)).drop("__cell")


def first_enclosing(spans: DataFrame, parts: DataFrame, scope: str, span_id: str, order: str, size: int = 256) -> DataFrame:
    """Each span with the first part (by ``order``) that wholly encloses it, or none.

    Parts go into every cell of ``size`` positions that they touch, a span into the one it starts in.
    """
    cells = F.explode(F.sequence(F.floor(F.col("p_start") / size), F.floor(F.col("p_end") / size)))
    inside = spans.withColumn("__cell", F.floor(F.col("s_start") / size)).join(parts.withColumn("__cell", cells), [scope, "__cell"]).where("p_start <= s_start and s_end <= p_end")
    best = inside.groupBy(scope, span_id).agg(F.min(order).alias(order))
    return spans.join(best, [scope, span_id], "left")


def next_row(left: DataFrame, right: DataFrame, scope: str, at: str, key: str, value: str) -> DataFrame:
    """As-of join to the next row: the first ``value`` of ``right`` whose ``key`` is at or after ``at``.

    Both sides go through one window per scope; no pair is formed.
    """
    names = left.columns
    both = left.select(*names, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    other = right.select(scope, F.col(key).alias("__at"), F.lit(1).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(scope).orderBy("__at", "__side").rowsBetween(0, Window.unboundedFollowing)
    whole = both.unionByName(other, allowMissingColumns=True).withColumn(value, F.first("__value", ignorenulls=True).over(w))
    return whole.where("__side = 0").select(*names, value)


def running_budget(rows: DataFrame, scope: str, order: list, cost: Column, most: int) -> DataFrame:
    """The prefix of each scope whose running cost stays within ``most``."""
    w = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= most)


def greedy_match(candidates: DataFrame, scope: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one matches by descending score (ties by left, then right), greedily, within each scope.

    A scope is one document, whose candidates fit a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))))
    pair = f"array<struct<l:{candidates.schema[left].dataType.simpleString()},r:{candidates.schema[right].dataType.simpleString()},s:double>>"
    none = F.array().cast(pair)
    free = lambda got, x: ~F.exists(got, lambda g: (g["l"] == x["l"]) | (g["r"] == x["r"]))
    step = lambda got, x: F.when(free(got, x), F.array_append(got, F.struct(x["l"].alias("l"), x["r"].alias("r"), (-x["s"]).cast("double").alias("s")))).otherwise(got)
    taken = candidates.where(F.col(score) > 0).groupBy(scope).agg(F.aggregate(ordered, none, step).alias("m"))
    return taken.select(scope, F.explode("m").alias("m")).select(scope, F.col("m.l").alias(left), F.col("m.r").alias(right), F.col("m.s").alias(score))
