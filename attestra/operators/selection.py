"""Joins and choices over spans, sentences and ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import spans


def touched(rows: DataFrame, ranges: DataFrame, scope: str, first: str = "line_start", last: str = "line_end") -> DataFrame:
    """Rows whose closed line span meets any of the changed ranges (scope, start, end) of its scope; a semi-join.

    The ranges are merged, so the first one that ends at or after a row's first line decides: an as-of
    step and no pairs.
    """
    whole = spans.merged(ranges, scope, "start", "end").withColumnRenamed("start", "__start")
    return spans.next_row(rows, whole, scope, first, "end", "__start").where(F.col("__start") <= F.col(last)).drop("__start")


def sentence_cover(predicted: DataFrame, sentences: DataFrame, scope: str, size: int = 256) -> DataFrame:
    """Overlapping pairs of predicted spans (p_start, p_end) and sentences (s_start, s_end), with ``covered``: the sentence is wholly inside."""
    pairs = spans.overlapping(predicted, sentences, scope, size, ("p_start", "p_end"), ("s_start", "s_end"))
    return pairs.withColumn("covered", (F.col("p_start") <= F.col("s_start")) & (F.col("s_end") <= F.col("p_end")))


def overlap_counts(left: DataFrame, right: DataFrame, scope: str, key: str, size: int = 256, l: tuple[str, str] = ("l_start", "l_end"), r: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Each left row (by scope and key) with ``n_overlaps``, the spans of ``right`` that overlap its own; zero where none does."""
    found = spans.overlapping(left, right, scope, size, l, r).groupBy(scope, key).agg(F.count(F.lit(1)).alias("n_overlaps"))
    return left.join(found, [scope, key], "left").na.fill({"n_overlaps": 0})


def checked_join(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The inner join on ``key``, and (key, violation) for keys of ``left`` that ``right`` lacks and keys that either side has twice."""
    missing = left.join(right, key, "left_anti").select(key, F.lit("missing").alias("violation"))
    twice = [side.groupBy(key).count().where("count > 1").select(key, F.lit(name).alias("violation")) for side, name in ((left, "duplicate_left"), (right, "duplicate_right"))]
    return left.join(right, key), missing.unionByName(twice[0]).unionByName(twice[1])


def candidates(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_id, doc_rank, doc_id, sentence_index, sentence) from claims (claim_id, doc_ids in rank order) and documents (doc_id, sentences)."""
    ranked = claims.select("claim_id", F.posexplode("doc_ids").alias("doc_rank", "doc_id"))
    return ranked.join(docs, "doc_id").select("claim_id", "doc_rank", "doc_id", F.posexplode("sentences").alias("sentence_index", "sentence"))


def zipped(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of both sides paired by place within ``by``; places that one side lacks are dropped."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return left.withColumn("place", place).join(right.withColumn("place", place).drop(order), [*by, "place"])


#: Chinese, Japanese and Korean characters that bring n-grams into a query.
CJK = "[㐀-䶿一-鿿豈-﫿]"


def gate(queries: DataFrame, chunks: DataFrame, scope: str = "source_id", most: int = 32, cjk: bool = True) -> DataFrame:
    """(scope, query_id, chunk_id): the chunks that a query is scored against.

    A chunk qualifies by any word of the query in its text or heading, or by any two or three CJK
    characters in a row; a query with CJK text that finds nothing takes all chunks of a source of
    ``most`` chunks at most. Without ``cjk`` words alone count. Queries need query_text, chunks text
    and heading (may be null).
    """
    plain = lambda c: F.array_distinct(T.lowered(T.matches(c, "[A-Za-z0-9]+")))
    wide = lambda c: F.array_distinct(T.cjk_ngrams(c)) if cjk else F.array().cast("array<string>")
    heading = F.concat_ws(" ", "text", "heading")
    terms = queries.select(scope, "query_id", F.explode(F.concat(plain(F.col("query_text")), wide(F.col("query_text")))).alias("term"))
    held = chunks.select(scope, "chunk_id", F.explode(F.array_distinct(F.concat(plain(heading), wide(F.col("text"))))).alias("term"))
    found = terms.join(held, [scope, "term"]).select(scope, "query_id", "chunk_id").distinct()
    if not cjk:
        return found
    small = chunks.groupBy(scope).count().where(F.col("count") <= most).select(scope)
    empty = queries.where((F.size(T.cjk_ngrams(F.col("query_text"))) > 0) & F.col("query_text").rlike(CJK)).join(found, [scope, "query_id"], "left_anti")
    return found.unionByName(empty.join(small, scope).join(chunks.select(scope, "chunk_id"), scope).select(scope, "query_id", "chunk_id"))


def full_context(chunks: DataFrame, scope: str = "source_id", chars: int = 2000, size: int = 8000) -> DataFrame:
    """(scope, context, n_chunks, char_start, char_end, score 0.0): sources whose chunks join to one literal text within the limits.

    Chunks adjoin with no gap or with a blank line between (two characters); one whose length does not
    fit its offsets rules its source out, and so does a text without visible characters.
    """
    w = Window.partitionBy(scope).orderBy("char_start", "chunk_id")
    gap = F.col("char_start") - F.lag("char_end").over(w)
    fits = (F.col("char_end") > F.col("char_start")) & (F.col("char_end") - F.col("char_start") == F.length("text")) & (gap.isNull() | gap.isin(0, 2))
    marked = chunks.withColumns({"fits": F.coalesce(fits, F.lit(False)), "part": F.concat(F.when(gap == 2, "\n\n").otherwise(""), "text")})
    small = marked.groupBy(scope).agg(F.bool_and("fits").alias("fits"), F.sum(F.length("part")).alias("n"), F.sum(F.octet_length("part")).alias("bytes")).where(F.col("fits") & (F.col("n") <= chars) & (F.col("bytes") <= size))
    # only sources within the limits are joined up, so a list holds ``chars`` characters at most
    parts = F.array_sort(F.collect_list(F.struct("char_start", "chunk_id", "part")))
    whole = marked.join(small.select(scope), scope).groupBy(scope).agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("context"), F.count(F.lit(1)).alias("n_chunks"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    return whole.where(F.col("context").rlike(r"\S")).withColumn("score", F.lit(0.0))


def bounded_urls(urls: Column, candidates: int = 5, fetches: int = 3) -> tuple[Column, Column]:
    """The first distinct URLs to consider, and those of them to fetch."""
    first = F.slice(F.array_distinct(urls), 1, candidates)
    return first, F.slice(first, 1, fetches)


def threshold_top(rows: DataFrame, by: str, score: str, least: float, order: list[str], most: int) -> DataFrame:
    """The ``most`` best rows of each group that score ``least`` or more, by (score descending, ``order``), with their rank."""
    window = Window.partitionBy(by).orderBy(F.desc(score), *order)
    return rows.where(F.col(score) >= least).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def relation_of(entailment: Column, contradiction: Column) -> Column:
    return F.when(entailment >= contradiction, "SUPPORT").otherwise("CONTRADICT")


def top_relation(rows: DataFrame, claim: str, least: float, lexical_top: int | None = None) -> DataFrame:
    """(claim, label, rank, doc_id, sentence_index) of the best candidate whose relation score is ``least`` or more and over neutral; NEI where none is.

    Needs rank (0-based lexical rank), entailment, neutral, contradiction. The better rank wins ties.
    """
    relation = F.greatest("entailment", "contradiction")
    fits = (relation >= least) & (relation > F.col("neutral")) & (F.lit(True) if lexical_top is None else F.col("rank") < lexical_top)
    best = F.max(F.when(fits, F.struct(relation.alias("score"), (-F.col("rank")).alias("place"), relation_of(F.col("entailment"), F.col("contradiction")).alias("label"), "doc_id", "sentence_index"))).alias("b")
    return rows.groupBy(claim).agg(best).select(claim, F.coalesce("b.label", F.lit("NEI")).alias("label"), (-F.col("b.place")).alias("rank"), "b.doc_id", "b.sentence_index")


def oracle_case(rationales: DataFrame, claim: str = "claim_id") -> DataFrame:
    """The rationale of each claim with fewest sentences, then characters, then document, sentences and order.

    Needs sentence_ids, premise, doc_id, group_index and label; ``n_labels`` over 1 is a conflict.
    """
    key = F.struct(F.size("sentence_ids"), F.length("premise"), "doc_id", "sentence_ids", "group_index")
    best = F.min_by(F.struct("doc_id", "sentence_ids", "group_index", "premise", "label"), key).alias("b")
    return rationales.groupBy(claim).agg(best, F.count_distinct("label").alias("n_labels")).select(claim, "b.*", "n_labels")
