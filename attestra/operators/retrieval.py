"""Lexical retrieval within sources: BM25, slot bonus, top-k under budgets, neighbours and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T


def chunk_terms(chunks: DataFrame, scope: str = "source_id", chunk: str = "chunk_id", text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(scope, chunk, term, tf) of all chunks, or of those terms alone that ``wanted`` (scope, term) has."""
    exploded = chunks.select(scope, chunk, F.explode(T.tokens(F.col(text))).alias("term"))
    exploded = exploded if wanted is None else exploded.join(wanted.select(scope, "term").distinct(), [scope, "term"], "left_semi")
    return exploded.groupBy(scope, chunk, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, scope: str = "source_id", query: str = "query_id", chunk: str = "chunk_id", text: str = "text") -> DataFrame:
    """(scope, query, chunk, score): BM25 without length norm over the query's own scope.

    The document frequency of a term is counted once per scope; repeated query terms count again;
    each date, version or percent literal of the query that a chunk contains adds 8. Only scores
    over zero are returned.
    """
    wanted = queries.select(scope, query, F.explode(T.tokens(F.col("query_text"))).alias("term")).groupBy(scope, query, "term").agg(F.count(F.lit(1)).alias("qf"))
    terms = chunk_terms(chunks, scope, chunk, text, wanted)  # other terms neither score nor count
    df = terms.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df"))
    total = chunks.groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = wanted.join(df, [scope, "term"]).join(total, scope).join(terms, [scope, "term"])
    scored = hits.groupBy(scope, query, chunk).agg(F.sum(F.col("qf") * idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2)).alias("lexical"))
    literals = queries.select(scope, query, T.matches(F.col("query_text"), T.SPECIAL).alias("literals"))
    texts = chunks.select(scope, chunk, F.lower(text).alias("low"))
    bonus = F.aggregate("literals", F.lit(0.0), lambda s, x: s + F.when(F.instr(F.col("low"), F.lower(x)) > 0, 8.0).otherwise(0.0))
    return scored.join(literals, [scope, query]).join(texts, [scope, chunk]).select(scope, query, chunk, (F.col("lexical") + bonus).alias("score"))


def top_k(scored: DataFrame, k: int = 5, group: list[str] | None = None, order: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best rows of each group, ranked by (score descending, order)."""
    window = Window.partitionBy(*(group or ["query_id"])).orderBy(F.desc(score), order)
    return scored.where(F.col(score) > 0).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def within_budget(hits: DataFrame, group: list[str], order: str, text: str, chars: int = 6000, size: int = 24000) -> DataFrame:
    """The prefix of each group whose running characters and bytes stay within budget."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = hits.withColumns({"running_chars": F.sum(F.length(text)).over(window), "running_bytes": F.sum(F.octet_length(text)).over(window)})
    return kept.where((F.col("running_chars") <= chars) & (F.col("running_bytes") <= size))


def neighbours(chunks: DataFrame, scope: str = "source_id", order: str = "chunk_id", text: str = "text", start: str = "char_start", end: str = "char_end", chars: int = 6144) -> DataFrame:
    """Add ``context``: the chunk with the chunk before and after it, where they adjoin (gap 0 or 2) and the whole stays within ``chars``."""
    w = Window.partitionBy(scope).orderBy(order)
    base = chunks.withColumns({"__before": F.lag(text).over(w), "__before_end": F.lag(end).over(w), "__after": F.lead(text).over(w), "__after_start": F.lead(start).over(w)})
    near = lambda gap: F.when(gap == 0, "").when(gap == 2, "\n\n")
    left, right = near(F.col(start) - F.col("__before_end")), near(F.col("__after_start") - F.col(end))
    before = F.when(left.isNotNull(), F.concat("__before", left)).otherwise("")
    with_left = F.concat(before, F.col(text))
    with_left = F.when(F.length(with_left) <= chars, with_left).otherwise(F.col(text))
    after = F.when(right.isNotNull(), F.concat(right, "__after")).otherwise("")
    whole = F.concat("__left", after)
    out = base.withColumn("__left", with_left)
    return out.withColumn("context", F.when(F.length(whole) <= chars, whole).otherwise(F.col("__left"))).select(*chunks.columns, "context")


def tfidf_cosine(left: DataFrame, right: DataFrame, scope: str = "source_id", left_id: str = "query_id", right_id: str = "chunk_id") -> DataFrame:
    """(scope, left, right, cosine): word unigrams and bigrams, 1+ln(tf), ln((1+n)/(1+df))+1, unit length, over all texts of a scope."""

    def grams(frame: DataFrame, key: str) -> DataFrame:
        words = T.matches(F.lower("text"), r"[\p{L}\p{N}_]{2,}")
        both = T.let(words, lambda w: F.concat(w, F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))))
        return frame.select(scope, F.col(key).cast("string").alias("id"), F.explode(both).alias("term")).groupBy(scope, "id", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))

    l, r = grams(left, left_id).withColumn("side", F.lit("l")), grams(right, right_id).withColumn("side", F.lit("r"))
    both = l.unionByName(r)
    n = left.select(scope).unionByName(right.select(scope)).groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    df = both.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = both.join(df, [scope, "term"]).join(n, scope).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = weighted.groupBy(scope, "side", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighted.join(norm, [scope, "side", "id"]).withColumn("w", F.col("w") / F.col("norm"))
    a = unit.where("side = 'l'").select(scope, "term", F.col("id").alias("l_id"), F.col("w").alias("lw"))
    b = unit.where("side = 'r'").select(scope, "term", F.col("id").alias("r_id"), F.col("w").alias("rw"))
    return a.join(b, [scope, "term"]).groupBy(scope, "l_id", "r_id").agg(F.sum(F.col("lw") * F.col("rw")).alias("cosine"))


def dual_threshold(scored: DataFrame, claim: str, doc: str, score: str, accept: float, expand: float) -> DataFrame:
    """Sentences of at least ``expand`` in documents that any sentence of at least ``accept`` admits."""
    best = F.max(score).over(Window.partitionBy(claim, doc))
    return scored.withColumn("doc_best", best).where((F.col("doc_best") >= accept) & (F.col(score) >= expand))


def best_source(fetches: DataFrame, claim: str, source: str, score: str, order: str) -> DataFrame:
    """The source with the strictly greatest first-hit score; the first fetched of equals."""
    return fetches.groupBy(claim).agg(F.max_by(source, F.struct(F.col(score), -F.col(order))).alias(source), F.max(score).alias(score))


def greedy_budget(options: DataFrame, group: str, size: str, order: list, most: int) -> DataFrame:
    """Options taken in order where they still fit a budget; one that does not fit is skipped, not the end.

    A group is one claim's options; ``order`` are ascending column expressions.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.col(size).alias("size"), F.col("option_id"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda s, x: F.when(s["used"] + x["size"] <= most, F.struct((s["used"] + x["size"]).alias("used"), F.array_append(s["taken"], x["option_id"].cast("bigint")).alias("taken"))).otherwise(s)
    return options.groupBy(group).agg(F.aggregate(ordered, start, step).alias("r")).select(group, F.col("r.used").alias("used"), F.col("r.taken").alias("taken"))


def best_similar(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: float) -> DataFrame:
    """(left, right, jaccard): for each left row the right row of greatest Jaccard similarity of word sets, ``least`` or more; the smaller id of equals.

    Prefix filtering: with words ordered from rare to frequent, two sets of similarity ``least`` share a
    word among the first n - ceil(least * n) + 1 of each, so frequent words make no candidates. Each
    candidate pair is compared once, on both whole sets.
    """
    sides = [f.select(F.col(i).alias("id"), F.col(words).alias("w")) for f, i in ((left, left_id), (right, right_id))]
    df = sides[1].select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        each = side.select("id", F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word", "left")
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "word"))
        return each.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select(F.col("id").alias(name), "word", F.col("n").alias(f"{name}_n"))

    found = prefixes(sides[0], "l").join(prefixes(sides[1], "r"), "word")
    smaller, larger = F.least("l_n", "r_n"), F.greatest("l_n", "r_n")
    pairs = found.where(smaller >= F.lit(least) * larger).select("l", "r").distinct()
    whole = pairs.join(sides[0].select(F.col("id").alias("l"), F.col("w").alias("lw")), "l").join(sides[1].select(F.col("id").alias("r"), F.col("w").alias("rw")), "r")
    scored = whole.select("l", "r", T.jaccard(F.col("lw"), F.col("rw")).alias("jaccard")).where(F.col("jaccard") >= least)
    best = scored.groupBy("l").agg(F.max(F.struct("jaccard", (-F.col("r")).alias("r"))).alias("b"))
    return best.select(F.col("l").alias(left_id), (-F.col("b.r")).alias(right_id), "b.jaccard")
