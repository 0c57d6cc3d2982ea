"""TF-IDF cosines of the best pairs: against the cosines of all pairs, and what is shuffled for them."""

import random

from pyspark.sql import functions as F

from attestra.operators import retrieval, tfidf
from attestra.plans import registry
from tests.test_whole_job import put


def best(scored, k):
    made = scored.withColumn("cosine", F.round("cosine", 6)).select("source_id", F.col("l_id").cast("bigint").alias("l_id"), F.col("r_id").cast("bigint").alias("r_id"), "cosine")
    return sorted(tuple(x) for x in retrieval.top_k(made, k, ["source_id", "l_id"], "r_id", "cosine").drop("rank").collect())


def frames(spark, seed, words):
    r = random.Random(seed)

    def text():
        return r.choice([None, "", "x", *[" ".join(r.choice(words) for _ in range(r.randint(1, 12)))] * 30])

    left = [(r.choice([0, 1, 2, None]), k - k % 7 // 6, text()) for k in range(40)]  # every seventh id twice
    copies = [(s, 5000 + 10 * k + s, x) for s, _, x in left[:8] if s is not None for k in range(9)]
    right = [(k % 4, k - k % 11 // 10 * 4, text()) for k in range(600)]  # some ids twice within a source
    schema = "source_id int, {} bigint, text string"
    return spark.createDataFrame(left, schema.format("query_id")), spark.createDataFrame(right + copies, schema.format("chunk_id")).repartition(3)


def test_best_cosines_are_those_of_all_pairs(spark):
    left, right = frames(spark, 1, [f"wort{k * k % 97}ß" for k in range(60)] + ["the", "a_b", "9", "中文"])
    expected = best(retrieval.tfidf_cosine(left, right), 5)
    assert len(expected) > 100
    assert best(tfidf.best_cosines(left, right, 5), 5) == expected


def test_further_passes_and_full_counters_change_nothing(spark, monkeypatch):
    left, right = frames(spark, 2, ["aa", "bb", "cc", "dd", "ee"])
    for name, value in {"QUERIES": 20, "WORDS": 2000, "SKETCH": 64}.items():
        monkeypatch.setattr(tfidf, name, value)
    assert best(tfidf.best_cosines(left, right, 3), 3) == best(retrieval.tfidf_cosine(left, right), 3)


def test_no_left_rows(spark):
    left, right = frames(spark, 3, ["aa", "bb"])
    assert best(tfidf.best_cosines(left.where("false"), right, 3), 3) == []


def shuffled(spark):
    return sum(x.shuffleWriteRecords() for x in (stages.apply(k) for stages in [spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for k in range(stages.size())))


def test_tfidf_does_not_shuffle_the_grams_of_a_corpus(spark, tmp_path):
    put(spark, tmp_path, "documents", [(d, " ".join(f"w{d}x{k}" if k % 4 else f"common{k}" for k in range(300))) for d in range(400)], "doc_id bigint, text string")
    put(spark, tmp_path, "benchmark", [(k, f"common{4 * k} w{k}x1 w{k}x2 other") for k in range(10)], "item_id bigint, text string")
    before = shuffled(spark)
    got = registry.QUERIES["rnk11_tfidf"](spark, str(tmp_path)).collect()
    records = shuffled(spark) - before
    assert {x.query_id: x.chunk_id for x in sorted(got, key=lambda x: x.cosine)} == {k: 100000 * k for k in range(10)}
    assert 0 < records < 400 * 300 / 4, records
