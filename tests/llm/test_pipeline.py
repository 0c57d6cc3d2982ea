import random

import corpus_pipeline
from attestra.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(r, n):
    words = [r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]) + str(r.randrange(50)) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def tables(spark, path):
    r = random.Random(1)
    clean = [sentence(r, 30) + "\n" + sentence(r, 25) for _ in range(60)]
    passage = sentence(r, 20)
    docs = [(k, t) for k, t in enumerate(clean)]
    docs += [(100, clean[3]), (101, clean[3].replace("alpha", "alpha")), (102, "short."), (103, "buy!! now!! " * 30), (104, passage), (105, None), (106, ""), (107, clean[5] + "\nHome | News | About | More")]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(docs)


def test_stages_take_effect(spark, tmp_path):
    texts = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == names and made.dtypes == docs.dtypes
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {x.doc_id: x for x in docs.collect()}
    assert {102, 103, 105, 106} & set(left["quality_rules"]) == set()
    assert left["quality_rules"][107].text == texts[5] and left["quality_rules"][107].n_chars == len(texts[5])
    assert set(range(60)) <= set(left["quality_classifier"])
    kept = left["simhash_near_dedup"]
    assert {100, 101, 107} & set(kept) == set() and {3, 5, 104} <= set(kept)
    codes = [simhash.fingerprint(x.text.encode()) for x in kept.values()]
    assert all((a ^ b).bit_count() > 4 for k, a in enumerate(codes) for b in codes[:k])
    assert 104 not in left["benchmark_decontamination"] and set(left["benchmark_decontamination"]) == set(kept) - {104}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(left["benchmark_decontamination"])


def test_empty_documents(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_nulls_ties_and_clashing_columns(spark, tmp_path):
    """Null languages, ids and texts, repeated rows and columns named like the operators' own pass through every stage."""
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = docs.where("doc_id < 3").selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars")
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 7")).selectExpr("*", "1 AS `row`", "'k' AS key", "2 AS l", "3 AS hits", "4 AS best", "5 AS id", "6 AS text_hash", "7 AS words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.dtypes == docs.dtypes
        made.write.parquet(f"{tmp_path}/odd-{name}")
        docs = spark.read.parquet(f"{tmp_path}/odd-{name}")
    rows = docs.collect()
    assert {tuple(r)[5:] for r in rows} == {(1, "k", 2, 3, 4, 5, 6, 7)}
    ids = [r.doc_id for r in rows]
    assert None not in ids and ids.count(7) == 1  # the copy with an id stays, once
