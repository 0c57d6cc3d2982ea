import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import perplexity, words


def pairs(text):
    words = ["<", *text.split(), ">"]
    return list(zip(words, words[1:], strict=False))


def discounts(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    out = [0.0]
    for j in (1, 2, 3):
        value = j - (j + 1) * y * n[j + 1] / n[j] if n[1] and n[j] else -1
        out.append(value if 0 < value < j else j / 2)
    return out


def brute_model(texts):
    """Log probability of a text by the textbook recursion, from plain dictionaries."""
    high = Counter(p for t in texts for p in pairs(t))
    low = Counter(w for _, w in high)
    cut2, cut1 = discounts(high.values()), discounts(low.values())
    total1, types = sum(low.values()), len(low) + 1
    left1 = sum(cut1[min(c, 3)] for c in low.values()) / total1
    total2, left2 = Counter(), Counter()
    for (v, _), c in high.items():
        total2[v] += c
        left2[v] += cut2[min(c, 3)]

    def p1(w):
        return (low[w] - cut1[min(low[w], 3)] if w in low else 0) / total1 + left1 / types

    def p2(v, w):
        if v not in total2:
            return p1(w)
        return (high[v, w] - cut2[min(high[v, w], 3)] if (v, w) in high else 0) / total2[v] + left2[v] / total2[v] * p1(w)

    return lambda text: sum(math.log(p2(v, w)) for v, w in pairs(text)) / len(pairs(text)), p1, low


def sample(seed, n, words=60, longest=40):
    rng = random.Random(seed)
    say = lambda: f"w{min(int(rng.expovariate(0.08)), words)}"
    return [" ".join(say() for _ in range(rng.randint(1, longest))) for _ in range(n)]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(k, lang, t) for k, t in enumerate(texts)], "doc_id bigint, lang string, text string")


def fold_of(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").bitwiseAND(1).alias("fold")).collect()
    return {r.text: r.fold for r in rows}


def test_keys_equal_those_of_sql(spark):
    v, w = np.array([0, 5, 2**63 + 9, 2**64 - 1], np.uint64), np.array([7, 2**63, 1, 0], np.uint64)
    rows = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(v.view(np.int64), w.view(np.int64), strict=True))], "k int, v bigint, w bigint")
    expected = [r.x for r in rows.select("k", F.xxhash64("v", "w").alias("x")).orderBy("k").collect()]
    assert perplexity.pair_keys(v, w).view(np.int64).tolist() == expected


def test_word_keys(monkeypatch):
    texts = [b" one\ttwo  one", b"", b"\n", "zwei\x0bdrei\x1cx é".encode(), b"two"]
    keys, sizes = perplexity.word_keys("en", texts)
    split = [x.split(None) for x in texts]
    said = [w for x in texts for w in x.replace(b"\x1c", b"\x01").split()]
    assert sizes.tolist() == [3, 0, 0, 3, 1] and len(split) == 5
    by = {}
    for w, k in zip(said, keys.tolist(), strict=True):
        assert by.setdefault(w, k) == k
    assert len({*by.values()}) == len(by) and by[b"two"] == perplexity.word_key("en", b"two") != perplexity.word_key("de", b"two")
    text = " ".join(sample(1, 300)).replace("w7 ", "w7 \n\t").encode()
    plain = perplexity.word_keys("en", [text, b"", b"a  b"])
    monkeypatch.setattr(words, "SPAN", 50)
    cut = perplexity.word_keys("en", [text, b"", b"a  b"])
    assert (plain[0] == cut[0]).all() and plain[1].tolist() == cut[1].tolist()
    assert len({*perplexity.word_keys("en", [" ".join(f"w{k}" for k in range(200_000)).encode()])[0].tolist()}) == 200_000


def test_packed_keys():
    keys = np.array([0, 2**64 - 1, 0x0123456789ABCDEF], np.uint64)
    assert perplexity._unpacked(perplexity._packed(keys, 8)).tolist() == [0, 2**48 - 1, 0x23456789ABCD]


def test_perplexity_equals_the_textbook_recursion(spark):
    texts = sample(3, 150) + ["new words here", "w1", "w1 w1 w1 w1 unseen w2"]
    docs = frame(spark, texts)
    labels = docs.where("doc_id < 140").selectExpr("doc_id", "1 AS quality")
    got = {r.doc_id: r for r in perplexity.classify(docs, labels).collect()}
    folds = fold_of(spark, texts)
    models = [brute_model([t for t in texts[:140] if folds[t] != f])[0] for f in (0, 1)]
    for k, text in enumerate(texts):
        assert got[k].perplexity == pytest.approx(math.exp(-models[folds[text]](text)), rel=1e-5)  # values are kept as 32-bit numbers


def test_probabilities_sum_to_one():
    _, p1, low = brute_model(sample(5, 80))
    assert sum(p1(w) for w in low) + p1("never seen") == pytest.approx(1)


@pytest.mark.parametrize("small", [True, False])
def test_groups_and_blocks_do_not_matter(spark, monkeypatch, small):
    """The worker's groups of texts, its store of words and the number of blocks leave the result as it is."""
    docs = frame(spark, sample(7, 120) + ["x " * 3000])
    labels = docs.selectExpr("doc_id", "1 AS quality")
    whole = {r.key: r.log for r in perplexity.perplexities(docs, labels, blocks=1)[0].collect()}
    other = {r.key: r.log for r in perplexity.perplexities(docs.repartition(9 if small else 1), labels, blocks=3)[0].collect()}
    assert whole.keys() == other.keys() and all(whole[k] == pytest.approx(other[k], rel=1e-6) for k in whole)


def test_threshold_is_the_quantile_of_the_trusted(spark):
    docs = frame(spark, sample(11, 200))
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS quality")
    got = perplexity.classify(docs, labels, quantile=0.9).collect()
    good = sorted(r.perplexity for r in got if r.doc_id % 4)
    assert got[0].threshold == pytest.approx(good[math.ceil(0.9 * len(good)) - 1], rel=2e-3)
    assert all(r.accepted == (r.perplexity <= r.threshold) for r in got)


def test_edges(spark):
    texts = sample(13, 60)
    rows = [(k, "en", t, 1) for k, t in enumerate(texts)] + [(100, None, texts[0], 1), (101, "xx", texts[1], 2), (102, "en", None, 1), (103, "en", "", 1), (104, "en", " \n ", 1), (None, "en", texts[2], 1), (5, "en", texts[5], 3), (105, "en", "wort " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, `key` int").withColumnsRenamed({"key": "l"})
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(3, 0), (4, None), (None, 1), (7, 1)], "doc_id bigint, quality int")
    got = perplexity.classify(docs, labels).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "lang", "text", "l", "perplexity", "threshold", "accepted"}
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    assert all(by[k].perplexity is None and not by[k].accepted for k in (102, 103, 104))
    assert by[100].perplexity > 0 and by[101].perplexity > 0 and by[105].perplexity > 0
    twice = [r for r in got if r.doc_id == 5]
    assert len(twice) == 2 and twice[0].perplexity == twice[1].perplexity
    with pytest.raises(ValueError):
        perplexity.classify(docs.withColumn("Threshold", F.lit(1)), labels)


def test_without_trusted_text_nothing_is_judged(spark):
    docs = frame(spark, ["a b", "", "c"])
    got = perplexity.classify(docs, spark.createDataFrame([], "doc_id bigint, quality int")).orderBy("doc_id").collect()
    assert [(r.perplexity, r.threshold, r.accepted) for r in got] == [(None, None, True), (None, None, False), (None, None, True)]
    assert perplexity.classify(docs.limit(0), docs.selectExpr("doc_id", "1 AS quality")).count() == 0


def test_few_trusted_documents_take_the_pooled_model(spark):
    many, few = frame(spark, sample(17, 80)), frame(spark, sample(18, 20), "de").selectExpr("doc_id + 1000 AS doc_id", "lang", "text")
    labels = many.unionByName(few.limit(19)).selectExpr("doc_id", "1 AS quality")
    _, order = perplexity.perplexities(many.unionByName(few), labels, least_docs=20)
    assert order == ["*", "en"]
    labels = many.unionByName(few).selectExpr("doc_id", "1 AS quality")
    assert perplexity.perplexities(many.unionByName(few), labels, least_docs=20)[1] == ["*", "de", "en"]


def test_held_out(spark):
    """All scores are held out, so labels can be compared over all documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = perplexity.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got.accepted[got.quality == 1].mean() > 0.97
    assert got.accepted[got.quality == 0].mean() < 0.3
