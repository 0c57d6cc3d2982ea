import pytest

from attestra.operators import rationales, repair, selector

GOLD = "claim int, doc int, rationale int, label string, sentences array<int>"


def test_official_scores(spark):
    gold = spark.createDataFrame([(1, 10, 0, "SUPPORT", [0, 1]), (1, 10, 1, "SUPPORT", [4]), (2, 20, 0, "CONTRADICT", [2])], GOLD)
    predicted = spark.createDataFrame([(1, 10, "SUPPORT", [0, 1, 3]), (2, 20, "SUPPORT", [2, 2]), (3, 30, "SUPPORT", [])], "claim int, doc int, label string, sentences array<int>")
    got = {r.measure: (r.precision, r.recall) for r in rationales.pipeline_scores(gold, predicted).collect()}
    assert got == {"sentence_selection": (3 / 5, 3 / 4), "sentence_label": (2 / 5, 2 / 4), "abstract_label_only": (1 / 3, 1 / 2), "abstract_rationalized": (1 / 3, 1 / 2)}
    best = {r.claim: (r.best_f1, r.complete) for r in rationales.best_rationale(gold, predicted).collect()}
    assert best == {1: (0.8, True), 2: (1.0, True)}
    assert all(r.f1 == 0 for r in rationales.pipeline_scores(gold.limit(0), predicted.limit(0)).collect())


def test_retrieval_scores(spark):
    gold = spark.createDataFrame([(1, 10, 0, "S", [0]), (1, 11, 0, "S", [0]), (2, 20, 0, "S", [1])], GOLD)
    claims = spark.createDataFrame([(1,), (2,), (3,)], "claim int")
    row = rationales.retrieval_scores(claims, gold, spark.createDataFrame([(1, [9, 10]), (2, [20]), (3, [5])], "claim int, docs array<int>")).first()
    assert (row.hit_one, row.hit_all, row.evidence_hit_all, row.mrr, row.document_recall) == pytest.approx((1.0, 2 / 3, 0.5, 0.75, 2 / 3))
    ranks = rationales.rank_statistics(gold, spark.createDataFrame([(1, [9, 10, 11]), (2, [20, 9, 1])], "claim int, docs array<int>")).first()
    assert (ranks.n, ranks.median_rank, ranks.least, ranks.most) == (3, 1.0, 0, 2)


@pytest.mark.parametrize(
    ("claim", "evidence", "reason", "replacement"),
    [
        ("It took 12 ms.", "It took 15 ms.", "ready", "15"), ("It took 12 ms.", "It took 15 s.", "units_differ", None), ("Rate is 5 %", "Rate was 7.5%", "ready", "7.5 %"), ("On 2026/01/02", "On 2026-03-04", "ready", "2026/03/04"), ("On JULY 4, 2026", "On March 12, 2025", "ready", "MARCH 12, 2025"),
        ("On 04 July 2026", "On 5 March 2025", "ready", "05 March 2025"), ("Costs $5", "Costs €6", "units_differ", None), ("v 1.2.3", "now 1.2.4", "ready", "1.2.4"), ("Has 5", "Has 5.5", "kinds_differ", None), ("Has 5 of 6", "Has 5", "not_one_scalar_each", None), ("Has 1.50", "Has 1.5", "agrees", None), (None, None, "not_one_scalar_each", None),
    ],
)
def test_plans(claim, evidence, reason, replacement):
    got = repair.planned(claim, evidence)
    assert (got[0], got[2]) == (reason, replacement)


def test_edits_and_diffs(spark):
    assert repair.applied("a 1 b 2", [(2, 3, "10"), (6, 7, "")]) == "a 10 b "
    assert repair.applied("abc", [(0, 2, "x"), (1, 3, "y")]) is None
    assert repair.unique_occurrence("aXbX", "X") is None and repair.unique_occurrence("aXb", "X") == 1 and repair.unique_occurrence("aaa", "aa") is None
    files = spark.createDataFrame([("d.md", "It took 12 ms.\nend"), ("e.md", "x")], "path string, text string")
    claims = spark.createDataFrame([("d.md", 0, "It took 12 ms.", "It took 15 ms."), ("e.md", 0, "x", "y")], "path string, claim_start int, claim_text string, evidence_text string")
    rows = repair.diffs(files, repair.plan(claims)).collect()
    assert [(r.path, r.status) for r in rows] == [("d.md", "applied")]
    assert "-It took 12 ms.\n+It took 15 ms.\n" in rows[0].diff and "No newline at end" in rows[0].diff


def test_selector(spark):
    rows = [(k % 7, f"The cache holds {k} keys now", f"The cache holds {k} keys now indeed" if k % 2 else "Rain fell in the north", float(k % 2)) for k in range(80)]
    frame = selector.balanced_weights(selector.features(spark.createDataFrame(rows, "claim_id int, claim_text string, text string, label double")))
    scored = selector.score(selector.fit(frame), frame)
    best = selector.sweep(scored, [0.1, 0.5, 0.9]).where("best").first()
    assert best.f1 == 1.0


def test_subset_judge_and_gate(spark):
    from attestra.operators import verdicts

    rows = [(1, [0], 0.9, 0.05, 0.05), (1, [0, 1], 0.9, 0.05, 0.05), (2, [0], 0.8, 0.1, 0.1), (2, [1], 0.1, 0.8, 0.1), (3, [0], 0.4, 0.3, 0.3), (4, [1], 0.1, 0.7, 0.2), (4, [0], 0.1, 0.7, 0.2), (5, [0], 0.52, 0.0, 0.48)]
    scored = spark.createDataFrame(rows, "claim_id int, indices array<int>, entailment double, contradiction double, neutral double")
    got = {r.claim_id: (r.relation, r.indices) for r in verdicts.subset_judge(scored).collect()}
    assert got == {1: ("entailed", [0]), 2: ("conflict", None), 3: ("not_in_source", None), 4: ("contradicted", [0]), 5: ("not_in_source", None)}
    row = verdicts.gate(spark.createDataFrame([(0.7, None)], "a double, b double"), {"a": 0.7, "b": 0.1}).first()
    assert (row.under_floor, row.achieved) == (["b"], False)


def test_outcome_signatures():
    from attestra.operators.repair import signature

    assert signature("took 5 ms", "about 7 ms") == ("integer", "7", "suffix:ms") == signature("took 7 ms", "about 7 ms")
    assert signature("took 5 ms", "about 7 s") is None and signature("5 of 6", "7") is None and signature(None, "7") is None
    assert signature("on 2024-01-02", "on 2024/3/4") is None and signature("on 2024-01-02", "on 3 March 2024") is None
    assert signature("$ 5", "$6.50") is None and signature("$ 5.0", "$6.50") == ("decimal", "6.5", "prefix:$")


def test_plain_blocks():
    from attestra.operators.parse import plain_blocks

    text = "\n a é https://x.example/y.\nb\n \n\nc https://z.example"
    blocks = list(plain_blocks(text))
    assert [(x[0], x[1], x[2]) for x in blocks] == [("p_0001", 2, 3), ("p_0002", 6, 6)]
    assert all(text[a:b] == raw for _, _, _, a, b, raw, _ in blocks)
    urls = [u for x in blocks for u in x[6]]
    assert [u["url"] for u in urls] == ["https://x.example/y", "https://z.example"]
    assert all(text[u["char_start"] : u["char_end"]] == u["url"] == text.encode()[u["byte_start"] : u["byte_end"]].decode() for u in urls)
    assert list(plain_blocks("")) == list(plain_blocks("\n \n")) == []
