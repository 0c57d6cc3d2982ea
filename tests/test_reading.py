"""Windows, spans, seams, features and sources, on fixtures and against brute force."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra.operators import datasets, evaluation, models, parse, policy, selection, windows
from attestra.sources import web


def test_directives_bind(spark):
    text = "One.\n\n```\n<!-- audit: ignore reason='code' -->\n```\n<!-- audit: ignore reason=\"a\" -->\n<!-- audit: ignore reason='b' -->\n\nTwo\nmore\n\n<!-- audit: ignore reason='c' -->\n# Head\n\nThree <!-- audit: ignore reason='d' --> here\n\n<!-- audit: ignore reason='' -->\n<!-- other: ignore reason='e' -->\n<!-- audit: ignore reason='f' -->"
    rows = parse.suppressions(spark.createDataFrame([(1, text), (2, None), (3, "no directive")], "doc_id bigint, text string"), "audit").orderBy("line").collect()
    assert [(r.suppression_id, r.scope, r.reason, r.line, r.target_start, r.target_end, r.problem) for r in rows] == [
        ("sup_0001", "paragraph", "a", 6, 9, 10, None), ("sup_0002", "paragraph", "b", 7, 9, 10, None), (None, None, "c", 12, None, None, "orphan"),
        ("sup_0003", "line", "d", 15, 15, 15, None), (None, None, "", 17, None, None, "invalid_reason"), (None, None, "f", 19, None, None, "orphan"),
    ]


@pytest.mark.parametrize(
    ("raw", "text", "lines"),
    [
        ("plain  words\n here", "plain words here", [(0, 12, 3), (12, 16, 4)]), ("![pic](http://x) a", "a", [(0, 1, 3)]), ("a [b](http://x/(y)) <https://c.example/d> e", "a b e", [(0, 5, 3)]), ("**b** _i_ `c*d*`[^2]", "b i c*d*", [(0, 8, 3)]),
        ("see https://x.example/y. Then\n\n\nmore", "see . Then more", [(0, 11, 3), (11, 15, 6)]), ("<!-- hidden --> shown", "shown", [(0, 5, 3)]), ("", "", []), (" \n ", "", []),
    ],
)
def test_visible_text(raw, text, lines):
    got, segments = parse.visible(raw, 3)
    assert got == text and [(s["start"], s["end"], s["line"]) for s in segments] == lines


def test_windows(spark):
    text = "First one. Second; third! v1.2 stays. 最后一句。 end"
    frame = spark.createDataFrame([(1, text), (2, " "), (3, "x" * 50 + ". y"), (4, None)], "paragraph_id bigint, text string")
    rows = windows.plan_windows(frame, 20).collect()
    one = [r for r in rows if r.paragraph_id == 1]
    assert [r.text for r in one] == ["First one.", "Second;", "third!", "v1.2 stays.", "最后一句。", "end"] and all(text[r.start : r.end] == r.text for r in one)
    assert one[0].window_id == "1_w_0001" and {r.status for r in one} == {"ready"}
    assert [(r.status, r.window_id) for r in rows if r.paragraph_id in (2, 4)] == [("intentional_empty", None)] * 2
    assert [(r.status, r.oversized) for r in rows if r.paragraph_id == 3] == [("oversized", True), ("oversized", False)]
    assert [t for t, *_ in windows.fragments("a; b; c", [(0, 4)])] == ["a; b;", "c"]


@pytest.mark.parametrize(("text", "drafts", "status"), [("a b a c", ["a", "c"], "ambiguous"), ("a b c", ["a", "c"], "mapped"), ("a b", ["b", "a"], "non_source"), ("a b", [], "mapped"), ("aa", ["a", "a"], "mapped"), ("", ["x"], "non_source")])
def test_ordered_spans(spark, text, drafts, status):
    row = spark.createDataFrame([(text, drafts)], "t string, d array<string>").select(windows.monotonic_spans("t", "d").alias("x")).first().x
    assert row.status == status
    if status == "mapped":
        assert [text[s.start : s.end] for s in row.spans] == drafts


def test_protected_and_routing(spark):
    frame = spark.createDataFrame([("At least 95% in 2024-01-02, not v1.2.3",), (None,)], "t string")
    rows = frame.select(windows.protected_spans("t").alias("p"), windows.routing_tokens("t").alias("r")).collect()
    assert [x.key for x in rows[0].p] == ["at least", "95%", "2024-01-02", "not", "v1.2.3"] and rows[1].p == rows[1].r == []
    assert [(x.kind, x.token) for x in rows[0].r] == [("percent", "95%"), ("date", "2024-01-02"), ("semver", "v1.2.3")]
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(12).alias("end")))
    assert frame.where("t is not null").select(windows.span_coverage(windows.protected_spans("t"), spans).alias("n")).first().n == 2


def test_url_problems(spark):
    want = {
        "https://a.example/": None, "http://8.8.8.8/": None, "http://10.0.0.1/": "private_address", "http://0x7f.1/": "private_address", "http://[::ffff:127.0.0.1]/": "private_address", "http://169.254.169.254/": "private_address", "ftp://a/": "scheme",
        "https://u@a.example/": "credentials", "http:///x": "no_host", "http://localhost/": "local_name", "http://a.example:22/": "port", None: "scheme", "http://[": "malformed",
    }
    got = spark.createDataFrame([(u,) for u in want], "url string").select("url", web.url_problem("url").alias("p")).collect()
    assert {r.url: r.p for r in got} == want
    pages = spark.createDataFrame([("https://a.example/", "text/html", "x" * 20), ("https://b.example/", "image/png", "y"), ("http://10.0.0.1/", "text/html", "z")], "url string, mime_type string, content string")
    wanted = spark.createDataFrame([(u,) for u in ("https://a.example/", "https://b.example/", "http://10.0.0.1/", "https://c.example/")], "url string")
    assert {r.url: (r.problem, r.content) for r in web.fetched(wanted, pages, 20).collect()} == {"https://a.example/": (None, "x" * 20), "https://b.example/": ("mime_type", None), "http://10.0.0.1/": ("private_address", None), "https://c.example/": ("not_fetched", None)}


def test_strict_json(spark):
    want = {'{"a": 1}': None, '{"a": 1, "a": 2}': "duplicate_key", '{"a": NaN}': "not_finite", "[1]": "not_an_object", '{"a": 1, "z": 2}': "unknown_field", '{"b": 1}': "missing_field", "{": "malformed", None: "malformed", '{"a": {"x": 1, "x": 1}}': "duplicate_key"}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", datasets.strict_json(F.col("t"), ["a"], ["a", "b"]).alias("p")).collect()
    assert {r.t: r.p for r in got} == want


def test_citations_of_sentences(spark):
    text, offsets = "one two\nthree\none", [(0, 0, 7), (1, 8, 13), (2, 14, 17)]
    places = [{"sentence": s, "char_start": a, "char_end": b} for s, a, b in offsets]
    cases = {"two\nthree": ("mapped", [0, 1]), "three": ("mapped", [1]), "one": ("ambiguous", None), "four": ("out_of_scope", None), "two\n": ("mapped", [0]), "": ("out_of_scope", None)}
    frame = spark.createDataFrame([(text, places, c) for c in cases], "t string, o array<struct<sentence:bigint,char_start:bigint,char_end:bigint>>, c string")
    got = frame.select("c", datasets.cited_sentences(F.col("t"), F.col("o"), F.col("c")).alias("x")).collect()
    assert {r.c: (r.x.status, r.x.sentences) for r in got} == cases


def test_canonical_json(spark):
    frame = spark.createDataFrame([("é", None, 1.5)], "b string, a string, c double")
    row = frame.select(datasets.canonical_json(F.struct("b", "a", "c")).alias("x"), datasets.canonical_json(F.struct("b", "a"), ["a"]).alias("y")).first()
    assert row.x == json.dumps({"a": None, "b": "é", "c": 1.5}, sort_keys=True, separators=(",", ":")) and row.y == '{"b":"\\u00e9"}'


def test_synthetic_claims(spark):
    rows = datasets.synthetic_claims(spark, 12, ["x {n}", "y {n} z"], ["short", "long"]).collect()
    assert len(rows) == 12 and rows[3].text == "y 3 z" and Counter((r.template, r.stratum) for r in rows) == dict.fromkeys([(t, s) for t in (0, 1) for s in ("short", "long")], 3)


def test_gate_with_cjk(spark):
    queries = spark.createDataFrame([(1, 1, "产品性能 v2"), (1, 2, "nothing here"), (1, 3, "完全无关"), (2, 4, "完全无关"), (1, 5, "?!")], "source_id int, query_id int, query_text string")
    chunks = [(1, 1, "这个产品性能很好", None), (1, 2, "version v2 out", None), (1, 3, "other", "here"), (1, 4, "else", None)] + [(2, k, f"c{k}", None) for k in range(40)]
    got = {(r.query_id, r.chunk_id) for r in selection.gate(queries, spark.createDataFrame(chunks, "source_id int, chunk_id int, text string, heading string")).collect()}
    assert got == {(1, 1), (1, 2), (2, 3)} | {(3, k) for k in range(1, 5)}


def test_pair_cosines_against_brute_force(spark):
    r = random.Random(1)
    say = lambda: " ".join(r.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(r.randint(0, 6)))
    rows = [(k, k % 3 != 0, say(), say()) for k in range(30)]
    frame = spark.createDataFrame(rows, "k int, train boolean, a string, b string")
    got = {x.k: x.c for x in models.pair_cosines(frame, "k", "a", "b", "train", models.word_grams, "c").collect()}

    def grams(t):
        w = t.split()
        return Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)])

    fitted = [grams(t) for _, train, *pair in rows if train for t in pair]
    df = Counter(g for c in fitted for g in c)
    weight = lambda c: {g: (1 + math.log(n)) * (math.log((1 + len(fitted)) / (1 + df[g])) + 1) for g, n in c.items() if g in df}
    for k, _, a, b in rows:
        x, y = weight(grams(a)), weight(grams(b))
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        assert got[k] == pytest.approx(sum(v * y.get(g, 0) for g, v in x.items()) / norm if norm else 0.0)


def test_char_grams(spark):
    row = spark.createDataFrame([("Ab c",)], "t string").select(models.char_grams(F.col("t"), 2, 3).alias("g")).first()
    assert sorted(row.g) == sorted([" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "])


def test_weights_scaler_and_grid(spark):
    rows = [(c, y, float(3 * c + y + k), k / 10) for c in range(3) for y in (0, 1) for k in range(1 + c + y)]
    frame = models.claim_weights(spark.createDataFrame(rows, "claim int, y int, f double, score double"), "claim", "y")
    assert {c: round(sum(r.weight for r in frame.collect() if r.claim == c), 9) for c in range(3)} == {0: 1, 1: 1, 2: 1}
    given = [(r.f, r.weight) for r in frame.collect()]
    mean = sum(f * w for f, w in given) / sum(w for _, w in given)
    deviation = math.sqrt(sum(w * (f - mean) ** 2 for f, w in given) / sum(w for _, w in given))
    assert models.weighted_scaler(frame, ["f"])["f"] == (pytest.approx(mean), pytest.approx(deviation))
    grid = spark.createDataFrame([(0.0,), (0.1,), (0.2,)], "threshold double")
    metric = lambda f, by: f.groupBy(*by).agg(F.avg(((F.col("score") >= F.col("threshold")) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    best = {r.claim: (r.threshold, r.accuracy) for r in models.grid_sweep(frame, "claim", grid, metric, F.col("n") > 0, [F.col("accuracy"), -F.col("threshold")]).collect()}
    for c in range(3):
        mine = [(s, y) for k, y, _, s in rows if k == c]
        assert best[c] == max(((t, sum((s >= t) == (y == 1) for s, y in mine) / len(mine)) for t in (0.0, 0.1, 0.2)), key=lambda x: (x[1], -x[0]))


def test_lexical_score(spark):
    names = [*models.LEXICAL_WEIGHTS, "normalized_sentence_position"]
    ones = spark.createDataFrame([tuple([1.0] * len(names)), tuple([0.0] * len(names))], names).select(models.lexical_score().alias("s")).collect()
    assert [round(r.s, 9) for r in ones] == [0.98, 0.02]


def test_scorer_batches_and_rejects(spark):
    frame = spark.createDataFrame([("the cat sat", "cat sat"), ("the cat did not sit", "cat sit"), ("w " * 600, "w"), (None, "x")], "p string, c string")
    rows = frame.select(models.scorer(models.overlap_scores, batch=2)(F.col("p"), F.col("c")).alias("s")).collect()
    assert [r.s.rejected for r in rows] == [False, False, True, True] and rows[0].s.entailment == 1.0 and rows[1].s.contradiction > 0.5
    swapped = spark.createDataFrame([(1, False, 0.7, 0.2, 0.1), (1, True, 0.3, 0.2, 0.5)], "k int, swapped boolean, a double, b double, c double")
    row = models.swapped_average(swapped, "k", ["a", "b", "c"]).first()
    assert (round(row.a, 9), round(row.b, 9), round(row.c, 9), row.n) == (0.6, 0.2, 0.2, 2)


def test_model_seam_asks_again_once(spark):
    frame = spark.createDataFrame([("judge", '{"claim": "x"}'), ("flaky", '{"claim": "x"}')], "task string, payload string")
    rows = frame.select(models.complete(models.fake_client, ["label"])(F.col("task"), F.col("payload")).alias("r")).collect()
    assert [(r.r.attempts, r.r.failed) for r in rows] == [(1, False), (2, False)] and rows[0].r.answer == rows[1].r.answer
    broken = frame.select(models.complete(lambda t, p: "{}", ["label"])(F.col("task"), F.col("payload")).alias("r")).first().r
    assert (broken.attempts, broken.failed, broken.answer) == (2, True, None)


def test_lookup_and_decisions(spark):
    claims = spark.createDataFrame([("s", 1, "red fox"), ("s", 2, "absent words"), ("t", 1, "red")], "source_id string, claim_id int, claim_text string")
    chunks = spark.createDataFrame([("s", 1, "a red fox ran"), ("s", 2, "a red hen"), ("t", 3, "blue")], "source_id string, chunk_id int, text string")
    assert sorted((r.source_id, r.claim_id, r.chunk_id, r["rank"]) for r in models.evidence_lookup(claims, chunks).collect()) == [("s", 1, 1, 1), ("s", 1, 2, 2)]
    options = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "claim_id int, option_id int")
    decisions = spark.createDataFrame([(1, 11), (2, 99)], "claim_id int, option_id int")
    assert {(r.claim_id, r.option_id): r.chosen for r in models.resolved(options, decisions).collect()} == {(1, 10): False, (1, 11): True, (2, 20): None}


def test_alignment_is_greedy_by_score(spark):
    gold = [("d", 1, "alpha beta", 0, 5, 1), ("d", 2, "beta gamma", 6, 9, 2), ("d", 3, "same", 10, 14, 3), ("d", 4, "same", 10, 14, 3)]
    predicted = [("d", 1, "beta gamma delta", 6, 9, 2), ("d", 2, "beta", 0, 2, 1), ("d", 3, "same", 10, 14, 3), ("d", 4, "none", 0, 1, 9)]
    schema = "doc string, {0} int, text string, offset_start int, offset_end int, line_start int"
    got = evaluation.align_claims(spark.createDataFrame(gold, schema.format("g")), spark.createDataFrame(predicted, schema.format("p")), "doc").collect()
    assert sorted((r.g, r.p, round(r.score, 3), r.exact) for r in got) == [(1, 2, 0.667, False), (2, 1, 0.8, False), (3, 3, 1.0, True)]


def test_poisson_weights():
    steps = evaluation.poisson_steps()
    assert steps[0] == pytest.approx(math.exp(-1)) and steps == sorted(steps) and 1 - steps[-1] < 1e-8 and len(steps) > 9


def test_artifacts_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    web.write_eval_artifacts(rows, rows, {"seed": "7"}, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run" / "manifest")).first().name == "seed"
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        web.write_eval_artifacts(rows, rows, {}, str(tmp_path / "run"))
    items = spark.createDataFrame([("b", "failed", "x"), ("b", "ok", "y"), ("c", "failed", "z"), ("d", "ok", "q")], "batch string, status string, sha256 string")
    assert {r.batch: r.rollup for r in web.batch_manifest(items, "batch").collect()} == {"b": "partial", "c": "fatal", "d": "complete"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.diff").write_text("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n")
    hunks = parse.unified_diffs(web.patches(spark, str(tmp_path / "p"))).collect()
    assert [(h.new_path, h.added) for h in hunks] == [("x", [1, 2])]


def test_policy_edges(spark):
    claims = spark.createDataFrame([(1, 0), (2, 1)], "claim_id int, n_citations int")
    assert policy.plan_violations(claims.limit(0).selectExpr("claim_id", "'x' AS action"), claims, ["x"]).count() == 2
    assert policy.exit_codes(spark.createDataFrame([("d", None), ("d", "warning"), ("e", "error")], "doc string, effective_severity string"), "doc").orderBy("doc").collect()[1].exit_code == 1


def test_markdown_files_are_whole(spark, tmp_path):
    from attestra.sources import files

    (tmp_path / "a.md").write_text("one\n\ntwo\n")
    assert [r.text for r in files.markdown_files(spark, str(tmp_path)).collect()] == ["one\n\ntwo\n"]


def test_reference_files(spark, tmp_path):
    import hashlib

    from attestra.sources import files

    given = {"a.md": b"same", "b.md": b"same", "c.md": b"", "d.txt": b"x", "e.md": b"\xff", "sub/a.md": b"other"}
    for name, data in given.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    expected = spark.createDataFrame([("e.md", "0" * 64), ("b.md", hashlib.sha256(b"same").hexdigest()), ("a.md", hashlib.sha256(b"same").hexdigest())], "name string, sha256 string")
    found = files.reference_files(spark, str(tmp_path), [".md"], expected=expected)
    got = {r.path.split(str(tmp_path) + "/")[1]: (r.problem, r.text) for r in found.collect()}
    assert got == {"a.md": (None, "same"), "b.md": (None, "same"), "d.txt": ("suffix", None), "e.md": ("not_utf8", None), "sub/a.md": ("sha256", None)}
    ready = {r.path.split(str(tmp_path) + "/")[1]: r.problem for r in files.preflight(files.reference_files(spark, str(tmp_path), [".md"])).collect()}
    assert ready == {"a.md": None, "b.md": "duplicate", "d.txt": "suffix", "e.md": "not_utf8", "sub/a.md": None}


def test_broken_json_lines_are_numbered(spark, tmp_path):
    from attestra.sources import files

    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": \n{"k": 2}\nnope\n')
    assert [(r.line_no, r.problem) for r in files.json_line_problems(spark, str(tmp_path), "k int").orderBy("line_no").collect()] == [(3, "malformed"), (5, "malformed")]


def test_components_ranked(spark):
    from attestra.operators import graph

    labels = spark.createDataFrame([(n, c) for c in range(40) for n in range(1 + c % 7)], "node int, component int")
    got = {r.component: r["rank"] for r in graph.ranked_components(labels).collect()}
    order = sorted(range(40), key=lambda c: (-(1 + c % 7), c))
    assert got == {c: k for k, c in enumerate(order, 1)}
    assert graph.ranked_components(labels.limit(0)).count() == 0


def test_verdict_chain_works_each_pattern_out_once(spark):
    """The optimised plan of the verdicts holds each slot expression once; patterns must not be copied into later columns."""
    from attestra.plans import claims

    plan = claims.verdict_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") < 60
