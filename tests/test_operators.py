import datetime
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import graph, metrics, parse, retrieval, signals, spans, verdicts
from attestra.sources import files
from attestra.streaming import incremental

SIGNALS = [
    ("Success was 82%.", "Success was 62%.", "numeric_mismatch", True), ("Latency was 1,000 ms.", "Latency was 900 ms.", "numeric_mismatch", True), ("The cache is enabled.", "The cache is enabled by default.", "numeric_mismatch", False),
    ("Released 2026-07-10.", "Released 2026/07/11.", "date_mismatch", True), ("Released 2026-07-10.", "Released 2026/07/10.", "date_mismatch", False), ("Needs v1.2.3 now.", "Needs 1.2.4 now.", "version_mismatch", True),
    ("The queue service does not drop messages today.", "The queue service drop messages today.", "negation_mismatch", True), ("Alpha stores user session data.", "Beta stores user session data.", "entity_mismatch", True),
    ("It is faster than that.", "It runs.", "comparison_reminder", True), ("The plan covers only premium accounts storage.", "The plan covers all standard accounts storage.", "qualifier_mismatch", True),
    ("The tool reads logs and writes encrypted backups.", "The tool reads logs quickly.", "conjunction_mismatch", True),
]


@pytest.mark.parametrize(("claim", "evidence", "code", "there"), SIGNALS)
def test_signals(spark, claim, evidence, code, there):
    row = signals.with_signals(spark.createDataFrame([(claim, evidence)], "claim_text string, evidence_text string")).first()
    assert (code in [s.code for s in row.signals]) is there


def test_null_texts_have_no_signals(spark):
    rows = signals.with_signals(spark.createDataFrame([(None, None), ("a", None)], "claim_text string, evidence_text string")).collect()
    assert all(r.signals == [] for r in rows)


def test_deterministic_judge(spark):
    rows = [("The parser supports nested tables.", "The parser supports nested tables and lists.", True, True, "entailed"), ("The parser supports nested tables.", "Weather was mild.", True, True, "not_in_source"), ("x y", None, True, True, "not_in_source"), ("Latency was 10 ms now.", "Latency was 12 ms now.", True, True, "contradicted"), ("a b", "a b", False, True, "source_unavailable"), ("a b", "a b", True, False, "not_checkable"), ("You should prefer tabs.", "You should prefer tabs.", True, True, "not_checkable")]
    frame = spark.createDataFrame([(*r, 4.0) for r in rows], "claim_text string, evidence_text string, available boolean, checkable boolean, gold string, score double")
    for r in verdicts.deterministic(signals.with_signals(frame)).collect():
        assert r.relation == r.gold, r.claim_text
        assert 0 <= r.confidence <= 0.99


def test_severity_takes_the_worse_label(spark):
    rows = spark.createDataFrame([("entailed", "disputed"), ("contradicted", "cited_only"), ("not_checkable", "cited_only"), ("entailed", "cited_only")], "r string, c string")
    assert [x.s for x in rows.select(verdicts.severity(F.col("r"), F.col("c")).alias("s")).collect()] == ["warning", "error", "notice", "pass"]


def column(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (T.numbers, "took 120ms and 1,000 of 62.5 on 2026-07-10", ["12", "1000"]), (T.versions, "V1.2 and 62.5", ["1.2", "62.5"]), (T.dates, "2026/7/1 2026-07-01", ["2026-7-1", "2026-07-01"]), (T.tokens, "Foo-bar 50% v1.2", ["foo-bar", "50%", "v1.2"]),
        (T.cjk_ngrams, "a 中文字 b 文", ["中文", "文字", "中文字"]), (T.sentences, "One. Two!  Three", ["One.", "Two!", "Three"]), (T.sentences, "中文。下一句！\n\n完", ["中文。", "下一句！", "完"]), (T.fragments, "a; b。c. d", ["a;", "b。", "c.", "d"]),
        (T.qualifiers, "Only 5 regions among 10 accounts", ["denominator:among 10 accounts", "only", "scope::account", "scope::region"]), (T.claim_type, "Since v1.2", "versioned_capability"), (T.claim_type, "On 2026-01-02", "dated_event"), (T.claim_type, "Has 3", "numeric_measurement"), (T.claim_type, "Plain", "factual_statement"),
        (T.checkability, "You should use it", "not_checkable"), (T.checkability, "You should use 3 of it", "checkable"), (T.complete_claim, "The launch record is", False), (T.complete_claim, "It works", True), (T.casefold, "Straße", "strasse"), (T.nfkc, "ｆｕｌｌ", "full"),
        (T.target_kind, "https://x", "web"), (T.target_kind, "a@b.c", "email"), (T.target_kind, "#x", "anchor"), (T.target_kind, "a/b:c", "relative"), (T.target_kind, "tel:1", "other"), (lambda c: F.size(parse.typed_scalars(c)), "1.2.3 on 2026-07-10, 5 % of 1.50 and +7", 5),
    ],
)
def test_text_functions(spark, function, text, expected):
    got = column(spark, text, function)
    assert (sorted(got) if function in (T.numbers, T.qualifiers) else got) == (sorted(expected) if function in (T.numbers, T.qualifiers) else expected)


def test_scalars_by_priority():
    assert [(x["kind"], x["value"]) for x in parse.scalars("4 July 2026, 5%, 1.50, 007")] == [("date", "2026-07-04"), ("percentage", "5"), ("decimal", "1.5"), ("integer", "7")]


@pytest.mark.parametrize(("glob", "path", "fits"), [("docs/**/*.md", "docs/a/b.md", True), ("docs/**/*.md", "docs/b.md", True), ("*.md", "a/b.md", False), ("a?c", "abc", True), ("[!x]b", "ab", True), ("[!x]b", "xb", False), ("a.c", "abc", False), ("**", "a/b", True)])
def test_globs(spark, glob, path, fits):
    assert column(spark, path, lambda c: T.in_scope(c, [glob], [])) is fits
    assert column(spark, path, lambda c: T.in_scope(c, [], [glob])) is not fits


def test_heading_path_quirk(spark):
    frame = spark.createDataFrame([([(1, "A"), (3, "B"), (3, "C"), (2, "D")],)], "h array<struct<level:int,title:string>>")
    assert frame.select(parse.heading_path(F.col("h")).alias("p")).first().p == ["A", "D"]
    assert frame.select(parse.heading_path(F.slice("h", 1, 3)).alias("p")).first().p == ["A", "B", "C"]


NOTE = """# Title

Some *text* with [one](https://e.example/a_(b)), [two][Ref] and `[code](x)`.
More ![img](y) https://e.example/q?x=1). <https://auto.example>

## Part

- item one
> quoted [^n]

```
[not](here)
```

<!-- suppress-next: known -->
    indented code

[ref]: https://e.example/ref
[ref]: https://e.example/again
[^n]: a note
"""


def test_markdown(spark):
    docs = spark.createDataFrame([(1, NOTE), (2, None), (3, "")], "doc_id bigint, text string")
    rows = parse.markdown_paragraphs(docs).collect()
    assert [(r.kind, r.line_start, r.line_end, r.heading_path) for r in rows] == [("paragraph", 3, 4, ["Title"]), ("list_item", 8, 8, ["Title", "Part"]), ("blockquote", 9, 9, ["Title", "Part"])]
    assert rows[0].plain_text.startswith("Some text with one, two and [code](x). More")
    found = parse.resolve(parse.markdown_citations(docs), parse.markdown_definitions(docs)).orderBy("ordinal").collect()
    assert [(r.kind, r.destination, r.resolved) for r in found] == [("inline", "https://e.example/a_(b)", True), ("reference", "https://e.example/ref", True), ("bare_url", "https://e.example/q?x=1", True), ("autolink", "https://auto.example", True), ("footnote", "a note", True)]
    assert [r.duplicate for r in parse.markdown_definitions(docs).orderBy("line").collect()] == [False, True, False]


def test_diffs(spark):
    patch = "diff --git a/x.md b/x.md\n--- a/x.md\n+++ b/x.md\n@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n@@ -9 +10 @@\n-e\n+f\n\\ No newline at end of file\ndiff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+z\ndiff --git a/o b/p\nrename from o\nrename to p\n"
    rows = parse.unified_diffs(spark.createDataFrame([(1, patch), (2, None)], "diff_id bigint, patch string")).collect()
    assert [(r.status, r.old_path, r.new_path, r.new_start, r.added, r.removed) for r in rows] == [("modified", "x.md", "x.md", 1, [2, 3], [2]), ("modified", "x.md", "x.md", 10, [10], [9]), ("added", None, "n", 1, [1], []), ("renamed", "o", "p", None, [], [])]


def test_html_blocks(spark):
    page = (
        "<title> T </title><style>x</style><nav><img src=a><p>n</p></nav><h1>A</h1><p>one <b>two</b></p><div class='cookie-bar'><p>c</p></div><h2>B</h2><p>open<p>three</p><p hidden>h</p>"
        "<p aria-hidden=TRUE>s</p><p class='ad'>four</p><script>w</script><footer><p>f</p></footer><li>five</li>"
    )
    loose = "<div>only <b>loose</b> text</div><script>x</script><table><td>cell</td></table>"
    long = "<p>" + "word " * 900 + "</p><p>after</p>"
    rows = parse.html_blocks(spark.createDataFrame([(1, page), (2, None), (3, loose), (4, long)], "page_id bigint, html string")).collect()
    by = {k: [r for r in rows if r.page_id == k] for k in range(1, 5)}
    assert [(r.title, r.heading_path, r.text, r.char_start) for r in by[1]] == [("T", ["A"], "one two", 0), ("T", ["A", "B"], "three", 9), ("T", ["A", "B"], "four", 16), ("T", ["A", "B"], "five", 22)]
    assert [r.locator for r in by[1]] == ["A > paragraph 1 [chars 0-7]", "A > B > paragraph 1 [chars 9-14]", "A > B > paragraph 2 [chars 16-20]", "A > B > paragraph 3 [chars 22-26]"]
    assert by[2] == [] and [r.text for r in by[3]] == ["only loose text cell"]
    assert [len(r.text) <= 2000 for r in by[4]] == [True] * 4 and by[4][1].locator.startswith("paragraph 1 part 2 [chars ") and by[4][3].char_start == 900 * 5 - 1 + 2


@pytest.mark.parametrize(("url", "left"), [("https://e.example/a,b;", "https://e.example/a,b"), ("https://e.example/a_(b).", "https://e.example/a_(b)"), ("https://e.example/x.)", "https://e.example/x."), ("https://e.example/x).", "https://e.example/x"), ("https://e.example/x)]", "https://e.example/x")])
def test_bare_urls(url, left):
    assert parse.trim_bare_url(url) == left


def test_bounded_chunks(spark):
    r = random.Random(1)
    text = "".join(r.choice("abé \n") for _ in range(2000))
    rows = parse.bounded_chunks(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc_id bigint, text string"), chars=50, size=60).collect()
    assert all(len(x.text) <= 50 and len(x.text.encode()) <= 60 and x.text == text[x.char_start : x.char_end] == x.text.strip() for x in rows)
    assert "".join(x.text for x in rows).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_bm25_by_hand(spark):
    import math

    chunks = spark.createDataFrame([(1, 0, "red fox"), (1, 1, "red red dog v1.2.3"), (1, 2, "cat"), (2, 0, "red")], "source_id int, chunk_id int, text string")
    queries = spark.createDataFrame([(1, 9, "Red red v1.2.3")], "source_id int, query_id int, query_text string")
    got = {r.chunk_id: r.score for r in retrieval.bm25(queries, chunks).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    assert got == pytest.approx({0: 2 * idf(2) * 2.2 / 2.2, 1: 2 * idf(2) * 2 * 2.2 / 3.2 + idf(1) + 8})


def test_percentile_kinds(spark):
    rows = spark.createDataFrame([(float(k),) for k in (1, 2, 3, 4)], "v double")
    assert metrics.floor_percentiles(rows, "v", {"x": 0.95}).first().x == 4.0
    assert metrics.nearest_rank_percentiles(rows, "v", {"x": 0.5}).first().x == 2.0


def test_metrics_bounds(spark):
    r = random.Random(2)
    names = verdicts.RELATIONS
    rows = spark.createDataFrame([(r.choice(names[:4]), r.choice(names), r.random()) for _ in range(300)], "gold string, predicted string, confidence double")
    assert sum(x.n for x in metrics.confusion(rows).collect()) == 300
    one = metrics.summary(rows).first()
    assert all(0 <= one[c] <= 1 for c in ("observed_macro_f1", "fixed_macro_f1", "weighted_f1", "balanced_accuracy", "abstention_rate"))
    assert metrics.summary(rows.limit(0)).first().n == 0


def test_spans_against_brute_force(spark):
    r = random.Random(3)
    some = [(k % 3, k, a, a + r.randint(0, 40)) for k in range(150) for a in [r.randrange(300)]]
    left, right = spark.createDataFrame(some, "s int, k int, l_start int, l_end int"), spark.createDataFrame(some, "s int, j int, r_start int, r_end int")
    got = sorted((x.k, x.j) for x in spans.overlapping(left, right, "s", 16).collect())
    assert got == sorted((b, f) for a, b, c, d in some for e, f, g, h in some if a == e and c < h and g < d)
    merged = spans.merged(left, "s", "l_start", "l_end").collect()
    for scope in range(3):
        covered = {p for a, _, c, d in some if a == scope for p in range(c, d + 1)}
        assert covered == {p for m in merged if m.s == scope for p in range(m.start, m.end + 1)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102), (200, 300), (300, 250)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200, 250: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    assert graph.folds([(1, 5), (2, 3), (3, 3), (4, 1)], 2) == {1: 0, 2: 1, 3: 1, 4: 0}


def test_greedy_match(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.1), (1, 3, 3, 0.0)], "d int, l int, r int, score double")
    assert sorted((x.l, x.r) for x in spans.greedy_match(rows, "d", "l", "r", "score").collect()) == [(1, 1), (2, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source_id": "s", "content": "x", "available": true}\n\n')
    assert files.json_lines(spark, str(tmp_path / "a.jsonl"), files.SOURCES).first().content == "x"
    (tmp_path / "b.jsonl").write_text('{"source_id": \n')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        files.json_lines(spark, str(tmp_path / "b.jsonl"), files.SOURCES).collect()
    (tmp_path / "r").mkdir()
    for name, data in (("a.md", b"ok"), ("b.exe", b"ok"), ("c.md", b"\xff\xfe"), ("d.md", b"x" * 200)):
        (tmp_path / "r" / name).write_bytes(data)
    got = {x.path.rsplit("/", 1)[1]: x.problem for x in files.reference_files(spark, str(tmp_path / "r"), [".md"], 100).collect()}
    assert got == {"a.md": None, "b.exe": "suffix", "c.md": "not_utf8", "d.md": "too_large"}
    (tmp_path / "c.toml").write_text('threshold = "error"\n[paths]\ninclude = ["a"]\n')
    assert files.config(str(tmp_path / "c.toml"), {"threshold": "x", "paths": {"include": [], "exclude": ["b"]}}) == {"threshold": "error", "paths": {"include": ["a"], "exclude": ["b"]}}
    with pytest.raises(ValueError):
        files.config(str(tmp_path / "c.toml"), {"threshold": "x"})


def test_violations(spark):
    sources = spark.createDataFrame([("s", "u", "some content", "p", "bad", True)], files.SOURCES)
    assert [x.violation for x in files.fixture_violations(sources).collect()] == ["hash_mismatch"]
    base = {c.split()[0]: None for c in files.CASES.split(", ")}
    cases = spark.createDataFrame([tuple((base | {"case_id": i, "claim_text": t, "source_id": s, "gold_evidence_span": g}).values()) for i, t, s, g in [("1", "A b", "s", "content"), ("2", "a  B", "s", "nope"), ("3", "c", "t", None), ("3", "d", "s", None)]], files.CASES)
    assert sorted((x.case_id, x.violation) for x in files.dataset_violations(cases, sources).collect()) == [("1", "duplicate_claim"), ("2", "span_not_in_source"), ("3", "duplicate_id"), ("3", "unknown_source")]


def test_cache_and_rollup(spark):
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, payload int")
    hits, misses = files.cached(spark.createDataFrame([("a",), ("c",)], "cache_key string"), cache)
    assert [x.payload for x in hits.collect()] == [1] and [x.cache_key for x in misses.collect()] == ["c"]
    assert sorted(map(tuple, files.upserted(cache, spark.createDataFrame([("b", 3), ("c", 4)], cache.schema)).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    status = spark.createDataFrame([("x", "failed"), ("x", "ok"), ("y", "failed"), ("z", "ok")], "b string, status string")
    assert {x.b: x.rollup for x in files.rollup_status(status, "b").collect()} == {"x": "partial", "y": "fatal", "z": "complete"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("One 1. Two.", datetime.datetime(2024, 1, 1)), ("One 1. Two.", datetime.datetime(2024, 1, 1)), ("You should go.", datetime.datetime(2024, 1, 2))], "text string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = incremental.score_stream(incremental.document_stream(spark, str(tmp_path / "in"), "text string, at timestamp"), seen_at="at")
    run = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted((x.n_sentences, x.claim_type, x.checkability) for x in spark.table("scored").collect()) == [(1, "factual_statement", "not_checkable"), (2, "numeric_measurement", "checkable")]
