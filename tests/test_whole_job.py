"""Queries that must cover their whole input, on fixtures that a filter, prefix or cap would cut."""

from attestra.plans import registry


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_components_cover_every_order(spark, tmp_path):
    items = [(1, 10), (20, 10), (20, 11), (33, 11), (33, 12), (40, 13), (47, 13), (60, 12), (7, 14), (8, 14), (9, 15), (9, 15)]
    put(spark, tmp_path, "lineitem", items, "l_orderkey bigint, l_partkey bigint")
    root = {o: o for o, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, p in items:
        for b, q in items:
            if p == q:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = registry.QUERIES["grf1_components"](spark, str(tmp_path)).collect()
    assert len(got) == len(root)
    assert {x.l_orderkey: x.component for x in got} == {o: find(o) for o in root}


def test_markdown_parses_whole_texts(spark, tmp_path):
    text = "One plain sentence. " * 40 + "\n\nSee [late](https://e.example/late) and [two][key].\n\n[key]: https://e.example/key\n\nLast words."
    put(spark, tmp_path, "documents", [(1, text)], "doc_id bigint, text string")
    blocks = registry.QUERIES["par2_markdown"](spark, str(tmp_path)).collect()
    assert any(x.plain_text == "Last words." for x in blocks)
    assert max(len(x.raw_text) for x in blocks) >= 799
    cites = {x.destination for x in registry.QUERIES["par4_citations"](spark, str(tmp_path)).collect()}
    assert {"https://e.example/late", "https://e.example/key"} <= cites


def test_greedy_match_covers_every_turn_and_sentence(spark, tmp_path):
    says = [[f"w{t}x{k} shared{k}." for k in range(9 + t)] for t in range(12)]
    put(spark, tmp_path, "conversations", [(c, t, " ".join(says[t])) for c in (1, 2) for t in range(12)], "conv_id bigint, turn int, text string")
    got = sorted(tuple(x) for x in registry.QUERIES["jn14_greedy_match"](spark, str(tmp_path)).select("conv", "turn", "l", "r", "score").collect())
    assert got == [(c, t, k, k, 0.5) for c in (1, 2) for t in range(11) for k in range(9 + t)]


def test_tokens_count_every_language(spark, tmp_path):
    put(spark, tmp_path, "documents", [(1, "en", "one two"), (2, "de", "zwei two"), (3, "fr", "deux"), (4, None, "two")], "doc_id bigint, lang string, text string")
    assert {x.term: x.n for x in registry.QUERIES["par17_tokens"](spark, str(tmp_path)).collect()} == {"one": 1, "two": 3, "zwei": 1, "deux": 1}


def test_subsets_cover_every_order(spark, tmp_path):
    put(spark, tmp_path, "lineitem", [(1, 5), (299, 5), (299, 6), (300, 5), (300, 6), (1000, 7), (1000, 8), (1000, 7)], "l_orderkey bigint, l_partkey bigint")
    got = sorted((x.l_orderkey, x.subset) for x in registry.QUERIES["par24_subsets"](spark, str(tmp_path)).collect())
    assert got == [(1, "5"), (299, "5"), (299, "5,6"), (299, "6"), (300, "5"), (300, "5,6"), (300, "6"), (1000, "7"), (1000, "7,8"), (1000, "8")]
