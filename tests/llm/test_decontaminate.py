import hashlib
import random
import re

import pytest

from attestra.llm import decontaminate

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            m = min(width, len(p))
            for k in range(len(p) - m + 1 if m and item is not None else 0):
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == p[k : k + m]:
                        hit |= set(range(s, s + m))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(12)] + ["é", "日本", "x_y", "B-c", "It's"]
    passage = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, passage(r.choice([1, 2, 5, 12, 13, 14, 30]))) for k in range(3, 25)] + [(100, None), (101, "-- !"), (None, passage(20)), (102, "w1\nW2, w3")]
    items.append((103, items[4][1]))
    docs = [(k, passage(r.randrange(60))) for k in range(40)]
    docs += [(50 + k, passage(9).upper() + " - " + items[k][1].replace(" ", ",\n") + passage(400 * (k % 2))) for k in range(20)]
    docs += [(90, None), (91, ""), (92, "..."), (None, items[3][1]), (3, docs[3][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, row int").repartition(3)
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id bigint, text string, doc_id string")
    expected = brute(docs, items)
    got = decontaminate.contamination(frame, bench)
    assert sorted((tuple(x) for x in got.select(COLUMNS).collect()), key=str) == expected
    assert sorted((tuple(x) for x in decontaminate.contamination(frame, bench, block_windows=25, blocks_a_scan=2).select(COLUMNS).collect()), key=str) == expected
    clean = decontaminate.without_contaminated(frame, bench)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((x[0] for x in expected if not x[-1]), key=str)
    with pytest.raises(ValueError):
        decontaminate.contamination(frame.withColumnRenamed("row", "spans"), bench)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id string, text string")
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    row = decontaminate.contamination(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.items_sha256, row.contaminated) == (2, 0, hashlib.sha256(b"").hexdigest(), False)


def test_jumps_skip_words():
    table = decontaminate.WuManber(4)
    table.add((b"a", b"b", b"c", b"d"), 1)
    assert table.shift[(b"c", b"d")] == 0 and table.shift[(b"a", b"b")] == 2
    assert [s for s, _ in table.search([b"a", b"b", b"a", b"b", b"c", b"d", b"d"])] == [2]


def test_tables_are_built_once_a_block(monkeypatch):
    built = []
    real = decontaminate.searchers
    monkeypatch.setattr(decontaminate, "searchers", lambda items, width: built.append(len(items)) or real(items, width))
    blocks = [type("Block", (), {"value": (["i"], [b"a b c"])})() for _ in range(6)]
    for _ in range(3):
        for block in blocks:
            assert decontaminate._tables(block, 13, 6)[0].length == 3
    assert built == [1] * 6


def test_blocks_hold_windows(spark):
    rows = [(1, "a " * 40), (2, "b"), (3, None), (4, "c " * 20)]
    source = spark.createDataFrame(rows, "item bigint, text string").where("text is not null")
    assert [len(names) for names, _ in decontaminate._blocks(source, 13, 29)] == [2, 1]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "x " * 300_000 + "one two three")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "one two three")], "item_id bigint, text string")
    row = decontaminate.contamination(docs, bench).first()
    assert (row.n_words, row.n_hit, row.contaminated, row.spans) == (300_003, 3, False, [[300_000, 300_003]])
