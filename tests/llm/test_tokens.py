import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import packing, tokens
from attestra.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, tokens int, file string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,!'sTJ̌́éIİ̇ßΣ<|>9")), max_size=40))
def test_ids_equal_the_library(text):
    from tokenizers import Tokenizer

    global _OWN
    _OWN = globals().get("_OWN") or (Tokenizer.from_file(tokenizer_path()), tokens.WordEncoder(tokenizer_path()))
    own, code = _OWN
    assert np.frombuffer(code.encode(text.encode()), "<u4").tolist() == ids(own, text)


@pytest.mark.parametrize("text", ["Don't stop!! it's'll 12.5%", "a<|endoftext|>b <|startoftext|>", "END.) 'Tis... x,y", "J̌ J̌. Ǆ"])
def test_cases(tokenizer, text):
    assert np.frombuffer(tokens.WordEncoder(tokenizer_path()).encode(text.encode()), "<u4").tolist() == ids(tokenizer, text)


def test_kept_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 5)
    code = tokens.WordEncoder(tokenizer_path())
    for text in ["one two three four five six seven.", "eight nine ten one two, ten", "one one eleven twelve thirteen fourteen"]:
        assert np.frombuffer(code.encode(text.encode()), "<u4").tolist() == ids(tokenizer, text)


def documents():
    r = random.Random(2)
    rows = [(k * 3 % 101, " ".join(r.choice(["alpha", "Béta,", "gamma.", "d", "12", "--"]) for _ in range(r.choice([0, 1, 5, 50])))) for k in range(80)]
    return [*rows, (200, None), (201, ""), (202, "word " * 5000), (500, "twice"), (500, "twice"), (None, "no id")]


def test_files_round_trip(spark, tokenizer, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(6)
    got = tokens.token_round_trip(docs, tokenizer_path()).collect()
    made = sorted([(doc, [*ids(tokenizer, text), 1]) for doc, text in rows], key=lambda x: (x[0] is not None, x[0] or 0))
    starts, expected = 0, []
    for doc, some in made:
        expected.append((doc, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
        starts += len(some)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(expected, key=str)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])])[:-1].tolist()
    assert [r.doc_id for r in ordered] == [d for d, _ in made]


def test_file_layout(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some words {k}", 1, "") for k in range(5000)], SCHEMA)
    tokens.write_token_files(docs, str(tmp_path / "t"), tokenizer_path(), files=1)
    (part,) = (tmp_path / "t").glob("*.parquet")
    meta = pq.ParquetFile(part).metadata
    column = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for n, c in column.items() if n in ("doc_id", "n_tokens"))
    assert "RLE_DICTIONARY" in column["tokens.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    plan = tokens.read_token_files(spark, str(tmp_path / "t")).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan


def test_pieces(spark, tokenizer):
    docs = spark.createDataFrame([(*r, 1, "x") for r in documents()], SCHEMA)
    got = tokens.pieces(docs, tokenizer_path(), capacity=64, with_ids=True).collect()
    for doc, text in documents():
        own = [*ids(tokenizer, text), 0]
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got if r.doc_id == doc})
        assert mine == [(k, s, len(own[s : s + 64]), zlib.crc32(np.array(own[s : s + 64], "<u4").tobytes()), tuple(own[s : s + 64])) for k, s in enumerate(range(0, len(own), 64))]


def naive_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps), sorted(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 50, 2048])
    lengths = [r.randint(1, r.choice([capacity, max(1, capacity // 5)])) for _ in range(r.choice([0, 1, 30, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled, seen = {}, {n: [] for n in counts}
    runs = packing.best_fit_runs(counts, capacity)
    runs.sort()
    for k, (n, rank, first, each, offset) in enumerate(runs):
        until = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
        for at in range(rank, until):
            seen[n].append(at)
            filled.setdefault(first + (at - rank) // each, []).append((offset + (at - rank) % each * n, n))
    assert all(v == list(range(counts[n])) for n, v in seen.items())
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    many, gaps = naive_best_fit(lengths, capacity)
    assert len(filled) == many
    assert sorted(capacity - sum(n for _, n in v) for v in filled.values()) == gaps


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 20)
    r = random.Random(9)
    rows = [(k, 1 if k % 3 == 0 else r.randint(1, 64), "x") for k in range(900)] + [(5, 7, "y"), (5, 7, "y"), (None, 3, "z")]
    items = spark.createDataFrame(rows, "doc_id bigint, length bigint, extra string").repartition(7)
    got = packing.pack(items, order=["doc_id", "extra"], capacity=64).collect()
    assert sorted(((g.doc_id, g.length, g.extra) for g in got), key=str) == sorted(rows, key=str)
    filled = {}
    for g in got:
        filled.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(filled) == naive_best_fit([n for _, n, _ in rows], 64)[0]
    assert packing.pack(items.limit(0), order=["doc_id"]).collect() == []
    for bad in ((1, 65, ""), (1, None, "")):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([bad], items.schema), order=["doc_id"], capacity=64)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], "length int, offset int"), order=["length"])


def test_assemble(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, ""), (2, "d", 1, ""), (3, None, 1, "")], SCHEMA)
    placed = packing.pack(tokens.pieces(docs, tokenizer_path(), with_ids=True, capacity=16), order=["doc_id", "piece"], capacity=16)
    whole = packing.assemble(placed).collect()
    assert len(whole) == 1 and len(whole[0].ids) == 7 and whole[0].n_pieces == 3
