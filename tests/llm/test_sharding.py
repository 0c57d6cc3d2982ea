import zlib

import numpy as np
import pytest

from attestra.llm import sharding


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    f = sharding.Feistel(size, 42)
    rows = np.arange(size)
    placed = f.place(rows)
    assert sorted(placed.tolist()) == rows.tolist()
    assert (f.row(placed) == rows).all()
    assert size < 100 or (placed != sharding.Feistel(size, 43).place(rows)).any()


def test_places_look_shuffled():
    placed = sharding.Feistel(10_000, 1).place(np.arange(10_000))
    assert abs(np.corrcoef(np.arange(10_000), placed)[0, 1]) < 0.05
    assert (np.diff(placed) == 1).sum() < 20


SCHEMA = "doc_id bigint, text string, shard string, b int"


def rows():
    return [(k * 7 % 300, f"text {k} é" * (k % 4), "x", k) for k in range(300)] + [(1000, None, "x", 0), (1001, "", "x", 0), (5, "same", "x", 0), (5, "same", "x", 0), (5, "same", "x", 0), (None, "no id", "x", 0), (None, "no id", "x", 0)]


def test_shards(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = sharding.shard(docs.repartition(5), shards=16).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows()), key=str)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(docs.repartition(3), shards=16).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, again)))
    f = sharding.Feistel(len(got), 42)
    assert all(f.row(np.array([r.slot * 16 + r.shard]))[0] == r.row for r in got)


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    with pytest.raises(ValueError):
        sharding.write_shards(docs, str(tmp_path / "a"))
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "b"), shards=4)
    back = spark.read.parquet(str(tmp_path / "b")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((d, t) for d, t, *_ in rows()), key=str)
    assert {r.shard for r in back} == {0, 1, 2, 3}


def test_written_shards_lose_no_row(spark, tmp_path):
    """Rows of equal id and text but other columns all stay, at the places that ``shard`` gives."""
    given = [(5, "same", "a"), (5, "same", "b"), (5, "same", "b"), (None, None, "c"), (None, None, "d"), (6, "x", None), *((k, f"t{k}", "e") for k in range(50))]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, id string")
    sharding.write_shards(docs, str(tmp_path / "w"), shards=4)
    back = spark.read.parquet(str(tmp_path / "w")).collect()
    assert sorted(((r.doc_id, r.text, r.id) for r in back), key=str) == sorted(given, key=str)
    placed = sharding.shard(docs, shards=4).collect()
    assert sorted(((r.doc_id, r.shard, r.slot) for r in back), key=str) == sorted(((r.doc_id, r.shard, r.slot) for r in placed), key=str)


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_TOGETHER", 7)
    docs = spark.range(0, 200).selectExpr("CAST(id % 3 AS bigint) AS doc_id", "CASE WHEN id < 100 THEN 'same' ELSE 'other' END AS text")
    got = sharding.shard(docs, shards=16).collect()
    assert sorted(r.row for r in got) == list(range(200))


def test_empty_is_written(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "w"))
