import itertools
import random

import numpy as np
import pytest
import xxhash

from attestra.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    codes = [brute_fingerprint(t) for _, t in rows]
    lead = list(range(len(rows)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= 4:
            lead[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(doc, low.get(top(i), doc))
    return sorted(((doc, codes[i], low.get(top(i))) for i, (doc, _) in enumerate(rows)), key=str)


def texts(seed, count):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 60, 200]))] for _ in range(count)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for _ in range(r.choice([0, 1, 5])):
            near = list(words)
            near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append("\n".join(near))
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "A", "a B c", "a b c d", "a b c d e", "é É\x0bx\x1cy z 日本 w"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_long_text_in_slices(monkeypatch):
    text = texts(3, 40)
    whole = " ".join(text)
    expected = brute_fingerprint(whole)
    monkeypatch.setattr(simhash, "_SLICE", 97)
    assert simhash.fingerprint(whole.encode()) == expected


def test_gray_rank_steps_change_one_bit():
    codes = np.arange(4096, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def settled(near):
    """The first member of each connected set of a matrix of links."""
    first = np.arange(len(near))
    while True:
        after = np.where(near, first[None, :], len(near)).min(axis=1)
        if (after == first).all():
            return first
        first = after


@pytest.mark.parametrize("lanes", [1, 3])
@pytest.mark.parametrize("seed", range(4))
def test_index_loses_no_link(seed, lanes):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, (40, lanes), dtype=np.uint64)
    flips = np.array([[sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for _ in range(lanes)] for _ in range(700)], np.uint64)
    codes = np.unique(base[r.integers(0, 40, 700)] ^ flips, axis=0)
    distance = 4 * lanes
    index = simhash.GrayIndex(codes)
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]).sum(axis=2) <= distance
    assert (index.forest(distance) == settled(near)).all()


def test_dense_family_costs_about_its_size(monkeypatch):
    """Pairs of nodes in one set are dropped: comparisons do not grow with the square of a family."""
    r = np.random.default_rng(5)
    compared = []
    real = simhash._apart
    monkeypatch.setattr(simhash, "_apart", lambda a, b: compared.append(len(a)) or real(a, b))
    codes = np.unique(np.array([(1 << int(a)) | (1 << int(b)) | (1 << int(c)) for a, b, c in r.integers(0, 64, (20_000, 3))], np.uint64))
    assert (simhash.GrayIndex(codes).forest(6) == 0).all()
    assert sum(compared) < len(codes) ** 2 / 20


@pytest.mark.parametrize("direct", [1, 48])
def test_components_against_brute_force(spark, monkeypatch, direct):
    rows = [(k, t) for k, t in enumerate(texts(1, 60))]
    rows += [(1000, None), (1001, ""), (None, rows[5][1]), (7, rows[7][1]), (7, rows[9][1]), (2000, " ")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(simhash, "DIRECT", direct)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == brute_components(rows)


@pytest.mark.parametrize("distance,blocks", [(0, 1), (1, 3), (4, 5), (4, 6), (5, 7)])
def test_groups_of_blocks_lose_no_link(spark, distance, blocks):
    r = np.random.default_rng(distance)
    base = r.integers(0, 2**64, 30, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k % 8, replace=False))) for k in range(8)]))
    frame = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp bigint")
    found = simhash.links(frame, distance=distance, blocks=blocks).collect()
    place = {x: k for k, x in enumerate(codes.view(np.int64).tolist())}
    near = np.eye(len(codes), dtype=bool)
    for x in found:
        near[place[x.a], place[x.b]] = near[place[x.b], place[x.a]] = True
    assert (settled(near) == settled(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance)).all()


def brute_wide(text, width=5):
    make = simhash.WideFingerprints(width)
    hashes = make.shingles(text.encode())
    lanes = [[int(simhash._scrambled(np.array([h], np.uint64) + s)[0]) for s in make.steps] for h in hashes]
    bits = [2 * sum(row[k // 64] >> (k % 64) & 1 for row in lanes) > len(lanes) for k in range(64 * simhash.LANES)]
    return sum(b << k for k, b in enumerate(bits)).to_bytes(8 * simhash.LANES, "little")


def test_wide_fingerprint():
    make = simhash.WideFingerprints(5)
    for text in ["a", "one two three", "A b C d e f g", " ".join(f"w{k % 31}" for k in range(90))]:
        assert make.of(text.encode()) == brute_wide(text)
    assert make.of(b"A b") == make.of(b"a  B") and make.of(None) == make.of(b" ") == b""
    assert len(make.shingles(b"a b c d e a b c d e")) == 5 and len(make.shingles(b"a b c d e f g h")) == 4


def jaccard(a, b):
    sets = [{tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} for x in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_of_similarity_are_found(spark):
    """Pairs well over 0.8 are joined, pairs well under it are not, pairs near it mostly as they should be."""
    r = random.Random(9)
    rows, pairs = [], []
    for k in range(400):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 150, 400]))]
        near = list(words)
        for _ in range(r.randrange(1, 1 + len(words) // 18)):
            near[r.randrange(len(near))] = f"x{r.randrange(5000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
        pairs.append((2 * k + 1, jaccard(rows[-2][1], rows[-1][1])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    assert all(2 * k in left for k in range(400))
    share = lambda low, high: [doc not in left for doc, j in pairs if low <= j < high]
    assert np.mean(share(0.86, 1.01)) > 0.99 and len(share(0.86, 1.01)) > 60
    assert np.mean(share(0.8, 1.01)) > 0.93
    assert np.mean(share(0, 0.72)) < 0.03 and len(share(0, 0.72)) > 60


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, id string, fp int, root int, component_id int")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.one_of_each(docs).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e", "x", 1, 1, 1), (1, "a b c d e", "y", 1, 1, 1), (3, None, "z", 1, 1, 1)], docs.schema)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 3]
    assert simhash.one_of_each(docs).columns == docs.columns


def test_one_of_each_keeps_one_row(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "other words in this one text"), (2, "a b c d e"), (None, "quite different words here now"), (None, "quite different words here now")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str) == sorted({(1, "a b c d e"), (1, "other words in this one text"), (None, "quite different words here now")}, key=str)
