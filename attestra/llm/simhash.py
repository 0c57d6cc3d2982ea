"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints meet in groups that agree in chosen bits; in a group they are sorted by their rank in
Gray order, which sets close patterns side by side, and a tree is laid over them: a node holds the
bits that all its fingerprints share (a mask and their values), children hold only the bits that
their parent lacks. The search goes down pairs of nodes, adds up the differences between the shared
bits, and drops a pair with everything below it once they exceed the distance. It also drops pairs
of nodes whose fingerprints are all in one set already, so a dense family of near copies costs about
as much as its size. What is left is compared bit by bit. A group returns a spanning forest of its
links, not the links.

Two kinds of groups:

* ``near_duplicates``, for 64 bits and a distance in bits: the bits are cut into six blocks. Two
  fingerprints at most four bits apart agree in two blocks at least, so every fingerprint goes into
  the 15 groups of two blocks each (some 21 bits) and no link is lost.
* ``near_copies``, for a Jaccard similarity of word shingles: the fingerprint has 1024 bits, of which
  two texts differ in a share that their similarity fixes in the mean. It goes into 64 groups of 16
  bits and is compared by the half of its bits that the group's own bits are not in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import words
from attestra.llm.common import components, field, link_roots, type_of, utf8, written
from attestra.sources.shared import spread

LEAF, FAN = 16, 8
#: Groups up to this size are compared directly, many groups at a time.
DIRECT = 48
#: Shingles hashed at a time.
_SLICE = 1 << 16
#: Lanes of 64 bits in the wide fingerprint, and groups it goes into.
LANES, TABLES = 16, 64
#: A join on a component's root is dealt into so many parts, as one component may hold a third of all rows.
SALTS = 64


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split() if text else []
    if not parts:
        return 0
    if len(parts) <= width:
        return xxh64_intdigest(b" ".join(parts), seed)
    line = b" ".join(parts)
    ends, at = [], -1
    for part in parts:
        at += len(part) + 1
        ends.append(at)
    starts = [0, *(x + 1 for x in ends[: len(parts) - width])]
    total, votes = len(starts), np.zeros(64, np.int64)
    for k in range(0, total, _SLICE):
        hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[k : k + _SLICE], ends[k + width - 1 : k + width - 1 + _SLICE], strict=False)], np.uint64)
        votes += _votes(hashes.reshape(-1, 1))
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > total).tolist()))


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of lanes) have each bit, lowest first."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8), axis=1, bitorder="little")
    out = np.zeros(bits.shape[1], np.int64)
    for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
        out += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return out


def _scrambled(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WideFingerprints:
    """SimHashes of 64 * ``LANES`` bits over the set of a text's word shingles."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.steps = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def shingles(self, text: bytes) -> np.ndarray:
        """Hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
        codes, _ = words.of_texts([text.lower()], 5)
        width = min(self.width, len(codes))
        if not width:
            return codes
        run = np.zeros(len(codes) - width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                run = _scrambled(run * np.uint64(31) + codes[k : len(codes) - width + 1 + k])
        return np.unique(run)

    def of(self, text: bytes | None) -> bytes:
        """Empty without words."""
        shingles = self.shingles(text) if text else np.zeros(0, np.uint64)
        if not len(shingles):
            return b""
        votes = np.zeros(64 * LANES, np.int64)
        for k in range(0, len(shingles), _SLICE // 8 // LANES):
            votes += _votes(_scrambled(shingles[k : k + _SLICE // 8 // LANES, None] + self.steps[None, :]))
        return np.packbits(2 * votes > len(shingles), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, text_hash, fp bigint: the fingerprint's bits as a signed number) of every row.

    A-Z are lower-cased; words are parted by ASCII white space. Texts of fewer than ``width`` words
    are one shingle; null, empty and wordless texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width, seed) for x in utf8(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "text_hash", "fp"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {type_of(docs, id_col)}, text_hash bigint, fp bigint")


def wide_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, text_hash, fp bigint, code binary) of every row; ``fp`` numbers the codes and is 0 without words, as the code is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        make = WideFingerprints(width)
        for batch in batches:
            codes = [make.of(x) for x in utf8(batch.column(2))]
            names = np.array([xxh3_64_intdigest(x) if x else 0 for x in codes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(codes, pa.binary())], names=["id", "text_hash", "fp", "code"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {type_of(docs, id_col)}, text_hash bigint, fp bigint, code binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = field(text_col).cast("string")
    return spread(docs).select(field(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of 64-bit codes in reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class GrayIndex:
    """Tree of masked bit patterns over fingerprints (rows of 64-bit lanes) sorted by Gray rank."""

    def __init__(self, codes: np.ndarray) -> None:
        codes = codes.reshape(len(codes), -1)
        self.order = np.lexsort([gray_rank(codes[:, k]) for k in range(codes.shape[1])][::-1])
        self.codes = codes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask of shared bits, their values), leaves first
        self.cuts: list[np.ndarray] = []  # the first fingerprint of each node
        ones, some, first, step = self.codes, self.codes, np.arange(len(codes)), LEAF
        while True:
            at = np.arange(0, len(ones), step)
            ones, some, first = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at), first[at]
            self.levels.append((~(ones ^ some), ones))
            self.cuts.append(first)
            if len(ones) <= FAN:
                break
            step = FAN

    def forest(self, distance: int) -> np.ndarray:
        """The first member (by place in ``codes``) of each fingerprint's set of linked fingerprints."""
        n, top = len(self.codes), len(self.levels) - 1
        parent = np.arange(n)
        left, right = np.triu_indices(len(self.levels[top][0]))
        none = np.zeros(len(left), np.int64), np.zeros((len(left), self.codes.shape[1]), np.uint64)
        todo = [(top, left, right, *self._differ(top, left, right, *none))]
        sets = self._sets(parent)
        while todo:
            level, left, right, spent, shared = todo.pop()
            low, high = sets[level]
            keep = (spent <= distance) & ~((low[left] == high[left]) & (low[right] == high[right]) & (low[left] == low[right]))
            left, right, spent, shared = left[keep], right[keep], spent[keep], shared[keep]
            if not len(left):
                continue
            if len(left) > 1024:  # the closest nodes last, which are taken first
                turn = np.argsort(left - right, kind="stable")
                todo += [(level, left[x], right[x], spent[x], shared[x]) for x in np.array_split(turn, -(-len(turn) // 1024))]
                continue
            if level:
                a, b, k = self._below(left, right, FAN, len(self.levels[level - 1][0]))
                todo.append((level - 1, a, b, *self._differ(level - 1, a, b, spent[k], shared[k])))
                continue
            a, b, _ = self._below(left, right, LEAF, n)
            near = (a != b) & (parent[a] != parent[b])
            a, b = a[near], b[near]
            near = _apart(self.codes[a], self.codes[b]) <= distance
            if near.any():
                link_roots(parent, a[near], b[near])
                sets = self._sets(parent)
        return parent

    def _sets(self, parent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and the greatest set of each node's fingerprints: a node in one set has both alike."""
        return [(np.minimum.reduceat(parent, at), np.maximum.reduceat(parent, at)) for at in self.cuts]

    def _differ(self, level: int, left, right, spent, shared):
        """Add the differences in the bits that this level shares beyond those already counted."""
        mask, value = self.levels[level]
        both = mask[left] & mask[right]
        return spent + np.bitwise_count((value[left] ^ value[right]) & both & ~shared).sum(axis=1, dtype=np.int64), both | shared

    @staticmethod
    def _below(left, right, fan: int, many: int):
        """All pairs of children of the pairs of nodes, each once, and the pair each is from."""
        i, j = (x.ravel() for x in np.indices((fan, fan)))
        a, b = (left[:, None] * fan + i).ravel(), (right[:, None] * fan + j).ravel()
        ok = (a < many) & (b < many) & (a <= b)
        return a[ok], b[ok], np.repeat(np.arange(len(left)), fan * fan)[ok]


def _linked(groups: DataFrame, distance: int, lanes: int) -> DataFrame:
    """Spanning links (a, b) between the fingerprints ``fp`` of each group that are at most ``distance`` bits apart.

    ``groups``: (block int, value bigint, fp bigint[, code binary of ``lanes`` lanes; without it ``fp`` is the code]).
    """
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(parts, "block", "value").sortWithinPartitions("block", "value")
    wide = "code" in groups.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sizes, names, codes in _groups(batches, lanes, wide):
            starts = np.cumsum(sizes) - sizes
            parent = np.arange(len(names))
            small = np.repeat(sizes <= DIRECT, sizes)
            last = np.repeat(starts + sizes, sizes)  # where a fingerprint's group ends
            rows = np.flatnonzero(small)
            for step in range(1, DIRECT):
                rows = rows[rows + step < last[rows]]
                if not len(rows):
                    break
                near = rows[_apart(codes[rows], codes[rows + step]) <= distance]
                if len(near):
                    link_roots(parent, near, near + step)
            for at, size in zip(starts[sizes > DIRECT].tolist(), sizes[sizes > DIRECT].tolist(), strict=True):
                index = GrayIndex(codes[at : at + size])
                parent[at + index.order] = at + index.order[index.forest(distance)]
            linked = np.flatnonzero(parent != np.arange(len(names)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[parent[linked]])], names=["a", "b"])

    return dealt.mapInArrow(search, "a bigint, b bigint").where("a != b")


def _groups(batches: Iterator[pa.RecordBatch], lanes: int, wide: bool, together: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole groups, many at a time: their sizes, and the names and codes of their members. Groups of one are left out."""
    held: list[tuple[np.ndarray, ...]] = []
    size, limit = 0, together

    def parted(last: bool):
        keys, names, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        end = len(keys) if last else int(cuts[-1]) if len(cuts) else 0  # the last group may go on
        held.clear()
        if end < len(keys):
            held.append((keys[end:], names[end:], codes[end:]))
        sizes = np.diff(np.concatenate([[0], cuts[cuts < end], [end]])) if end else np.zeros(0, np.int64)
        some = np.repeat(sizes > 1, sizes)
        return sizes[sizes > 1], names[:end][some], codes[:end][some]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()], axis=1)
        names = batch.column(2).to_numpy()
        codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, lanes) if wide else names.view(np.uint64).reshape(-1, 1)
        held.append((keys, names, codes))
        size += len(names)
        if size >= limit:
            yield parted(False)
            size = sum(len(x[1]) for x in held)
            limit = max(together, 2 * size)  # a group that goes on is not joined up again for every batch
    if held:
        yield parted(True)


def links(distinct: DataFrame, *, distance: int = 4, blocks: int = 6) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` at most ``distance`` bits apart.

    ``distance`` differing bits spoil as many of the ``blocks`` at most, so two such fingerprints agree
    in all the blocks of one choice of ``blocks - distance`` of them. ``blocks`` must exceed ``distance``.
    """
    if not 0 <= distance < blocks <= 64:
        raise ValueError("blocks must exceed distance and be 64 at most")
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    spread_out = F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("value")) for k, m in enumerate(signed)))
    return _linked(distinct.select(F.inline(spread_out), "fp").select("block", "value", "fp"), distance, 1)


def differing_share(similarity: float) -> float:
    """The mean share of bits in which SimHashes of two sets of one size differ, by their Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_links(distinct: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """Spanning links (a, b) between distinct wide fingerprints (fp, code) that differ in no more bits than texts of ``similarity`` do in the mean."""
    half = LANES // 2 * 8
    value = lambda k: F.conv(F.hex(F.substring("code", 2 * k + 1, 2)), 16, 10).cast("bigint")
    spread_out = F.array(*(F.struct(F.lit(k).alias("block"), value(k).alias("value"), F.lit(half + 1 if k < TABLES // 2 else 1).alias("from")) for k in range(TABLES)))
    rows = distinct.where("code != X''").select(F.inline(spread_out), "fp", "code").select("block", "value", "fp", F.substring("code", F.col("from"), F.lit(half)).alias("code"))
    return _linked(rows, math.floor(differing_share(similarity) * 64 * LANES // 2), LANES // 2)


def _rooted(each: DataFrame, found: DataFrame, best: str) -> DataFrame:
    """(fp, root, best of the component) for the rows (fp, best) of ``each``, given their links' components (node, root).

    Only fingerprints with links are joined with their component's row, dealt by salt.
    """
    linked = written(each.join(found.withColumnRenamed("node", "fp"), "fp"), "linked")
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    lowest = linked.groupBy("root").agg(F.min(best).alias("lowest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    led = linked.withColumn("salt", salt).join(lowest, ["root", "salt"]).select("fp", "root", "lowest")
    return written(each.join(led, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("lowest", best).alias(best)), "rooted")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """(id, fp, root, component_id) of every row.

    Rows are in one component if a chain of fingerprints at most ``distance`` bits apart joins them;
    ``component_id`` is the component's smallest id (null only if all its ids are null), ``root`` its
    smallest fingerprint as a signed number. Repeated rows stay and share a component; so do all
    texts without words. No rows give no rows; other columns are not carried.
    """
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width).select("id", "fp"), "fingerprints")
    each = marked.groupBy("fp").agg(F.min("id").alias("component_id"))
    found = components(written(links(each.select("fp"), distance=distance, blocks=blocks), "links"))
    rooted = _rooted(each, found, "component_id")
    return marked.join(rooted, "fp").select(F.col("id").alias(id_col), "fp", "root", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id; all columns stay as they are.

    Near copies are texts whose sets of ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more by their fingerprints, and texts that a chain of such joins. Texts without
    words are one group. A null id comes after all others; of rows of one id in a group the one with
    the smallest hash of its text stays, and one of rows equal in id and text.
    """
    marked = written(wide_fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("without"), "id", "text_hash")
    each = marked.groupBy("fp").agg(F.min(first).alias("best"))
    codes = marked.groupBy("fp").agg(F.first("code").alias("code"))
    found = components(written(wide_links(codes, similarity=similarity), "links"))
    keep = _rooted(each, found, "best").groupBy("root").agg(F.min("best").alias("best"))
    keep = keep.select(F.col("best.id").alias("kept_id"), F.col("best.text_hash").alias("kept_hash")).distinct()
    rows = docs.select(F.struct(*(field(c) for c in docs.columns)).alias("row"), field(id_col).alias("id"), F.xxhash64(field(text_col).cast("string")).alias("text_hash"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")))
    return kept.dropDuplicates(["id", "text_hash"]).select("row.*")
