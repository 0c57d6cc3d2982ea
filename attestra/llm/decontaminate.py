"""Benchmark decontamination by word-level Wu-Manber multi-pattern search.

A pattern is a window of ``width`` consecutive words of a benchmark item; an item with fewer words
is one shorter pattern. Patterns of one length form a class with a shift table over blocks of two
words (one word in classes of one): it says how far the search may jump when it sees a block, by
the block's last place in any pattern. At shift zero, the bucket of the block's hash lists the
patterns that end with it, and a direct comparison of all words confirms each occurrence.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import field, utf8, written
from attestra.sources.shared import spread

HITS = "n_words bigint, spans array<array<int>>, items array<string>"

#: A-Z to lower case; every other byte up to 0x7F but for 0-9 and a-z parts words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Searches one set of patterns of equal length over words."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.owners: dict[tuple, set[int]] = {}
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple]] = {}

    def add(self, pattern: tuple, owner: int) -> None:
        known = self.owners.get(pattern)
        if known is not None:
            known.add(owner)
            return
        self.owners[pattern] = {owner}
        for end in range(self.block, self.length + 1):
            block, jump = pattern[end - self.block : end], self.length - end
            if jump < self.shift.get(block, self.length):
                self.shift[block] = jump
        self.buckets.setdefault(pattern[self.length - self.block :], []).append(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[int]]]:
        """(start, owners) of every occurrence."""
        m, block, n = self.length, self.block, len(words)
        shift, most = self.shift, self.length - self.block + 1
        end = m
        while end <= n:
            seen = tuple(words[end - block : end])
            jump = shift.get(seen, most)
            if jump:
                end += jump
                continue
            here = tuple(words[end - m : end])
            for pattern in self.buckets[seen]:
                if pattern == here:
                    yield end - m, self.owners[pattern]
                    break
            end += 1


def searchers(items: list[tuple[int, bytes | None]], width: int) -> list[WuManber]:
    """One searcher for each pattern length that the items have."""
    classes: dict[int, WuManber] = {}
    for owner, text in items:
        words = words_of(text)
        size = min(width, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            classes.setdefault(size, WuManber(size)).add(tuple(words[start : start + size]), owner)
    return list(classes.values())


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _blocks(source: DataFrame, width: int, most: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """Items in blocks of at most ``most`` windows (one item at least)."""
    names, texts, held = [], [], 0
    for row in source.toLocalIterator():
        text = row.text.encode()
        size = max(1, len(words_of(text)) - width + 1)
        if names and held + size > most:
            yield names, texts
            names, texts, held = [], [], 0
        names.append(row.item)
        texts.append(text)
        held += size
    if names:
        yield names, texts


def with_hits(rows: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", width: int = 13, block_windows: int = 100_000, blocks_a_scan: int = 4) -> DataFrame:
    """``rows`` (row, text) with ``hits``: (n_words, merged word ``spans`` (start, end) that benchmark windows cover, the ``items`` they come from).

    The benchmark is read in blocks of ``block_windows`` windows, each a broadcast of its own, and a scan
    of the rows searches ``blocks_a_scan`` blocks one after the other; a worker builds each block's
    tables once and holds those of one scan (a window takes about half a kilobyte). A larger benchmark
    takes more scans, between which rows and hits are written, not more memory. Whole texts are searched.

    Null or empty text and text without words: no words, no spans. Null or wordless items match
    nothing; items with equal words all count.
    """
    sc = rows.sparkSession.sparkContext
    source = benchmark.select(field(item_col).cast("string").alias("item"), field(item_text_col).alias("text")).where("item is not null and text is not null")
    found, many = None, 0
    for names, texts in _blocks(source, width, block_windows):
        if found is not None and many % blocks_a_scan == 0:
            rows = written(rows.withColumn("hits", found), "hits")
            found = F.col("hits")
        search = _search_block(sc.broadcast((names, texts)), width, blocks_a_scan)
        found = search("text") if found is None else search("text", found)
        many += 1
    return rows.withColumn("hits", _search_block(sc.broadcast(([], [])), width, 1)("text") if found is None else found)


def _search_block(block, width: int, kept: int):
    """A function of text and, where there are any, the hits of the blocks before."""

    @F.arrow_udf(HITS)
    def search(*given: pa.Array) -> pa.Array:
        names = block.value[0]
        tables = _tables(block, width, kept)
        texts = utf8(given[0])
        before = given[1].to_pylist() if len(given) > 1 else [None] * len(texts)
        counts, spans, items = [], [], []
        for text, old in zip(texts, before, strict=True):
            words = words_of(text)
            covered, owners = (old["spans"], {*old["items"]}) if old else ([], set())
            for table in tables:
                for start, some in table.search(words):
                    if covered and covered[-1][0] <= start <= covered[-1][1]:
                        covered[-1][1] = max(covered[-1][1], start + table.length)
                    else:
                        covered.append([start, start + table.length])
                    owners |= {names[i] for i in some}
            counts.append(len(words))
            spans.append(_merged(covered))
            items.append(sorted(owners))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"])

    return search


#: The search tables that a worker holds, by block.
_HELD: OrderedDict[tuple, tuple[object, list[WuManber]]] = OrderedDict()


def _tables(block, width: int, kept: int) -> list[WuManber]:
    """The search tables of a broadcast block, built once in a worker and held while ``kept`` blocks are in use."""
    key = (id(block), width)
    if key not in _HELD:
        while len(_HELD) >= kept:
            _HELD.popitem(last=False)
        _HELD[key] = block, searchers(list(enumerate(block.value[1])), width)
    _HELD.move_to_end(key)
    return _HELD[key][1]


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", least_share: int = 20, **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated (columns that must not clash), and ``spans`` and ``items``.

    Contaminated: any word is hit and ``least_share * n_hit >= n_words``. ``items_sha256`` is the
    digest of the items' ids, sorted as strings and joined by commas (of the empty string where
    there are none). Nulls as in ``with_hits``; repeated rows stay; an empty benchmark leaves all clean.
    """
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
    if clash := {c.lower() for c in docs.columns} & {*new}:
        raise ValueError(f"documents already have {sorted(clash)}")
    return _judged(docs, benchmark, text_col, least_share, options).select("row.*", *new)


def _judged(docs: DataFrame, benchmark: DataFrame, text_col: str, least_share: int, options: dict) -> DataFrame:
    rows = spread(docs).select(F.struct(*(field(c) for c in docs.columns)).alias("row"), field(text_col).cast("string").alias("text"))
    found = with_hits(rows, benchmark, **options)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("bigint"), lambda s, x: s + (x[1] - x[0]))
    # Spark compares strings by their UTF-8 bytes, which is the order of code points
    items = F.array_sort("hits.items")
    out = found.select("row", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("hits.spans").alias("spans"), items.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", least_share: int = 20, **options) -> DataFrame:
    """``docs`` without its contaminated rows, all columns as they are; nothing is shuffled."""
    return _judged(docs, benchmark, text_col, least_share, options).where("not contaminated").select("row.*")
