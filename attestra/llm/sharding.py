"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to n-1 by their content alone, the number goes through a keyed Feistel network
over the smallest power of two that holds n, and walks along its cycle until it is below n again.
The result modulo the shard count is the shard and the quotient the slot, so counts differ by one at
most, slots have no gap, and either direction can be computed without a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import field, type_of, written
from attestra.sources.shared import drop_written

_ROUNDS = 8
_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """One step of the splitmix64 finalizer, for the round keys."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


class Feistel:
    """A permutation of 0 to size-1, and back."""

    def __init__(self, size: int, seed: int) -> None:
        bits = max(2, (size - 1).bit_length())
        self.size, self.right = size, bits // 2
        self.left = bits - self.right
        self.keys = [_mixed(seed * _ROUNDS + k & _MASK) for k in range(_ROUNDS)]

    @staticmethod
    def _scramble(half: np.ndarray, key: int, bits: int) -> np.ndarray:
        x = (half + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return (x ^ x >> np.uint64(29)) >> np.uint64(64 - bits)

    def _forward(self, x: np.ndarray) -> np.ndarray:
        a, b = self.left, self.right
        left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
        for key in self.keys:  # halves swap places and widths
            left, right = right, left ^ self._scramble(right, key, a)
            a, b = b, a
        return left << np.uint64(b) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        a, b = self.left, self.right
        left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
        for key in reversed(self.keys):
            left, right = right ^ self._scramble(left, key, b), left
            a, b = b, a
        return left << np.uint64(b) | right

    def _walk(self, step, x: np.ndarray) -> np.ndarray:
        out = step(x.astype(np.uint64))
        beyond = np.flatnonzero(out >= self.size)
        while beyond.size:
            out[beyond] = step(out[beyond])
            beyond = beyond[out[beyond] >= self.size]
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        return self._walk(self._forward, row)

    def row(self, place: np.ndarray) -> np.ndarray:
        return self._walk(self._back, place)


#: What fixes a row's number: its bucket, then these.
ORDER = ["id", "size", "text_crc32", "text_hash"]
#: Equal rows numbered from one generated array.
_TOGETHER = 65_536


def _keys(docs: DataFrame, id_col: str, text_col: str, buckets: int, *more: Column) -> DataFrame:
    text = F.coalesce(field(text_col).cast("string"), F.lit(""))
    rows = docs.select(field(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), *more)
    return rows.withColumn("b", F.pmod(F.xxhash64("id", "text_hash"), F.lit(buckets)).cast("int"))  # null ids too are dealt by their texts


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """(id, size, text_crc32, text_hash, row, shard, slot) for every row.

    ``size`` is the text's UTF-8 bytes plus one. Row numbers go by a hash bucket of id and text, then
    id, size and checksums; rows equal in all of these are counted before they meet and numbered in a
    row. The driver reads one count for each bucket. Null text has size 1 and the checksum of no
    bytes; null ids are a value like any other; no rows give no rows; other columns are not carried.
    """
    each = written(_keys(docs, id_col, text_col, buckets).groupBy("b", *ORDER).agg(F.count(F.lit(1)).alias("many")), "shard-rows")
    counts = np.zeros(buckets, np.int64)
    for r in each.groupBy("b").agg(F.sum("many").alias("n")).collect():
        counts[r.b] = r.n
    total, bases = int(counts.sum()), np.cumsum(counts) - counts
    upto = F.sum("many").over(Window.partitionBy("b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    numbered = each.withColumn("upto", upto).withColumn("from", F.explode(F.sequence(F.col("upto") - F.col("many"), F.col("upto") - 1, F.lit(_TOGETHER).cast("bigint"))))
    numbered = numbered.select(*ORDER, "b", F.explode(F.sequence("from", F.least(F.col("from") + _TOGETHER, F.col("upto")) - 1)).alias("within"))
    names = [*ORDER, "row", "shard", "slot"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permuted = Feistel(max(1, total), seed)
        for batch in batches:
            row = bases[batch.column(4).to_numpy()] + batch.column(5).to_numpy()
            at = permuted.place(row)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(row), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=names)

    made = numbered.mapInArrow(place, f"id {type_of(docs, id_col)}, size bigint, text_crc32 bigint, text_hash bigint, row bigint, shard int, slot bigint")
    return made.withColumnRenamed("id", id_col)


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 42, buckets: int = 4096, rows_a_file: int = 1_000_000) -> None:
    """Write the rows to ``path`` as Parquet, one folder per shard, files and rows in slot order.

    All rows and columns are kept, ``shard`` and ``slot`` added; they must not clash. Rows are sorted
    over all tasks in the order of ``shard``'s row numbers, so they get the places that it gives;
    rows equal in id and text share theirs in the order they are read in.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"documents already have {sorted(clash)}")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["b", *ORDER, "read"]
    rows = _keys(docs, id_col, text_col, buckets, F.struct(*(field(c) for c in docs.columns)).alias("data"), F.monotonically_increasing_id().alias("read"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("data", F.monotonically_increasing_id().alias("at"))
    dealt = written(dealt, "shard-sorted")  # the upper bits of ``at`` number the partition, the lower 33 the row in it
    part = F.shiftright("at", 33)
    counts = {r.part: r.n for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bases = np.zeros(max(counts, default=0) + 1, np.int64)
    for k in sorted(counts)[:-1]:
        bases[k + 1 :] += counts[k]
    total = sum(counts.values())

    @F.arrow_udf("shard int, slot bigint")
    def place(at: pa.Array) -> pa.Array:
        found = at.to_numpy()
        where = Feistel(max(1, total), seed).place(bases[found >> 33] + (found & ((1 << 33) - 1)))
        return pa.StructArray.from_arrays([pa.array((where % shards).astype(np.int32)), pa.array(where // shards)], names=["shard", "slot"])

    out = dealt.withColumn("place", place("at")).select("data.*", "place.shard", "place.slot")
    out = out.repartition(max(shards, parts), "shard", F.floor(F.col("slot") / rows_a_file))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    drop_written(dealt)
