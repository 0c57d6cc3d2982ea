"""Bulk-synchronous best-fit packing of documents into sequences of a fixed capacity.

Documents and the gaps of open sequences are kept range-sorted by length. A superstep takes the
longest documents still to place, all of one length at once. Its successor sweep goes up the gaps
from the first that is long enough; a gap takes as many of them as fit. Documents that want the
same gaps are told apart by rank: those of the step are numbered, and the r-th place in the order of
the sweep goes to the r-th document. Then the gaps are updated and the next step follows. Documents
left over open new sequences. As a step places every document of its length, the result is that of
best-fit decreasing over all documents.

Equal lengths and equal gaps are held as runs (first rank or sequence, how many), so what a step
reads and writes is bounded by the capacity, not by the documents: at most one run of documents per
length, and a step splits one run of gaps at most. The runs stay on the driver; the documents never
leave the executors, which number them per length and look their places up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from attestra.llm.common import field, written

#: Rows of one length that one task numbers, about.
RANKED_TOGETHER = 200_000


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place ``counts[length]`` documents of each length: (length, first rank, first sequence, documents a sequence, offset) per run."""
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), ascending
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        changed: list[tuple[int, int, int]] = []
        at = bisect_left(gaps, (length, -1, -1))
        taken = at
        while left and taken < len(gaps):
            gap, first, many = gaps[taken]
            each = gap // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - gap))
                changed.append((gap - each * length, first, full))
                rank, left = rank + full * each, left - full * each
            if full < many and left:
                runs.append((length, rank, first + full, each, capacity - gap))
                changed.append((gap - left * length, first + full, 1))
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                changed.append((gap, first + full, many - full))
            taken += 1
        gaps[at:taken] = []
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            runs.append((length, rank, opened, each, 0))
            if full:
                changed.append((capacity - each * length, opened, full))
            if rest:
                changed.append((capacity - rest * length, opened + full, 1))
            opened += full + bool(rest)
        for gap in changed:
            if gap[0]:
                insort(gaps, gap)
    return runs


def pack(items: DataFrame, *, length_col: str = "length", order: list[str], capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to items of 1 to ``capacity`` tokens.

    ``order`` names the columns that fix an item's rank among those of its length; items equal in
    all of them share their places in any order. Items are written to the shared folder first, so
    that ranks and counts come from the same rows. Items of null or out-of-range length are an
    error; no items give no rows. Columns of ``items`` are kept; new ones must not clash.
    """
    if clash := {"sequence_id", "offset"} & {c.lower() for c in items.columns}:
        raise ValueError(f"items already have {sorted(clash)}")
    names, schema = items.columns, items.schema
    packed = items.select(F.struct(*(field(c) for c in names)).alias("row"), field(length_col).alias("length"), *(field(c).alias(f"key{k}") for k, c in enumerate(order)))
    packed = written(packed, "pack-items")
    keys, length = [f"key{k}" for k in range(len(order))], F.col("length")
    total, bad = packed.agg(F.count(F.lit(1)), F.count_if(length.isNull() | (length < 1) | (length > capacity))).first()
    if bad:
        raise ValueError(f"{bad} items have no length from 1 to {capacity}")
    parts = max(16, -(-total // RANKED_TOGETHER))
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    sizes = packed.groupBy("length", part.alias("part")).count()
    sizes = written(sizes.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")), "pack-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # a row for each length
    place = items.sparkSession.sparkContext.broadcast(_table(best_fit_runs(counts, capacity)))  # bounded by capacity

    ranked = packed.withColumn("part", part)
    window = Window.partitionBy("length", "part").orderBy(*keys)
    ranked = ranked.withColumn("rank", F.row_number().over(window) - 1).join(sizes.drop("count"), ["length", "part"])
    ranked = ranked.select("row.*", F.col("length").cast("bigint").alias("length"), (F.col("base") + F.col("rank")).alias("rank"))
    ranked = ranked.toDF(*(f"c{k}" for k in range(len(names) + 2)))  # the items' own columns can have any names

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = place.value
        for batch in batches:
            lengths, ranks = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(runs["key"], lengths.astype(np.int64) * runs["span"] + ranks, "right") - 1
            within = ranks - runs["rank"][at]
            sequence = runs["sequence"][at] + within // runs["each"][at]
            offset = runs["offset"][at] + within % runs["each"][at] * lengths
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, StructType([*schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def _table(runs: list[tuple]) -> dict:
    """The runs as columns, ascending by length and rank; a run's key is length * span + rank."""
    rows = np.array(sorted((r[0], r[1], r[2], r[3], r[4]) for r in runs), np.int64).reshape(-1, 5)
    span = int(1 << 50)  # over any number of documents of one length
    return {"key": rows[:, 0] * span + rows[:, 1], "span": span, "rank": rows[:, 1], "sequence": rows[:, 2], "each": rows[:, 3], "offset": rows[:, 4]}


def assemble(placed: DataFrame, *, ids_col: str = "ids", capacity: int = 2048) -> DataFrame:
    """The packed sequences: (sequence_id, ids array<int>, n_pieces), from placed pieces that carry their ids.

    A sequence holds at most ``capacity`` ids, so a group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", field(ids_col).alias("ids"))))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"), F.count("*").alias("n_pieces"))
