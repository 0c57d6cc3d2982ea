"""Connected components and fold assignment over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.sources.shared import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint) as rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds. Every round only takes minima per node and joins
    them back, so a node with very many neighbours is pre-aggregated on the map side and its join
    can be split; each round is written to the shared folder. Rounds
    go on until nothing changes, some log(n)**2 of them at most. Nodes without a link are not listed;
    no edges give no rows.
    """
    now = written(_oriented(edges), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _oriented(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(_oriented(stars.unionByName(low.select("a", F.col("m").alias("b")))), "small-star")
        new = _mark(after)
        drop_written(large)
        drop_written(now)
        now = after
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def shared_item_edges(rows: DataFrame, node: str, item: str) -> DataFrame:
    """Edges (a, b) between nodes that share an item: each node to the item's smallest, so an item of n nodes gives n-1 edges."""
    least = rows.groupBy(item).agg(F.min(node).alias("b"))
    return rows.join(least, item).where(F.col(node) != F.col("b")).select(F.col(node).alias("a"), "b").distinct()


def all_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, component) of every node; one without edges is its own component."""
    found = components(edges)
    return nodes.select(F.col(node).alias("node")).distinct().join(found, "node", "left").select(F.col("node").alias(node), F.coalesce("root", "node").alias("component"))


def folds(sizes: list[tuple[int, int]], count: int) -> dict[int, int]:
    """Components (id, size) to folds: the largest first, each to the fold with fewest members, ties to the lower number."""
    load = [0] * count
    out = {}
    for component, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        fold = min(range(count), key=lambda k: (load[k], k))
        out[component] = fold
        load[fold] += size
    return out


def leaking_items(rows: DataFrame, fold: str, item: str) -> DataFrame:
    """Items that occur in more than one fold."""
    return rows.groupBy(item).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def ranked_components(labels: DataFrame) -> DataFrame:
    """Components by (size descending, id) with their rank.

    They are sorted over all tasks; a task's ranks start after the components of those before it.
    """
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("size"), F.asc("component")]
    placed = written(sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a task
    before = {k: sum(n for j, n in counts.items() if j < k) for k in counts}
    base = F.element_at(F.create_map(*(x for k, n in sorted(before.items()) for x in (F.lit(k).cast("bigint"), F.lit(n).cast("bigint")))), part) if before else F.lit(0)
    return placed.select("component", "size", (base + place + 1).alias("rank"))
