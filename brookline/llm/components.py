"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import broken, lean, written


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over blocks of edges: each block becomes stars around its smallest nodes."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        nodes = [n for n in parent if parent[n] != n]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(parent, n) for n in nodes], pa.int64())], ["a", "b"])

    def find(parent: dict[int, int], n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, parent.setdefault(a, a) and a), find(parent, parent.setdefault(b, b) and b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # memory is bounded; the rounds join what the blocks leave apart
            yield stars(parent)
            parent = {}
    if parent:
        yield stars(parent)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it reaches. edges: a, b as long.

    Each round moves two aggregations and two joins of the edges, written to the shared folder; the
    rounds grow with the logarithm of the longest chain. Minima are pre-aggregated and joined back on a
    key that AQE may split, so a node with very many neighbours doesn't fill one task.
    """
    stars = written(edges.select("a", "b").filter("a <> b").mapInArrow(lean(contract), "a long, b long").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        # Large star: each neighbour above u goes to the least of u and its neighbours.
        both = stars.union(stars.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").withColumn("k", broken(F.col("a").cast("string"))).join(least.select(F.col("a").cast("string").alias("k"), "m"), "k").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large-star")
        # Small star: each node goes to the least of its smaller neighbours, and so do they.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.withColumn("k", broken(F.col("a").cast("string"))).join(least.select("a", F.col("a").cast("string").alias("k"), "m").drop("a"), "k")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        stars = written(small, "small-star")
        before, state = state, stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = stars.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
