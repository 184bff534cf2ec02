"""Connected components of an edge table, without gathering a component anywhere.

Each partition first replaces its edges by a spanning forest (its memory is bounded by the
partition). Then large-star and small-star steps alternate until nothing changes: every step is an
aggregation that combines before the shuffle and an equality join, so a hub is never one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.common import column_values, durable, forget, int64


class Forest:
    """Union-find over any integers; roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and up != x:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def pairs(self) -> Iterator[tuple[int, int]]:
        """(member, root) of every member that isn't a root."""
        return ((x, self.find(x)) for x in list(self.parent) if self.find(x) != x)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = Forest()
    for batch in batches:
        for a, b in zip(column_values(batch, "u"), column_values(batch, "v"), strict=True):
            trees.union(a, b)
    pairs = list(trees.pairs())
    yield pa.RecordBatch.from_arrays([int64([a for a, _ in pairs]), int64([b for _, b in pairs])], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component."""
    ordered = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    now = durable(ordered.mapInArrow(_forest, "u long, v long").distinct())
    seen = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        after = durable(_small_star(_large_star(now)))
        forget(now)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
