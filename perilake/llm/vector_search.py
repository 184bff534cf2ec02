"""Nearest neighbours by vantage-point trees, one tree per shard.

Vectors are dealt to shards of about ``shard_rows`` rows by a hash of their ids, so shards are even
whatever the vectors are. A shard's task builds one vantage-point tree: a node keeps a vantage point
and, for its two halves by distance from it, the least and largest distance. Blocks of queries
stream through the tree together. By the triangle inequality no point of a half whose distances from
the vantage point lie in [a, b] is nearer to a query at distance d than max(a - d, d - b). A half is
skipped if ``relax`` times that bound exceeds the query's k-th best so far: 1 is exact search,
larger factors prune more. Halves are cut by rank, so equal distances never make a deep tree. Each
shard gives its k best for each query and the k best of all shards are kept.

The queries are a stated set (every ``query_step``-th id) and visit every shard; a task holds one
shard and one batch of queries.

Defined results: rows with a missing id, or a vector that is missing, empty, zero or has missing or
non-finite components take no part. Rows that repeat an id count once, with the vector that sorts
first. Vectors are compared with vectors of the same length. Ties go to the smaller id. An empty
table gives an empty result; fewer than k candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilake.llm.common import column_values, int64, query, table

LEAF = 48
QUERY_BLOCK = 256


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences (not from norms, which lose digits)."""
    apart = points - to
    return np.sqrt((apart * apart).sum(-1))


class Best:
    """The k nearest found so far of each query of a block, ties to the smaller id."""

    def __init__(self, own: np.ndarray, k: int):
        self.own = own
        self.far = np.full((len(own), k), np.inf)
        self.ids = np.full((len(own), k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the given queries: distances (rows, points) and ids (points)."""
        ids = np.broadcast_to(ids, far.shape)
        far = np.where(ids == self.own[rows, None], np.inf, far)
        both, names = np.concatenate((self.far[rows], far), 1), np.concatenate((self.ids[rows], ids), 1)
        names = np.where(np.isinf(both), np.iinfo(np.int64).max, names)
        order = np.lexsort((names, both), axis=1)[:, : self.far.shape[1]]
        self.far[rows] = np.take_along_axis(both, order, 1)
        self.ids[rows] = np.take_along_axis(names, order, 1)

    def limit(self, rows: np.ndarray) -> np.ndarray:
        return self.far[rows, -1]


class VantageTree:
    """Vantage-point tree over the rows of a shard."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, seed: int = 11):
        self.ids, self.points = ids, points
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = rows[self.rng.integers(len(rows))]
        far = distances(self.points[rows], self.points[vantage])
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        half = len(rows) // 2
        near = (far[0], far[half - 1], self._build(rows[:half]))
        rest = (far[half], far[-1], self._build(rows[half:]))
        return vantage, near, rest

    def search(self, best: Best, queries: np.ndarray, relax: float) -> None:
        self._visit(self.root, best, queries, np.arange(len(queries)), relax)

    def _visit(self, node, best: Best, queries: np.ndarray, rows: np.ndarray, relax: float) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                best.offer(rows, distances(self.points[node][None], queries[rows][:, None]), self.ids[node])
            return
        vantage, *halves = node
        far = distances(queries[rows], self.points[vantage])
        first = far <= halves[0][1]
        # Each query sees its own side first, which tightens its limit for the other side.
        for one, other in ((0, 1), (1, 0)):
            mine = first if one == 0 else ~first
            for side in (one, other):
                low, high, child = halves[side]
                bound = np.maximum(low - far[mine], far[mine] - high)
                open_ = relax * np.maximum(bound, 0) <= best.limit(rows[mine])
                self._visit(child, best, queries, rows[mine][open_], relax)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows that take part, as ``id`` and ``vec`` (doubles); repeated ids once."""
    vec = F.col(embedding).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, relax: float = 1.5,
    query_step: int = 100, shard_rows: int = 2048,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest of each query."""
    rows = usable(vectors, vec_id, embedding)
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.size("vec").alias("length"), F.lit(0).alias("asks"), "id", "vec")
    asked = rows.filter(F.pmod("id", F.lit(query_step)) == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    visits = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.size("vec").alias("length"), F.lit(1).alias("asks"), "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree, ids, points = None, None, [], []
        waiting: list[tuple[int, np.ndarray]] = []

        def answer() -> pa.RecordBatch | None:
            nonlocal tree
            if not waiting or not ids:
                waiting.clear()
                return None
            tree = tree or VantageTree(np.array(ids), np.stack(points))
            own = np.array([i for i, _ in waiting])
            best = Best(own, k)
            tree.search(best, np.stack([v for _, v in waiting]), relax)
            waiting.clear()
            at, column = np.nonzero(np.isfinite(best.far))
            return pa.RecordBatch.from_arrays(
                [int64(own[at]), int64(best.ids[at, column]), pa.array(best.far[at, column])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            flat, cuts = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
            for i, (shard, length, asks, name) in enumerate(zip(*(column_values(batch, c) for c in ("shard", "length", "asks", "id")), strict=True)):
                if (shard, length) != here:
                    if (out := answer()) is not None:
                        yield out
                    here, tree, ids, points = (shard, length), None, [], []
                value = flat[cuts[i] : cuts[i + 1]].astype(np.float64)
                if asks:
                    waiting.append((name, value))
                    if len(waiting) >= QUERY_BLOCK and (out := answer()) is not None:
                        yield out
                elif not ids or ids[-1] != name:  # sorted: of a repeated id the first vector counts
                    ids.append(name)
                    points.append(value)
        if (out := answer()) is not None:
            yield out

    placed = dealt.unionByName(visits).repartition(shards, "shard").sortWithinPartitions("shard", "length", "asks", "id", "vec")
    found = placed.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op1_vector_search")
def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
