"""Hard negatives by Four-Russians scoring: exact integer inner products from table lookups.

A component x becomes the whole number floor(scale * x). For each group of eight dimensions an anchor
has a table of its 256 subset sums, built by doubling. A candidate's components are cut into
bit planes (two's complement), and each plane's eight bits of a group are one byte. The byte is the
index into the group's table, so a plane's share of the score is one lookup a group; the planes are
joined from the highest down by shifting and adding, the sign plane with a minus. That gives the full
score, not a bound. A block of anchors shares the lookups: a table row holds the block's sums side
by side.

Anchors and candidates meet in cells of at most about ``anchor_rows`` by ``shard_rows`` rows, dealt by a
hash of the id, so no label, vector or id makes a cell large and a task holds one shard of
candidates and a few hundred anchors at a time. A first pass scores an anchor against the
candidates of its own label and finds its positives; the second scores it against the others and
keeps the first few of each positive's score window. Both emit at most a few rows an anchor and cell.

Defined results: rows with a missing id or label, or a vector that is missing or has missing or
non-finite components, take no part. Rows that repeat an id count once, with the label (as it is
after ``shift_every``) and vector that sort first. Vectors meet vectors of the same length only; empty
ones score 0. Scores are exact while they fit a long; components saturate at 2 ** 62. Ties go to the
smaller id. An anchor without a positive, or a positive without a negative in its window, gives no
row; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilake.llm.common import column_values, int64, query, table
from perilake.session import durable, reducers

ANCHOR_BLOCK = 128  # anchors that share a table row: eight groups of 256 rows of 512 bytes stay in the cache
CANDIDATE_BLOCK = 4096
WAITING = 1024  # anchors a task gathers before it scores them
MOST_TASKS = 20_000


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in double precision, as longs."""
    return np.clip(np.floor(scale * vectors.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def plane_bytes(values: np.ndarray) -> np.ndarray:
    """Bytes (planes, groups, rows) of the values' two's complement, lowest plane first, sign plane last."""
    rows, dims = values.shape
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    planes = max(low.bit_length() if low >= 0 else (low + 1).bit_length(), high.bit_length()) + 1
    padded = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = values
    bits = [np.packbits((padded >> k & 1).astype(np.uint8), axis=1, bitorder="little").T for k in range(planes)]
    return np.ascontiguousarray(np.stack(bits))


def subset_sums(anchors: np.ndarray, planes: int) -> np.ndarray:
    """Tables (groups, 256, anchors): the sum of the anchor's components at the set bits of the index."""
    count, dims = anchors.shape
    groups = -(-dims // 8)
    padded = np.zeros((count, groups * 8), np.int64)
    padded[:, :dims] = anchors
    largest = float(np.abs(padded.astype(np.float64)).sum(1).max(initial=0)) * 2.0**planes
    sums = np.zeros((groups, 256, count), np.int32 if largest < 2**31 else np.int64)
    for bit in range(8):
        half = 1 << bit
        sums[:, half : 2 * half] = sums[:, :half] + padded[:, bit::8].T.astype(sums.dtype)[:, None]
    return sums


def lookup_scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Scores (candidates, anchors) from the anchors' tables and the candidates' plane bytes."""
    shape = (planes.shape[2], sums.shape[2])
    total, looked = np.zeros(shape, sums.dtype), np.empty(shape, sums.dtype)
    for k in range(len(planes) - 1, -1, -1):
        if k < len(planes) - 1:
            np.left_shift(total, 1, out=total)
        for group, index in zip(sums, planes[k], strict=True):
            np.take(group, index, axis=0, out=looked, mode="clip")
            (np.subtract if k == len(planes) - 1 else np.add)(total, looked, out=total)
    return total


class Shard:
    """Candidates of one cell and vector length, by id; the plane bytes of all of them."""

    def __init__(self, ids: list, labels: list, values: np.ndarray):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.planes = plane_bytes(values)
        self.of_label = {int(x): np.flatnonzero(self.labels == x) for x in np.unique(self.labels)}

    def scored(self, anchors: np.ndarray, rows: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (candidate rows, scores as anchors by candidates)."""
        sums = subset_sums(anchors, len(self.planes))
        rows = np.arange(len(self.ids)) if rows is None else rows
        for start in range(0, len(rows), CANDIDATE_BLOCK):
            part = rows[start : start + CANDIDATE_BLOCK]
            yield part, np.ascontiguousarray(lookup_scores(sums, self.planes[:, :, part]).T)


def firsts(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    ordered = groups[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < k]


def positives_of(shard: Shard, own: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int):
    """(anchor row, candidate id, score) of the k first other candidates of each anchor's label."""
    for label in np.unique(labels):
        rows = shard.of_label.get(int(label))
        mine = np.flatnonzero(labels == label)
        if rows is None:
            continue
        for start in range(0, len(mine), ANCHOR_BLOCK):
            block = mine[start : start + ANCHOR_BLOCK]
            found = []
            for part, scores in shard.scored(anchors[block], rows):
                scores = np.where(shard.ids[part][None] == own[block][:, None], np.iinfo(scores.dtype).min, scores)
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(1)
                at, column = np.nonzero((scores >= least[:, None]) & (shard.ids[part][None] != own[block][:, None]))
                names, value = shard.ids[part][column], scores[at, column].astype(np.int64)
                keep = firsts(at, value, names, k)
                found.append((at[keep], value[keep], names[keep]))
            at, value, names = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = firsts(at, value, names, k)
            yield block[at[keep]], names[keep], value[keep]


def negatives_of(shard: Shard, labels: np.ndarray, anchors: np.ndarray, positives: list, low: int, high: int, k: int):
    """(anchor row, number of the positive, candidate id, score) of the k first of each positive's window.

    A score s is in the window of a positive score p if low * p <= 100 * s <= high * p.
    """
    for start in range(0, len(anchors), ANCHOR_BLOCK):
        block = np.arange(start, min(start + ANCHOR_BLOCK, len(anchors)))
        windows = [[(-(-low * p // 100), high * p // 100) for p in positives[i]] for i in block]
        floor = np.array([min(w[0] for w in each) for each in windows])[:, None]
        ceiling = np.array([max(w[1] for w in each) for each in windows])[:, None]
        found = []
        for part, scores in shard.scored(anchors[block], None):
            fits = (scores >= floor) & (scores <= ceiling) & (shard.labels[part][None] != labels[block][:, None])
            at, column = np.nonzero(fits)
            names, value = shard.ids[part][column], scores[at, column].astype(np.int64)
            order = np.lexsort((names, -value, at))
            at, names, value = at[order], names[order], value[order]
            cuts = np.searchsorted(at, np.arange(len(block) + 1))
            for i, each in enumerate(windows):
                mine = value[cuts[i] : cuts[i + 1]]
                if not len(mine):
                    continue
                for j, (least, most) in enumerate(each):
                    first = int(np.searchsorted(-mine, -most))
                    last = min(first + k, int(np.searchsorted(-mine, -least, side="right")))
                    if first < last:
                        span = slice(cuts[i] + first, cuts[i] + last)
                        found.append((np.full(last - first, block[i]), np.full(last - first, j), names[span], value[span]))
        if found:
            at, number, names, value = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = firsts(at * (1 + max(len(p) for p in positives)) + number, value, names, k)
            yield at[keep], number[keep], names[keep], value[keep]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str, shift_every: int, classes: int) -> DataFrame:
    """Rows that take part, as ``id``, ``label`` (shifted where the id is divisible by ``shift_every``) and ``vec``."""
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    shifted = F.when(F.pmod("id", F.lit(shift_every)) == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")) if shift_every else F.col("label")
    return rows.withColumn("label", shifted)


def hard_negatives(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", anchor_step: int = 50,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, shift_every: int = 0, classes: int = 10,
    shard_rows: int = 65_536, anchor_rows: int = 16_384,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor and positive."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding, label, shift_every, classes)
    first = F.min(F.struct("label", "vec"))
    anchors = durable(rows.filter(F.pmod("id", F.lit(anchor_step)) == 0).groupBy("id").agg(first.alias("r")).select("id", "r.*"))
    total = rows.count()
    # As many shards as the session has reducers, more where their rows would pass shard_rows.
    shards = max(1, -(-total // shard_rows), min(reducers(spark), total // 64))
    blocks = max(1, -(-anchors.count() // anchor_rows))
    cells = blocks * shards
    tasks = min(cells, MOST_TASKS)

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def met(asking: DataFrame) -> DataFrame:
        """Cells in their tasks: the candidates of a cell by id, then the anchors that ask there."""
        nothing = F.array().cast("array<long>")
        given = rows.withColumns({"block": numbers(blocks), "shard": F.pmod(F.xxhash64("id"), F.lit(shards)), "asks": F.lit(False), "goals": nothing, "goal_scores": nothing})
        asked = asking.withColumns({"block": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)), "shard": numbers(shards), "asks": F.lit(True)})
        placed = given.unionByName(asked).withColumn("cell", F.col("block") * shards + F.col("shard"))
        dealt = placed.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int"))
        return dealt.select("cell", "asks", "id", "label", "vec", "goals", "goal_scores").sortWithinPartitions("cell", "asks", "id", "label", "vec")

    def over_cells(answer):
        """Arrow function that loads the candidates of a cell and gives gathered anchors to ``answer``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, latest, loading, shards_of, waiting = None, None, {}, None, {}

            def asked() -> Iterator[pa.RecordBatch]:
                nonlocal shards_of
                if shards_of is None:
                    shards_of = {n: Shard(ids, labels, whole(np.stack(vecs), scale)) for n, (ids, labels, vecs) in loading.items()}
                    loading.clear()
                for n, (ids, labels, vecs, goals, goal_scores) in waiting.items():
                    if n in shards_of:
                        yield from answer(shards_of[n], np.array(ids, np.int64), np.array(labels, np.int64), whole(np.stack(vecs), scale), goals, goal_scores)
                waiting.clear()

            for batch in batches:
                vec = batch.column(batch.schema.get_field_index("vec"))
                flat, cuts = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
                columns = [column_values(batch, c) for c in ("cell", "asks", "id", "label", "goals", "goal_scores")]
                for i, (cell, asks, name, kind, goals, goal_scores) in enumerate(zip(*columns, strict=True)):
                    if cell != here:
                        yield from asked()
                        here, latest, shards_of = cell, None, None
                        loading.clear()
                    value = flat[cuts[i] : cuts[i + 1]]
                    if asks:
                        for into, x in zip(waiting.setdefault(len(value), ([], [], [], [], [])), (name, kind, value, goals, goal_scores), strict=True):
                            into.append(x)
                        if sum(len(w[0]) for w in waiting.values()) >= WAITING:
                            yield from asked()
                    elif name != latest:  # sorted: of a repeated id the first row counts
                        latest = name
                        for into, x in zip(loading.setdefault(len(value), ([], [], [])), (name, kind, value), strict=True):
                            into.append(x)
            yield from asked()

        return run

    def for_positives(shard, own, labels, values, goals, goal_scores):
        for at, names, score in positives_of(shard, own, labels, values, positives):
            yield pa.RecordBatch.from_arrays([int64(own[at]), int64(names), int64(score)], names=["id", "positive_id", "positive_score"])

    def for_negatives(shard, own, labels, values, goals, goal_scores):
        for at, number, names, score in negatives_of(shard, labels, values, goal_scores, low, high, negatives):
            mine = [(goals[i][j], goal_scores[i][j]) for i, j in zip(at.tolist(), number.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [int64(own[at]), int64([g for g, _ in mine]), int64([s for _, s in mine]), int64(names), int64(score)],
                names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    nothing = F.array().cast("array<long>")
    close = met(anchors.withColumns({"goals": nothing, "goal_scores": nothing})).mapInArrow(over_cells(for_positives), "id long, positive_id long, positive_score long")
    nearest = Window.partitionBy("id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = close.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score")))  # at most ``positives`` of them
    goals = durable(chosen.groupBy("id").agg(listed.alias("g")).join(anchors, "id").select(
        "id", "label", "vec", F.col("g.positive_id").alias("goals"), F.col("g.positive_score").alias("goal_scores")))
    hard = met(goals).mapInArrow(over_cells(for_negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM given a JOIN given r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), shift_every=7)
