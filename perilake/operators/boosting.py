"""Gradient boosting over binned blocks: one pass over the rows a tree level, and no tree more than is needed.

Rows are cut once into blocks that hold, for a few groups of features, one 16-bit code a row. The code of a group
stands for the bins of all its features, so one count over codes gives the histograms of a whole group; they are
added up per feature in the task, and a task returns sums and counts per (node, bin). Squared error of the
pseudo-residuals, leaf means, the first tree on the labels: the trees are those of Spark's boosted trees, whose model
they are put into. Two draws differ: cut points come from a summary of all rows instead of 10,000 of them, and rows
and features are drawn from (seed, round, block) and (seed, round, node).

Blocks carry the margin of each row. It is made anew from the trees every ``REBASE`` rounds, which cuts the lineage.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, TaskContext
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 32
GROUP_CODES = 4096  # codes of a group: a count per (node, code) stays in a core's cache
BLOCK_ROWS = 32_768
TASK_BLOCKS = 32
SUMMARY_POINTS = 512  # values kept of a column in a summary; a quantile is off by a few rows in so many
REBASE = 20
PARTS = ("train", "validation")
KEPT = StorageLevel.MEMORY_AND_DISK_DESER  # as bytes: serialized once more they would be compressed for each pass


@dataclass(frozen=True)
class Tree:
    """Nodes go by heap number: 1 is the root, 2n and 2n + 1 are the children of n."""

    splits: dict[int, tuple[int, int, float]]  # feature, last bin that goes left, gain
    totals: dict[int, tuple[float, float]]  # sum and count of the residuals
    weight: float

    def mean(self, node: int) -> float:
        total, rows = self.totals[node]
        return total / rows if rows else 0.0

    def values(self, depth: int) -> np.ndarray:
        """What a row gets by its place in the deepest level; rows of a node without a split are at its leftmost place."""
        values = np.zeros(1 << depth)
        for node in self.totals.keys() - self.splits.keys():
            values[(node << depth + 1 - node.bit_length()) - (1 << depth)] = self.mean(node)
        return values


@dataclass(frozen=True)
class Layout:
    """Cut points of each feature, and its place in a group: (group, stride)."""

    cuts: tuple[np.ndarray, ...]
    places: tuple[tuple[int, int] | None, ...]  # None: a feature with one value, which splits nothing
    codes: tuple[int, ...]  # number of codes of each group

    def groups(self) -> list[list[int]]:
        members: list[list[int]] = [[] for _ in self.codes]
        for feature, place in sorted(enumerate(self.places), key=lambda item: (item[1] or (0, 0))[1]):
            if place:
                members[place[0]].append(feature)
        return members


# A block in a task is (number, (codes by (group, row), labels as -1 or 1, number of training rows, margins)); training
# rows come first. Plain tuples, as executors need no copy of this module.
Block = tuple[int, tuple[np.ndarray, np.ndarray, int, np.ndarray]]


# --- cut points -------------------------------------------------------------------------------


def _shrunk(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights (of 1 by default); where there are too many, neighbours are put together at the last of them."""
    if weights is None and not np.any(values * (1 - values)):  # flags are not sorted
        ones = np.count_nonzero(values)
        counted = np.array([values.size - ones, ones])
        kept, total = np.flatnonzero(counted).astype(float), counted[counted > 0]
    elif weights is None:
        kept, total = np.unique(values, return_counts=True)
    else:
        kept, at = np.unique(values, return_inverse=True)
        total = np.bincount(at, weights=weights, minlength=kept.size)
    if kept.size <= SUMMARY_POINTS:
        return kept, total
    upto = np.cumsum(total)
    ends = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], SUMMARY_POINTS + 1)[1:]).clip(max=kept.size - 1))
    return kept[ends], np.diff(upto[ends], prepend=0)


def merged(one: list, other: list) -> list:
    return [_shrunk(np.concatenate([a, c]), np.concatenate([b, d])) for (a, b), (c, d) in zip(one, other)]


def cut_points(values: np.ndarray, weights: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """Between neighbours of a summary: all of them when few, else those that share the rows evenly."""
    between = (values[:-1] + values[1:]) / 2
    if values.size <= bins:
        return between
    upto = np.cumsum(weights)
    ends = np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins)
    return between[np.unique(ends.clip(max=between.size - 1))]


def layout(cuts: Sequence[np.ndarray]) -> Layout:
    """Features are put into the first group with room for their bins, those of many bins first."""
    codes: list[int] = []
    places: list[tuple[int, int] | None] = [None] * len(cuts)
    for feature in sorted(range(len(cuts)), key=lambda f: -cuts[f].size):
        bins = cuts[feature].size + 1
        if bins == 1:
            continue
        group = next((g for g, c in enumerate(codes) if c * bins <= GROUP_CODES), len(codes))
        if group == len(codes):
            codes.append(1)
        places[feature] = (group, codes[group])
        codes[group] *= bins
    return Layout(tuple(cuts), tuple(places), tuple(codes))


# --- blocks -----------------------------------------------------------------------------------


def _numbers(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False).astype(float)
    if np.isnan(values).any():
        raise ValueError("a feature or label is null or not a number")
    return values


def _features(batch: pa.RecordBatch) -> np.ndarray:
    """Values by (feature, row)."""
    return np.ascontiguousarray(_numbers(batch.column("features").flatten()).reshape(batch.num_rows, -1).T)


def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
    """A summary of each feature over the rows of a task."""
    held = None
    for batch in batches:
        if batch.num_rows:
            one = [_shrunk(v) for v in _features(batch)]
            held = one if held is None else merged(held, one)
    if held is not None:
        yield held


def blocks_of(plan: Layout) -> Callable[[Iterable], Iterator[Block]]:
    def cut(held: list[pa.RecordBatch], number: int) -> Block:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        values, labels = _features(batch), _numbers(batch.column("label"))
        if not np.isin(labels, (0, 1)).all():
            raise ValueError("labels must be 0 or 1")
        training = batch.column("part").to_numpy(zero_copy_only=False) == PARTS[0]
        order = np.argsort(~training, kind="stable")
        codes = np.zeros((len(plan.codes), batch.num_rows), np.uint16)
        for feature, place in enumerate(plan.places):
            if place:
                cuts = plan.cuts[feature]
                bins = values[feature] > cuts[0] if cuts.size == 1 else np.searchsorted(cuts, values[feature])
                codes[place[0]] += bins.astype(np.uint16) * np.uint16(place[1])
        return number, (codes.take(order, axis=1), np.where(labels[order] > 0, 1, -1).astype(np.int8), int(training.sum()), np.zeros(batch.num_rows))

    def run(batches):
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield cut(held, number)
                number, held, rows = number + 1, [], 0
        if held:
            yield cut(held, number)

    return run


# --- passes -----------------------------------------------------------------------------------


def walker(plan: Layout, tree_splits: Sequence[tuple[int, int, int]], levels: int) -> Callable[[np.ndarray], np.ndarray]:
    """Codes -> place of each row in a level of a tree. A node that is not split sends its rows to the left."""
    goes: dict[int, tuple[int, np.ndarray]] = {}
    for node, feature, last in tree_splits:
        group, stride = plan.places[feature]
        goes[node] = group, np.arange(plan.codes[group]) // stride % (plan.cuts[feature].size + 1) > last

    def places(codes: np.ndarray) -> np.ndarray:
        at = np.zeros(codes.shape[1], np.uint8)
        for level in range(levels):
            right = np.zeros(codes.shape[1], np.bool_)
            for node in range(1 << level, 2 << level):
                if node in goes:
                    group, table = goes[node]
                    hit = table[codes[group]]
                    right |= hit if level == 0 else hit & (at == node - (1 << level))
            at = 2 * at + right
        return at

    return places


def grown(plan: Layout, trees: Sequence[Tree], depth: int) -> Callable[[Iterable], Iterator[Block]]:
    """Blocks with the margins of these trees added."""

    def run(blocks):
        walks = [(walker(plan, [(n, f, b) for n, (f, b, _) in t.splits.items()], depth), t.values(depth) * t.weight) for t in trees]
        for number, (codes, signs, train, margins) in blocks:
            for places, values in walks:
                margins = margins + values[places(codes)]
            yield number, (codes, signs, train, margins)

    return run


def counts(
    plan: Layout, splits: Sequence[tuple[int, int, int]], level: int, seed: tuple[int, ...], share: float, first: bool,
) -> Callable[[Iterable], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Per task: sums and counts per (node of the level, bin), and (loss, rows) of the validation rows."""
    members, nodes = plan.groups(), 1 << level

    def run(blocks):
        places = walker(plan, splits, level)
        sums = [np.zeros((2, nodes * c)) for c in plan.codes]
        whole, loss = np.zeros((2, nodes)), np.zeros(2)
        for number, (codes, signs, n, margins) in blocks:
            if level == 0 and n < signs.size:
                held = -2 * signs[n:] * margins[n:]
                loss += 2 * np.logaddexp(0, held).sum(), held.size
            drawn = np.flatnonzero(np.random.default_rng([*seed, number]).random(n, dtype=np.float32) < share)
            codes, signs, margins = codes.take(drawn, axis=1), signs[drawn].astype(float), margins[drawn]
            wanted = signs if first else 4 * signs / (1 + np.exp(2 * signs * margins))
            at = places(codes).astype(np.intp)
            whole += np.bincount(at, wanted, nodes), np.bincount(at, minlength=nodes)
            for group, size in enumerate(plan.codes):
                keys = codes[group] + at * size
                sums[group] += np.bincount(keys, wanted, nodes * size), np.bincount(keys, minlength=nodes * size)
        features = [np.zeros((2, nodes, 1))] * len(plan.cuts)
        for group, inside in enumerate(members):
            # the feature of the smallest stride changes fastest: it is the last axis
            shape = [plan.cuts[f].size + 1 for f in reversed(inside)]
            cube = sums[group].reshape(2, nodes, *shape)
            for axis, feature in enumerate(reversed(inside), 2):
                features[feature] = cube.sum(axis=tuple(a for a in range(2, cube.ndim) if a != axis))
        yield np.concatenate([whole[:, :, None], *(f for f, p in zip(features, plan.places) if p)], axis=2), loss

    return run


def added(one: tuple, other: tuple) -> tuple:
    return one[0] + other[0], one[1] + other[1]


def best_split(plan: Layout, found: np.ndarray, total: np.ndarray, features: Iterable[int], least: int) -> tuple[int, int, float, np.ndarray] | None:
    """(feature, last bin to the left, gain, sum and count to the left) of a node; None where nothing is gained."""
    chosen, best, start = set(features), None, 0
    for feature, place in enumerate(plan.places):
        if not place:
            continue
        stop = start + plan.cuts[feature].size + 1
        if feature in chosen:
            left = np.cumsum(found[:, start:stop - 1], axis=1)
            right = total[:, None] - left
            fits = (left[1] >= least) & (right[1] >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(fits, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1], 0) / total[1]
            at = int(np.argmax(gains))
            if gains[at] > (best[2] if best else 0):
                best = feature, at, float(gains[at]), left[:, at]
        start = stop
    return best


# --- the model --------------------------------------------------------------------------------


def fit(
    vectors: DataFrame, names: Sequence[str], label: str, part: str, *, rounds: int, depth: int, step: float, least: int, row_share: float,
    feature_share: float, seed: int, best: Callable[[Sequence[float]], int], patience: int,
) -> GBTClassificationModel:
    """Boosted trees on the rows whose ``part`` is train.

    ``best`` is given the losses of the validation rows after each tree, and names the number of trees to keep. No tree
    is grown after ``patience`` of them without a smaller loss. Without validation rows all rounds are kept.
    """
    # One array instead of a column a feature is handed to Python twice as fast.
    inputs = F.array(*[F.col(n).cast("double") for n in names]).alias("features")
    rows = vectors.select(inputs, F.col(label).cast("double").alias("label"), F.col(part).alias("part"))
    summary = _tasks(rows.filter(F.col("part") == PARTS[0]), summaries).treeReduce(merged)
    plan = layout([cut_points(*column) for column in summary])
    base = _dealt(_tasks(rows.filter(F.col("part").isin(*PARTS)), blocks_of(plan)))
    trees: list[Tree] = []
    losses: list[float] = []
    past = state = base
    try:
        while True:
            at = len(trees)
            if at:
                anew = at % REBASE == 0 and at < rounds
                past, state = state, (base if anew else state).mapPartitions(grown(plan, trees if anew else trees[-1:], depth)).persist(KEPT)
            histogram = lambda splits, level: _added_up(
                state.mapPartitions(counts(plan, splits, level, (seed, at), row_share, at == 0)))
            sums, loss = histogram((), 0)
            if past is not base:
                past.unpersist()
            if at and loss[1]:
                losses.append(loss[0] / loss[1])
            kept = best(losses) if losses else at
            if at == rounds or at - kept >= patience:
                return model_of(plan, trees[:kept], len(names))
            trees.append(_tree(plan, sums, histogram, depth, least, _drawn(len(names), feature_share, seed, at), step if at else 1.0))
    finally:
        for one in (state, base):
            one.unpersist()


def _tree(
    plan: Layout, sums: np.ndarray, histogram: Callable, depth: int, least: int, drawn: Callable[[int], list[int]], weight: float,
) -> Tree:
    """A tree from the histogram of its first level and a pass for each further one."""
    totals = {1: sums[:, 0, 0]}
    splits: dict[int, tuple[int, int, float]] = {}
    for level in range(depth):
        open_ = [node for node in totals if node >> level == 1 and totals[node][1]]
        if level and open_:
            sums = histogram([(node, feature, last) for node, (feature, last, _) in splits.items()], level)[0]
        for node in open_:
            found = best_split(plan, sums[:, node - (1 << level), 1:], totals[node], drawn(node), least)
            if found:
                *splits[node], left = found
                totals[2 * node], totals[2 * node + 1] = left, totals[node] - left
    return Tree({n: tuple(s) for n, s in splits.items()}, {n: (float(t[0]), float(t[1])) for n, t in totals.items()}, weight)


def _drawn(features: int, share: float, seed: int, at: int) -> Callable[[int], list[int]]:
    """The features a node may be split by."""
    wide = math.ceil(features * share)
    return lambda node: np.random.default_rng([seed, at, node]).choice(features, wide, replace=False).tolist()


def _dealt(blocks: RDD) -> RDD:
    """Blocks in tasks of even size, held for all rounds."""
    made = blocks.persist(KEPT)
    places = {number: i for i, number in enumerate(sorted(made.keys().collect()))}  # one number a block
    tasks = max(1, min(len(places), max(blocks.context.defaultParallelism, len(places) // TASK_BLOCKS)))
    even = made.partitionBy(tasks, lambda number: places[number] % tasks).persist(KEPT)
    even.count()
    made.unpersist()
    return even


def _tasks(frame: DataFrame, work: Callable[[Iterable], Iterator]) -> RDD:
    """What ``work`` makes of the Arrow batches of each task."""
    def run(batches):
        for one in work(batches):
            yield pa.record_batch([pa.array([pickle.dumps(one)], pa.binary())], ["made"])

    return frame.mapInArrow(run, "made binary").rdd.map(lambda row: pickle.loads(row.made))


def _added_up(parts: RDD) -> tuple[np.ndarray, np.ndarray]:
    return parts.reduce(added) if parts.getNumPartitions() <= 256 else parts.treeReduce(added)


def model_of(plan: Layout, trees: Sequence[Tree], width: int) -> GBTClassificationModel:
    """Spark's model of these trees. A node has its count and sum of residuals; their squares are not counted, so impurities are 0."""
    context = SparkContext._active_spark_context
    gateway, java = context._gateway, context._jvm
    tree, ml = java.org.apache.spark.ml.tree, java.org.apache.spark.ml

    def array(kind, values):
        made = gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            made[i] = value
        return made

    def node(one: Tree, number: int):
        total, rows = one.totals[number]
        mean = one.mean(number)
        stats = java.org.apache.spark.mllib.tree.impurity.VarianceCalculator(array(java.double, [rows, total, mean * total]), int(rows))
        if number not in one.splits:
            return tree.LeafNode(mean, 0.0, stats)
        feature, last, gain = one.splits[number]
        split = tree.ContinuousSplit(feature, float(plan.cuts[feature][last]))
        return tree.InternalNode(mean, 0.0, gain, node(one, 2 * number), node(one, 2 * number + 1), split, stats)

    kind = ml.regression.DecisionTreeRegressionModel
    made = array(kind, [kind(f"dtr_{i}", node(one, 1), width) for i, one in enumerate(trees)])
    return GBTClassificationModel(ml.classification.GBTClassificationModel(
        ml.util.Identifiable.randomUID("gbtc"), made, array(java.double, [one.weight for one in trees]), width, 2))
