"""Exact global positions without a single-partition window, and what is built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilake.functions.text import col
from perilake.session import durable, reducers

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low bits


RANGE_ROWS = 65_536  # a range of narrow rows: a few megabytes, and a task's memory where a range is held whole
FEWEST_ROWS = 1_024  # not worth a task of its own
MOST_RANGES = 40_000  # one row a range may be collected or broadcast: some megabytes


def range_count(frame: DataFrame, rows_per_range: int = RANGE_ROWS) -> int:
    """Number of ranges for a frame of this size.

    As many as its rows need; at least one for each of the session's reducers while that leaves ranges
    of ``FEWEST_ROWS``; beyond ``MOST_RANGES`` ranges grow instead.
    """
    rows = frame.count()
    busy = min(reducers(frame.sparkSession), -(-rows // min(FEWEST_ROWS, rows_per_range)))
    return max(1, min(MOST_RANGES, max(busy, -(-rows // rows_per_range))))


def range_ordered(frame: DataFrame, order: Sequence[str | Column], partitions: int | None = None, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Globally sorted rows with ``_part`` (range number) and ``_local`` (0-based place in it).

    The number of ranges follows the number of rows, and Spark's sample of the keys sets their bounds.
    The sorted rows are materialised once. Range bounds come from sampling, so evaluating the
    sort twice could cut the ranges elsewhere; everything downstream must see one cut.
    """
    n = partitions or range_count(frame, rows_per_range)
    keys = [col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    ordered = frame.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    stamped = durable(ordered.withColumn("_at", F.monotonically_increasing_id()))
    return stamped.withColumns({
        "_part": F.shiftright("_at", _ROW_BITS).cast("int"),
        "_local": F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    }).drop("_at")


def range_mapped(
    frame: DataFrame, order: Sequence[str | Column], work: Callable[[pa.Table, int], pa.Table], schema: str, rows_per_range: int = RANGE_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """``work(rows of a range in order, range number)`` over all ranges, materialised once.

    One shuffle and one write: the ranges are worked on where they are sorted. A task holds one range.
    ``sized_by`` may be a frame of at least as many rows that is cheaper to count.
    """
    keys = [col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks(), TaskContext.get().partitionId()).to_batches()

    sorted_ = frame.repartitionByRange(range_count(frame if sized_by is None else sized_by, rows_per_range), *keys).sortWithinPartitions(*keys)
    return durable(sorted_.mapInArrow(run, schema))


def codes_of(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that are equal where values are; a missing value equals a missing value."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _offsets(sizes: DataFrame, total: str, start: str, part: str = "_part", within: Sequence[str] = ()) -> DataFrame:
    """Exclusive running total over ranges; the input has one row per range (and group)."""
    before = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(start, F.coalesce(F.sum(total).over(before), F.lit(0)))


def ordered_index(frame: DataFrame, order: Sequence[str], name: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Dense 0-based global position in ``order``; make the order total for a unique answer.

    One range shuffle of the rows, plus a table of one offset per range, which is broadcast:
    its size is the number of ranges and does not grow with the data.
    """
    ranged = range_ordered(frame, order, partitions)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = _offsets(sizes, "_rows", "_start").select("_part", "_start")
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start")
    )


def running_before(
    frame: DataFrame, order: Sequence[str], measures: Mapping[str, str], within: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Exclusive running sums of ``measures`` (output name -> column) in ``order``.

    With ``within`` the sums restart per group. Ranges are cut on (group, order), so one huge
    group is spread over many ranges; each range adds up locally and takes its start from the
    per-range totals.
    """
    ranged = range_ordered(frame, [*within, *order], partitions)
    local = Window.partitionBy("_part", *within).orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *within).agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in measures.items()])
    for out in measures:
        totals = _offsets(totals, f"_sum_{out}", f"_start_{out}", within=within)
    summed = ranged.withColumns({out: F.coalesce(F.sum(c).over(local), F.lit(0)) for out, c in measures.items()})
    keys = ["_part", *within]
    joined = summed.join(totals.drop(*[f"_sum_{o}" for o in measures]), keys)
    return joined.withColumns({o: F.col(o) + F.col(f"_start_{o}") for o in measures}).drop(
        "_part", "_local", *[f"_start_{o}" for o in measures]
    )


def file_positions(lines: DataFrame, name: str = "row_id", keep_file: bool = False) -> DataFrame:
    """0-based position of each row in file order, for rows carrying ``_file`` and ``_block``.

    With ``keep_file`` positions start anew in each file and ``_file`` stays.

    Rows of one file split are already in order, so nothing is sorted: each split needs only
    its start. The offsets table has one row per split.
    """
    stamped = durable(lines.withColumn("_at", F.monotonically_increasing_id()))
    splits = stamped.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    within = Window.partitionBy("_file") if keep_file else Window
    order = within.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_start", F.coalesce(F.sum("_rows").over(order), F.lit(0))).drop("_rows")
    return (
        stamped.join(starts, ["_file", "_block"])
        .withColumn(name, F.col("_start") + F.col("_at") - F.col("_first"))
        .drop("_block", "_at", "_first", "_start", *([] if keep_file else ["_file"]))
    )


class CountMismatch(RuntimeError):
    """Two inputs that must line up row by row have different sizes."""


def positional_join(left: DataFrame, right: DataFrame, name: str = "row_id") -> DataFrame:
    """Join two indexed frames row by row; their sizes must be equal."""
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise CountMismatch(f"input={n_left}, output={n_right}")
    return left.join(right, name)


SPLITS = (("train", Fraction(6, 10)), ("validation", Fraction(8, 10)), ("test", Fraction(1)))


def daily_counts(frame: DataFrame, time: str) -> DataFrame:
    """Rows per calendar day (``d``, ``n``), combined map-side and written down: later steps don't count again."""
    return durable(frame.groupBy(F.to_date(time).alias("d")).agg(F.count(F.lit(1)).alias("n")))


def rank_keys(frame: DataFrame, time: str, key: str, ranks: Sequence[int], daily: DataFrame | None = None) -> dict[int, tuple]:
    """The (time as text, key) pair at each 1-based rank of (time, key), NULL times last.

    ``time`` is a date or timestamp column.

    A per-day histogram, combined map-side, finds the day of each rank; only the keys of those
    days (at most one per rank) are then ordered. The histogram has one row per calendar day,
    so its prefix sum is small whatever the table size.
    """
    wanted = sorted({r for r in ranks if r > 0})
    if not wanted:
        return {}
    day = F.to_date(time)
    daily = daily_counts(frame, time) if daily is None else daily
    up_to = F.sum("n").over(Window.orderBy(F.col("d").asc_nulls_last()))
    spans = daily.select("d", (up_to - F.col("n")).alias("before"), up_to.alias("upto"))
    covers = F.lit(False)
    for rank in wanted:
        covers = covers | ((F.col("before") < rank) & (F.col("upto") >= rank))
    found = spans.filter(covers).collect()  # at most len(ranks) rows
    if not found:
        return {}
    result: dict[int, tuple] = {}
    for span in found:
        inside = frame.filter(day.isNull() if span.d is None else day == F.lit(span.d)).select(time, key)
        places = {rank - span.before - 1: rank for rank in wanted if span.before < rank <= span.upto}
        indexed = ordered_index(inside, [time, key])
        hits = indexed.filter(F.col("row_id").isin(*places))
        for row in hits.select("row_id", F.col(time).cast("string").alias("t"), F.col(key).alias("k")).collect():
            result[places[row.row_id]] = (row.t, row.k)
    return result


def chronological_split(frame: DataFrame, time: str, key: str, name: str = "split") -> DataFrame:
    """Label rows train / validation / test at floor(0.6 n) and floor(0.8 n) of (time, key).

    The wide rows are never sorted or moved: two boundary keys are found first, then every row
    is labelled by comparing with them, which is a map-only projection.
    """
    daily = daily_counts(frame, time)
    n = daily.agg(F.sum("n")).first()[0] or 0
    cuts = [(label, int(n * share)) for label, share in SPLITS[:-1]]
    bounds = rank_keys(frame, time, key, [c for _, c in cuts], daily)
    kinds = frame.schema
    label = None
    for split, cut in cuts:
        if cut not in bounds:
            continue
        at, last = bounds[cut]
        bound_time = F.lit(at).cast(kinds[time].dataType)
        inside = F.coalesce(
            (F.col(time) < bound_time) | ((F.col(time) == bound_time) & (F.col(key) <= F.lit(last))), F.lit(False)
        )
        if at is None:
            inside = F.col(time).isNotNull() | (F.col(key) <= F.lit(last))
        label = F.when(inside, split) if label is None else label.when(inside, split)
    last_label = SPLITS[-1][0]
    return frame.withColumn(name, F.lit(last_label) if label is None else label.otherwise(last_label))


def require_both_classes(frame: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Fail unless each split holds positives and negatives; returns the profile (3 rows)."""
    profile = frame.groupBy(split).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    seen = {row[split]: (row.low, row.high) for row in profile.collect()}
    bad = [name for name, _ in SPLITS if seen.get(name) != (0, 1)]
    if bad:
        raise ValueError(", ".join(bad) + " split must contain both target classes")
    return profile
