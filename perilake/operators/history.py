"""Point-in-time history: prior-window features, status intervals and validity overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from perilake.functions.temporal import DAY_MICROS, micros
from perilake.operators.ordering import RANGE_ROWS, codes_of, range_mapped, range_ordered


def prior_features(
    frame: DataFrame, *, key: str, time: str, measures: Mapping[str, str], days: Sequence[int], rows_per_range: int = RANGE_ROWS,
) -> DataFrame:
    """For each row: sums of ``measures`` over the same key in [t - N days, t), per N.

    Output columns are ``<measure>_<N>d`` after the input's own, of the type Spark's sum gives. The
    row itself and rows at the same instant are excluded. Rows without a key or a time have no
    history (0) and belong to none.

    The answer depends only on (key, time) and is computed once per such point. Points are cut into
    ranges of one (key, time) ordering, whatever the number of windows, and each range is summed in
    place: a window is the suffix of one block and the prefix of the next, for blocks of every power
    of two, so a sum is one addition. Nothing is subtracted, and no digits are lost. Only a key
    that goes on from one range into the next looks further back: what lies between is added up
    from one row a range, and the range its window begins in is met by pairs of ranges, two a range and
    window on average. A key with a third of all rows is so spread over many tasks.
    """
    names = list(measures)
    kinds = {m: frame.select(F.sum(c).alias(m)).schema[m].dataType for m, c in measures.items()}
    scales = {m: 10**k.scale for m, k in kinds.items() if isinstance(k, DecimalType)}
    stored = {m: "decimal(38,0)" if m in scales else kinds[m].simpleString() for m in names}
    value = lambda m, c: (c * scales[m]).cast("decimal(38,0)") if m in scales else c.cast(stored[m])
    points = (
        frame.select(F.col(key).alias("_k"), micros(time).alias("_t"), *[F.col(c).alias(f"_v_{m}") for m, c in measures.items()])
        .dropna(subset=["_k", "_t"]).groupBy("_k", "_t").agg(*[value(m, F.sum(f"_v_{m}")).alias(f"_v_{m}") for m in names])
    )
    kind = frame.schema[key].dataType.simpleString()
    fields = [f"{a} {stored[m]}" for m in names for a in (f"_v_{m}", *(f"_a_{m}_{n}" for n in days))]

    def work(rows: pa.Table, part: int) -> pa.Table:
        runs = codes_of(rows["_k"])
        instants = rows["_t"].to_numpy()
        starts = np.maximum.accumulate(np.where(np.r_[True, runs[1:] != runs[:-1]], np.arange(len(runs)), 0))
        out = {"_k": rows["_k"], "_t": rows["_t"], "_part": pa.array(np.full(len(runs), part, np.int32)),
               "_first": pa.array(runs == runs[0]), "_last": pa.array(runs == runs[-1])}
        begin = {n: first_at_or_after(instants, starts, instants - n * DAY_MICROS) for n in days}
        for m in names:
            given = rows[f"_v_{m}"].combine_chunks()
            out[f"_v_{m}"] = given
            held = addable(given)
            for n in days:
                found = pa.array(between(held, begin[n]), given.type if held.dtype == object else None)
                out[f"_a_{m}_{n}"] = found if found.type == given.type else found.cast(given.type)
        return pa.table(out)

    schema = f"_k {kind}, _t long, _part int, _first boolean, _last boolean, " + ", ".join(fields)
    summed = range_mapped(points, ["_k", "_t"], work, schema, rows_per_range, frame)
    own = [f"_a_{m}_{n}" for m in names for n in days]
    wide = summed.select("_k", "_t", *own)
    if (crossing := _crossing_windows(summed, kind, stored, names, days)) is not None:
        wide = wide.unionByName(crossing).groupBy("_k", "_t").agg(*[F.sum(c).alias(c) for c in own])

    def told(m: str, n: int) -> Column:
        found = F.coalesce(F.col(f"_a_{m}_{n}"), F.lit(0).cast(stored[m]))
        whole = lambda k: found.cast(DecimalType(k.precision, 0)) / F.lit(Decimal(scales[m]))
        return (whole(kinds[m]) if m in scales else found).cast(kinds[m])

    joined = frame.join(wide, (F.col(key) == F.col("_k")) & (micros(time) == F.col("_t")), "left")
    return joined.select(*[frame[c] for c in frame.columns], *[told(m, n).alias(f"{m}_{n}d") for m in names for n in days])


def first_at_or_after(instants: np.ndarray, low: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row the first place in [low, row] whose instant is ``wanted`` or later."""
    low, high = low.copy(), np.arange(len(instants))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        late = instants[middle] >= wanted
        high = np.where(open_ & late, middle, high)
        low = np.where(open_ & ~late, middle + 1, low)
    return low


def addable(column: pa.Array) -> np.ndarray:
    """Values to add, missing ones as 0: longs and doubles as they are, whole numbers that could pass a long as Python's."""
    if pa.types.is_floating(column.type):
        return column.fill_null(0).to_numpy(zero_copy_only=False)
    exact = [int(x or 0) for x in column.to_pylist()] if pa.types.is_decimal(column.type) else column.fill_null(0).to_numpy(zero_copy_only=False)
    small = float(np.abs(np.array(exact, dtype=np.float64)).sum()) < 2.0**62
    return np.array(exact, dtype=np.int64 if small else object)


def between(values: np.ndarray, begin: np.ndarray) -> list | np.ndarray:
    """Sums of ``values[begin[i]:i]`` for each i, each with one addition at most."""
    last = np.arange(len(values)) - 1
    found = np.zeros(len(values), values.dtype)
    one = begin == last
    found[one] = values[begin[one]]
    apart = np.where(begin < last, begin ^ np.maximum(last, 0), 0)
    size = 1 << max(1, (len(values) - 1).bit_length())
    padded = np.zeros(size, values.dtype)
    padded[: len(values)] = values
    level = 1
    while level < size or level == 1:
        here = (apart >= level) & (apart < 2 * level)  # windows that a block of 2 * level rows holds and its middle parts
        if here.any():
            blocks = padded.reshape(-1, 2, level)
            before = np.add.accumulate(blocks[:, 0, ::-1], axis=1)[:, ::-1]
            after = np.add.accumulate(blocks[:, 1], axis=1)
            sums = np.stack((before, after), 1).reshape(-1)
            found[here] = sums[begin[here]] + sums[last[here]]
        level *= 2
    return found.tolist() if values.dtype == object else found


def _crossing_windows(summed: DataFrame, kind: str, stored: Mapping[str, str], names: Sequence[str], days: Sequence[int]) -> DataFrame | None:
    """What windows that begin in an earlier range of their key add, as further rows of (key, time).

    The edges of the ranges are at most two rows a range, and only those of keys that cross a bound
    are used: their sums between two ranges, and the pairs of ranges that share a window, are found on
    the driver.
    """
    values = [F.sum(f"_v_{m}").alias(f"_v_{m}") for m in names]
    edges = summed.filter("_first OR _last").groupBy("_k", "_part").agg(F.min("_t").alias("low"), F.max("_t").alias("high"), *values)
    crossing = edges.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy("_k"))).filter("_ranges > 1").orderBy("_part").collect()
    if not crossing:
        return None
    chains: dict = {}
    for row in crossing:
        chains.setdefault(row["_k"], []).append(row)
    pairs = []
    for chain in chains.values():
        lows = np.array([r.low for r in chain])
        totals = {m: addable(pa.array([r[f"_v_{m}"] for r in chain], pa.float64() if stored[m] == "double" else pa.decimal128(38, 0))) for m in names}
        for i in range(1, len(chain)):
            for n in days:
                # Starts of this range's windows lie in (low - N, high - N]; those after its own low are its own.
                first = int(np.searchsorted(lows, chain[i].low - n * DAY_MICROS, side="left"))
                last = min(i, int(np.searchsorted(lows, chain[i].high - n * DAY_MICROS, side="left")))
                for j in range(first, last + 1):
                    since, until = (None if j == 0 else int(lows[j - 1])), int(lows[j])
                    rest = [totals[m][j:i].sum() if j < i else 0 for m in names]  # ranges j to i - 1 lie in the window whole
                    pairs.append((chain[i]["_part"], chain[j - 1]["_part"] if j else None, n, since, until, *[float(x) if stored[m] == "double" else Decimal(int(x)) for m, x in zip(names, rest, strict=True)]))
    types = ", ".join(f"r_{m} {'double' if stored[m] == 'double' else 'decimal(38,0)'}" for m in names)
    spark = summed.sparkSession
    listed = F.broadcast(spark.createDataFrame(pairs, f"part int, other int, n int, since long, until long, {types}"))
    start = F.col("_t") - F.col("n").cast("long") * DAY_MICROS
    fits = (F.col("_part") == F.col("part")) & (F.col("since").isNull() | (start > F.col("since"))) & (start <= F.col("until"))
    asking = summed.filter("_first").select("_k", "_t", "_part").join(listed, fits)

    def wide(rows: DataFrame, source: str) -> DataFrame:
        return rows.select("_k", "_t", *[F.when(F.col("n") == n, F.col(f"{source}_{m}")).cast(stored[m]).alias(f"_a_{m}_{n}") for m in names for n in days])

    between_ = wide(asking, "r")
    # The range a window begins in: its rows and the rows that ask meet per pair, both bounded by a range.
    meet = ["part", "other", "n"]
    questions = asking.filter("other IS NOT NULL").select(*meet, "_k", "_t", start.alias("at"), F.lit(1).alias("asks"), *[F.lit(None).cast(stored[m]).alias(f"_v_{m}") for m in names])
    held = summed.filter("_last").join(listed.select(*meet).filter("other IS NOT NULL"), F.col("_part") == F.col("other"))
    answers = held.select(*meet, "_k", "_t", F.col("_t").alias("at"), F.lit(0).alias("asks"), *[f"_v_{m}" for m in names])
    upward = Window.partitionBy(*meet).orderBy(F.col("at").desc(), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    suffix = questions.unionByName(answers).withColumns({f"s_{m}": F.sum(f"_v_{m}").over(upward) for m in names}).filter("asks = 1")
    return between_.unionByName(wide(suffix, "s"))


def status_history(changes: DataFrame, *, key: str, status: str, time: str, tie: str, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Intervals [valid_from, valid_to) per status change; the last one is open.

    A change to the status already held is not a transition and is merged into its interval. Ranges
    are cut on (key, time) by row count, so a busy key is spread however dense its time is. One pass
    over each range finds its transitions and their ends. What a range owes its neighbours, the status
    it ends with and when the next transition comes, is one row a range, carried from range to
    range, and handed back by a broadcast of that many rows.
    """
    kinds = {c: changes.schema[c].dataType.simpleString() for c in (key, status, time, tie)}
    held = changes.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(status).alias("status"), F.col(time).alias("at"), F.col(tie).alias("tie"))

    def work(rows: pa.Table, part: int) -> pa.Table:
        runs, said = codes_of(rows["k"]), codes_of(rows["status"])
        fresh = np.r_[True, runs[1:] != runs[:-1]]  # first row of its key here
        moves = np.flatnonzero(fresh | np.r_[True, said[1:] != said[:-1]])
        count, place = len(runs), np.arange(len(moves))
        nothing = lambda hide: pa.array(hide, pa.bool_())
        before = rows["status"].combine_chunks().take(pa.array(np.where(fresh[moves], 0, moves - 1)))
        after = np.r_[moves[1:], count - 1]
        ends = np.r_[runs[moves[1:]] != runs[moves[:-1]], True]  # last transition of its key here
        until = rows["at"].combine_chunks().take(pa.array(after))
        out = {c: rows[c].combine_chunks().take(pa.array(moves)) for c in ("k", "status", "at", "tie")}
        out["previous"] = pc.if_else(nothing(fresh[moves]), pa.scalar(None, before.type), before)
        out["until"] = pc.if_else(nothing(ends), pa.scalar(None, until.type), until)
        out["_part"] = pa.array(np.full(len(moves), part, np.int32))
        out["_head"], out["_tail"] = pa.array(place == 0), pa.array(place == len(moves) - 1)
        out["_one"] = pa.array(np.full(len(moves), bool(runs[0] == runs[-1])))
        return pa.table(out)

    schema = f"k {kinds[key]}, status {kinds[status]}, at {kinds[time]}, tie {kinds[tie]}, previous {kinds[status]}, until {kinds[time]}, _part int, _head boolean, _tail boolean, _one boolean"
    moved = range_mapped(held, ["k", "at", "tie"], work, schema, rows_per_range)
    carried = F.broadcast(_carried(moved, kinds[status]))
    seen = moved.join(carried, "_part", "left")
    previous = F.when(F.col("_head"), F.col("_before")).otherwise(F.col("previous"))
    ends = F.when(F.col("_tail"), F.col("_after")).otherwise(F.col("until"))
    # The first transition of a range is none if the range before ended with the same status.
    again = F.col("_head") & F.coalesce(F.col("_same"), F.lit(False))
    return seen.filter(~again).select(
        F.col("k").alias(key), previous.alias("previous_status"), "status", F.col("at").alias("valid_from"), ends.alias("valid_to"), F.col("tie").alias("source_order"))


def _carried(moved: DataFrame, status: str) -> DataFrame:
    """Per range: the status its first key comes with, whether its first row repeats it, and the end of its last interval."""
    side = F.struct("k", "status", "at", "until", "_one")
    edges = moved.filter("_head OR _tail").groupBy("_part").agg(
        F.max(F.when(F.col("_head"), side)).alias("head"), F.max(F.when(F.col("_tail"), side)).alias("tail"), F.count(F.lit(1)).alias("moves")).orderBy("_part").collect()  # one row a range
    rows, ahead = [], None  # ``ahead``: first key and status of the range behind, and where to read its first time and that of another status
    for i in range(len(edges) - 1, -1, -1):
        part, head, tail = edges[i]["_part"], edges[i].head, edges[i].tail
        end = None
        if ahead is not None and ahead[0] == tail.k:
            end = ahead[2] if ahead[1] != tail.status else ahead[3]
        earlier = edges[i - 1].tail if i and edges[i - 1].tail.k == head.k else None
        rows.append((part, None if earlier is None else earlier.status, earlier is not None and earlier.status == head.status, *(end or (None, None))))
        # The first transition after the head: in this range, or where the key goes on.
        alone = head._one and edges[i].moves == 1
        ahead = (head.k, head.status, (part, True), end if alone else (part, False) if head.until is not None else None)
    listed = moved.sparkSession.createDataFrame(rows, f"_part int, _before {status}, _same boolean, _there int, _itself boolean")
    heads = moved.filter("_head").select(F.col("_part").alias("_there"), "at", "until")
    after = F.when(F.col("_itself"), F.col("at")).otherwise(F.col("until"))
    return listed.join(heads, "_there", "left").select("_part", "_before", "_same", after.alias("_after"))


def overlapping_validity(versions: DataFrame, *, key: str, start: str, end: str) -> DataFrame:
    """Versions that start before an earlier version of the same key has ended.

    An open end never ends. The running maximum of ends catches overlap with any earlier
    version, not only the neighbour; earlier ranges contribute their own maximum. Ranges are cut
    on (key, start) by row count.
    """
    forever = F.lit("9999-12-31").cast("timestamp")
    until = F.coalesce(F.col(end).cast("timestamp"), forever)
    rows = range_ordered(versions.withColumn("_until", until), [key, start, "_until"])
    before = lambda *by: Window.partitionBy(key, *by)
    inside = before("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
    across = before().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(key, "_part").agg(F.max("_until").alias("_edge")).select(key, "_part", F.max("_edge").over(across).alias("_edge"))
    seen = rows.withColumn("_near", F.max("_until").over(inside)).join(edges, [key, "_part"])
    overlap = F.col(start).cast("timestamp") < F.greatest("_near", "_edge")
    return seen.filter(overlap).select(*versions.columns)


def tenure_days(as_of: str, since: str) -> Column:
    return F.datediff(F.col(as_of), F.col(since))
