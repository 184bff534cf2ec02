"""Change-log semantics: current state is the newest change per key, minus tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilake.functions.identity import change_id
from perilake.functions.temporal import as_instant
from perilake.operators.dedup import latest_per_key

# Column names a change feed may use, in order of preference.
OPERATION_COLUMNS = ("Op", "op", "operation")
ORDER_COLUMNS = ("_dms_timestamp", "updated_at")


def envelope(raw: DataFrame, table: str, key: str, at: Column | None = None) -> DataFrame:
    """Add ``_operation``, ``_source_order`` and ``_source_change_id`` to landed changes.

    A missing operation means insert (full load). Without any order column the load instant
    orders the rows.
    """
    first = lambda names: next((n for n in names if n in raw.columns), None)
    operation, order = first(OPERATION_COLUMNS), first(ORDER_COLUMNS)
    now = F.current_timestamp() if at is None else at
    return raw.withColumns({
        "_operation": F.upper(F.coalesce(F.col(operation), F.lit("I"))) if operation else F.lit("I"),
        "_source_order": as_instant(order) if order else now,
    }).withColumn("_source_change_id", change_id(table, key, "_operation", "_source_order", raw.columns))


def newest_changes(changes: DataFrame, key: str, order: str = "_source_order", identity: str = "_source_change_id") -> DataFrame:
    """Newest change per key, tombstones included; equal order is settled by the identity."""
    return latest_per_key(changes, [key], [order, identity])


def live(state: DataFrame, operation: str = "_operation") -> DataFrame:
    return state.filter(F.col(operation) != "D")


def current_state(changes: DataFrame, key: str, order: str = "_source_order", identity: str = "_source_change_id") -> DataFrame:
    return live(newest_changes(changes, key, order, identity))


def apply_changes(
    state: DataFrame, changes: DataFrame, key: str, order: str = "_source_order", identity: str = "_source_change_id",
) -> DataFrame:
    """Fold new changes into a prior state; replaying changes is a no-op.

    ``state`` and the result keep tombstones, so an older change that arrives after a delete
    cannot bring the row back. Use :func:`live` for the visible rows. Only keys' newest rows
    travel: both sides are pruned to one row per key and map task before the shuffle.
    """
    both = state.unionByName(changes, allowMissingColumns=True)
    return newest_changes(both, key, order, identity)


def repeat_counts(changes: DataFrame, identity: str = "_source_change_id") -> DataFrame:
    """Input, distinct and repeated changes and the most copies of one, from a single grouping."""
    copies = changes.groupBy(identity).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_count"), F.count(F.lit(1)).alias("output_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"), F.coalesce(F.max("n"), F.lit(1)).alias("most_copies"))
