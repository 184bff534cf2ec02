"""De-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilake.functions.text import col


def latest_per_key(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str | Column], *, limit: int = 1,
) -> DataFrame:
    """Newest ``limit`` rows per key; ``order`` lists the columns, newest (largest) first.

    Give a total order (end with a content hash) and the answer does not depend on arrival.
    Spark prunes each map partition to ``limit`` rows per key before the shuffle
    (WindowGroupLimit), so one key holding a third of the table ships one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*[col(c).desc_nulls_last() for c in order])
    return frame.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit).drop("_rank")


def drop_exact_repeats(frame: DataFrame, identity: str) -> DataFrame:
    """One row per identity. Rows with equal identity are equal in content, so any one will do."""
    return frame.dropDuplicates([identity])
