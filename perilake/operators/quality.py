"""Dataset-level quality rules, gates and stage counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from perilake.functions.money import score


@dataclass(frozen=True)
class IsComplete:
    """Every row has a value. Metric: share of non-null rows."""

    column: str

    def __str__(self) -> str:
        return f'IsComplete "{self.column}"'

    def holds(self) -> Column:
        return F.col(self.column).isNotNull()


@dataclass(frozen=True)
class AtLeast:
    """Every row is at or above a bound. Metric: share of rows; NULL is below."""

    column: str
    bound: float

    def __str__(self) -> str:
        return f'ColumnValues "{self.column}" >= {self.bound:g}'

    def holds(self) -> Column:
        return F.coalesce(F.col(self.column) >= F.lit(self.bound), F.lit(False))


@dataclass(frozen=True)
class IsUnique:
    """Every key occurs once. Metric: rows whose key occurs exactly once / rows."""

    column: str

    def __str__(self) -> str:
        return f'IsUnique "{self.column}"'


DatasetRule = IsComplete | AtLeast | IsUnique


class GateFailure(RuntimeError):
    """At least one dataset rule failed; ``results`` holds the judged rules."""

    def __init__(self, results: Sequence[Row]):
        self.results = list(results)
        failed = [f"{r.entity}: {r.rule}" for r in self.results if r.outcome == "Failed"]
        super().__init__("data quality gate failed for " + "; ".join(failed))


def _passing(frame: DataFrame, rules: Sequence[DatasetRule]) -> DataFrame:
    """One row per rule: position, rule text, passing rows and total rows.

    Row-wise rules are carried as partial sums through the grouping that the first uniqueness
    rule needs anyway, so a suite costs one scan and one shuffle. Counts are combined
    map-side, so a hot key travels as one row per map task. Each further uniqueness rule adds
    its own grouping.
    """
    row_wise = [(i, r) for i, r in enumerate(rules) if not isinstance(r, IsUnique)]
    unique = [(i, r) for i, r in enumerate(rules) if isinstance(r, IsUnique)]
    hits = [F.sum(r.holds().cast("long")).alias(f"p{i}") for i, r in row_wise]

    def listed(one: DataFrame, wanted: list[tuple[int, DatasetRule]]) -> DataFrame:
        entries = F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(str(r)).alias("rule"),
                     F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("long").alias("passing"),
                     F.col("total"))
            for i, r in wanted
        ])
        return one.select(F.inline(entries))

    def by_key(rule: IsUnique, position: int, carried: Sequence[Column]) -> DataFrame:
        grouped = frame.groupBy(F.col(rule.column).alias("k")).agg(F.count(F.lit(1)).alias("n"), *carried)
        single = F.sum(F.when(F.col("k").isNotNull() & (F.col("n") == 1), 1).otherwise(0)).alias(f"p{position}")
        kept = [F.sum(f"p{i}").alias(f"p{i}") for i, _ in row_wise] if carried else []
        return grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), single, *kept)

    if not unique:
        return listed(frame.agg(F.count(F.lit(1)).alias("total"), *hits), row_wise)
    (first_at, first), *others = unique
    parts = [listed(by_key(first, first_at, hits), [*row_wise, (first_at, first)])]
    parts += [listed(by_key(rule, at, ()), [(at, rule)]) for at, rule in others]
    return reduce(DataFrame.unionByName, parts)


def passing_by(frame: DataFrame, rules: Sequence[DatasetRule], part: str) -> DataFrame:
    """``part``, position, rule, passing and total rows, one row per part and rule.

    Parts can be added up where no key is in two of them, as with buckets of the key; a uniqueness
    rule on another column needs :func:`evaluate` over the whole.
    """
    counted = []
    for i, rule in enumerate(rules):
        if isinstance(rule, IsUnique):
            keys = frame.groupBy(part, F.col(rule.column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
            one = keys.groupBy(part).agg(F.sum(F.when(F.col("k").isNotNull() & (F.col("n") == 1), 1).otherwise(0)).alias("passing"), F.sum("n").alias("total"))
        else:
            one = frame.groupBy(part).agg(F.count_if(rule.holds()).alias("passing"), F.count(F.lit(1)).alias("total"))
        counted.append(one.select(part, F.lit(i).alias("position"), F.lit(str(rule)).alias("rule"), "passing", "total"))
    return reduce(DataFrame.unionByName, counted)


def evaluate(frame: DataFrame, entity: str, rules: Sequence[DatasetRule]) -> DataFrame:
    """Judge a candidate dataset: one row per rule with metric, outcome and reason.

    An empty candidate (or an empty suite) is SKIPPED: nothing passed, nothing failed.
    """
    return judge(_passing(frame, rules), entity)


def evaluate_parts(parts: Sequence[DataFrame], entity: str, rules: Sequence[DatasetRule]) -> DataFrame:
    """:func:`evaluate` of a dataset in parts that share no key of its uniqueness rules."""
    counted = reduce(DataFrame.unionByName, [_passing(part, rules) for part in parts])
    return judge(counted.groupBy("position", "rule").agg(F.sum("passing").alias("passing"), F.sum("total").alias("total")), entity)


def judge(passing: DataFrame, entity: str) -> DataFrame:
    """Metric, outcome and reason of each rule, from its passing and total rows."""
    metric = F.col("passing") / F.nullif(F.col("total"), F.lit(0))
    outcome = (
        F.when(F.col("total") == 0, "Skipped").when(F.col("passing") == F.col("total"), "Passed").otherwise("Failed")
    )
    return passing.select(
        F.lit(entity).alias("entity"),
        "position",
        "rule",
        "total",
        F.round(metric, 6).alias("metric"),
        outcome.alias("outcome"),
        F.when(outcome == "Failed", F.format_string("%d of %d rows do not satisfy the rule",
                                                    F.col("total") - F.col("passing"), F.col("total"))
               ).alias("failure_reason"),
    )


def summarise(results: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Passed and failed rules, score and status per dataset (or overall with ``by=()``)."""
    passed = F.count_if(F.col("outcome") == "Passed")
    failed = F.count_if(F.col("outcome") == "Failed")
    return (
        results.groupBy(*by)
        .agg(passed.alias("passed_rules"), failed.alias("failed_rules"))
        .withColumns({
            "quality_score": score(F.col("passed_rules"), F.col("passed_rules") + F.col("failed_rules")),
            "status": F.when(F.col("failed_rules") > 0, "FAIL")
            .when(F.col("passed_rules") == 0, "SKIPPED").otherwise("PASS"),
        })
    )


def gate(results: DataFrame | Iterable[DataFrame]) -> list[Row]:
    """Collect the (few) rule rows of one or many datasets; raise if any rule failed.

    Call it before the first write of a group, so either all tables are written or none.
    """
    frames = [results] if isinstance(results, DataFrame) else list(results)
    if not frames:
        return []
    rows = reduce(DataFrame.unionByName, frames).orderBy("entity", "position").collect()
    if any(r.outcome == "Failed" for r in rows):
        raise GateFailure(rows)
    return rows


def stage_counts(frame: DataFrame, accepted: Column, key: str | Column) -> DataFrame:
    """input, output, rejected and duplicate rows of a stage, in one pass.

    Output is the number of distinct accepted keys; duplicates are the other accepted rows.
    """
    counted = frame.agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if(accepted).alias("accepted"),
        F.count_distinct(F.when(accepted, key if isinstance(key, Column) else F.col(key))).alias("output_count"),
    )
    return counted.select(
        "input_count",
        "output_count",
        (F.col("input_count") - F.col("accepted")).alias("rejected_count"),
        (F.col("accepted") - F.col("output_count")).alias("duplicate_count"),
    )
