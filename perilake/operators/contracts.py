"""Row contracts: schema checks, typing, named rules and quarantine."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, StructType, TimestampType

from perilake.functions.identity import NULL_TOKEN, row_hash
from perilake.functions.temporal import as_date, as_instant
from perilake.functions.text import cleaned, code, names_where


class SchemaMismatch(ValueError):
    """A landed table does not have the columns its contract names."""


@dataclass(frozen=True)
class Rule:
    """A named row rule. NULL counts as a failure."""

    name: str
    holds: Column

    @property
    def broken(self) -> Column:
        return ~F.coalesce(self.holds, F.lit(False))


@dataclass(frozen=True)
class TableContract:
    """Columns and types of one entity as a DDL string, plus how text is treated."""

    entity: str
    key: str
    ddl: str
    optional_ddl: str = ""
    codes: tuple[str, ...] = ()
    verbatim: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()
    gold_table: str = ""

    @cached_property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @cached_property
    def optional(self) -> StructType:
        return StructType.fromDDL(self.optional_ddl) if self.optional_ddl else StructType()

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def types(self) -> dict[str, DataType]:
        return {f.name: f.dataType for f in [*self.schema, *self.optional]}


def schema_errors(headers: Sequence[str], required: Iterable[str]) -> list[str]:
    """Duplicate and missing header names, as messages."""
    names = [h.strip() for h in headers]
    repeated = sorted({n for n in names if names.count(n) > 1})
    missing = sorted(set(required) - set(names))
    found = []
    if repeated:
        found.append("duplicate columns: " + ",".join(repeated))
    if missing:
        found.append("missing columns: " + ",".join(missing))
    return found


def require_columns(frame: DataFrame, required: Iterable[str], label: str = "table") -> DataFrame:
    found = schema_errors(frame.columns, required)
    if found:
        raise SchemaMismatch(f"{label}: " + "; ".join(found))
    return frame


def project_contract(frame: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Contract columns in contract order; unknown columns are dropped."""
    require_columns(frame, required)
    return frame.select(*required, *[c for c in optional if c in frame.columns])


def add_lineage(
    frame: DataFrame, *, run_id: str, source_system: str, source_object: str | Column,
    file_id: str | Column | None = None, schema_version: int = 2, at: Column | None = None,
    hash_columns: Sequence[str] | None = None, null_token: str | None = NULL_TOKEN,
) -> DataFrame:
    """Technical columns of a Bronze row. ``at`` pins the clock for reproducible runs."""
    literal = lambda v: v if isinstance(v, Column) else F.lit(v)
    added = {
        "_run_id": F.lit(run_id),
        "_source_system": F.lit(source_system),
        "_source_object": literal(source_object),
        "_ingested_at": F.current_timestamp() if at is None else at,
        "_schema_version": F.lit(schema_version),
        "_record_hash": row_hash(list(hash_columns or frame.columns), null_token),
    }
    if file_id is not None:
        added["_source_file_id"] = literal(file_id)
    return frame.withColumns(added)


def conform(frame: DataFrame, contract: TableContract) -> DataFrame:
    """Cast text columns to the contract's types in one projection; bad text becomes NULL."""

    def typed(name: str, kind: DataType) -> Column:
        if name in contract.codes:
            return code(name)
        if name in contract.verbatim:
            return F.col(name)
        if isinstance(kind, StringType):
            return cleaned(name)
        if isinstance(kind, DateType):
            return as_date(name)
        if isinstance(kind, TimestampType):
            return as_instant(name)
        return cleaned(name).try_cast(kind)

    return frame.withColumns({n: typed(n, k) for n, k in contract.types().items() if n in frame.columns})


def all_hold(rules: Sequence[Rule]) -> Column:
    """True only when every rule is true; never NULL."""
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.holds
    return F.coalesce(verdict, F.lit(False))


def failed_rules(rules: Sequence[Rule]) -> Column:
    """Sorted distinct names of the broken rules of a row."""
    return F.sort_array(names_where((rule.broken, rule.name) for rule in rules))


def rule_violations(frame: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and broken rule.

    The outer explode matters: for a plain one Spark adds a not-empty filter below it and
    repeats every rule in that filter.
    """
    listed = frame.select(*keep, F.explode_outer(failed_rules(rules)).alias("failed_rule"))
    return listed.filter(F.col("failed_rule").isNotNull())


@dataclass(frozen=True)
class Split:
    """Valid rows, quarantine records, and a one-row frame with the size of both."""

    valid: DataFrame
    rejected: DataFrame
    sizes: DataFrame


def split_by_rules(
    frame: DataFrame, rules: Sequence[Rule], *, run_id: str, source: str, entity: str,
    record_columns: Sequence[str], label: str | None = None, at: Column | None = None,
) -> Split:
    """Valid rows unchanged, and quarantine records for the rest.

    Both sides are narrow filters of the same plan: no shuffle, and the filter on plain
    columns is pushed into the scan. ``label`` replaces the rule names by one contract name.
    """
    ok = all_hold(rules)
    names = F.array(F.lit(label)) if label else failed_rules(rules)
    rejected = frame.filter(~ok).select(
        F.lit(run_id).alias("run_id"),
        F.lit(source).alias("source"),
        F.lit(entity).alias("entity"),
        F.to_json(F.struct(*record_columns)).alias("source_record"),
        names.alias("failed_rules"),
        (F.current_timestamp() if at is None else at).alias("rejected_at"),
    )
    sizes = frame.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    return Split(frame.filter(ok), rejected, sizes)


def drop_sensitive(frame: DataFrame, columns: Sequence[str], at: Column | None = None) -> DataFrame:
    """Gold projection: without free text and operational columns, stamped as effective."""
    return frame.drop(*columns).withColumn("_effective_at", F.current_timestamp() if at is None else at)
