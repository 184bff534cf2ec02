"""Star joins, integrity checks, set comparisons and as-of lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilake.functions.temporal import micros
from perilake.functions.text import present
from perilake.operators.ordering import range_ordered, running_before
from perilake.session import durable, tasks_for


@dataclass(frozen=True)
class Dimension:
    """One arm of a star: ``frame`` joined on ``on`` (column so far) == ``key``.

    ``columns`` maps output names to dimension columns or expressions; nothing else is read.
    """

    frame: DataFrame
    key: str
    on: str
    columns: Mapping[str, str | Column] = field(default_factory=dict)
    how: str = "left"


def star_join(fact: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Join a fact with dimensions that are unique per key.

    No broadcast is forced. Spark broadcasts a dimension when its measured size is below
    ``autoBroadcastJoinThreshold`` and shuffles otherwise, splitting skewed partitions (AQE).
    Each dimension is cut to the columns used before the join.
    """
    joined = fact
    for number, dim in enumerate(dimensions):
        alias = f"_dim{number}"
        picked = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in dim.columns.items()]
        side = dim.frame.select(F.col(dim.key).alias(alias), *picked)
        joined = joined.join(side, F.col(dim.on) == F.col(alias), dim.how).drop(alias)
    return joined


def heavy_keys(frame: DataFrame, key: str, share: float = 0.01, tracked: int = 10_000) -> list:
    """Values of a key that hold at least ``share`` of the rows, at most 1/share of them, most first.

    A mergeable sketch of frequent items over one column: no shuffle of keys. Its counts are low by
    at most a small multiple of rows/``tracked``, so a value near ``share`` may be missing. Use
    it to choose how rows are dealt, never which rows count.
    """
    return heavy_keys_and_rows(frame, key, share, tracked)[0]


def heavy_keys_and_rows(frame: DataFrame, key: str, share: float = 0.01, tracked: int = 10_000) -> tuple[list, int]:
    """:func:`heavy_keys`, and the number of all rows from the same pass."""
    most = int(1 / share)
    one = frame.agg(F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top"), F.count(key).alias("n"), F.count(F.lit(1)).alias("all")).first()
    return [r.item for r in one.top or () if r.item is not None and r["count"] >= share * one.n], one["all"]


def dealt_by(frame: DataFrame, key: str) -> list[DataFrame]:
    """The frame in parts that share no key: rows dealt by ``key`` to as many tasks as they need, and rows of heavy keys, if any, as they are.

    A part that is dealt is grouped by the key without another shuffle, each task holding a bounded number of
    rows. Rows of a heavy key are few keys, so Spark combines them before it shuffles them.
    """
    heavy, rows = heavy_keys_and_rows(frame, key)
    tasks = tasks_for(frame.sparkSession, rows)
    if not heavy:
        return [frame.repartition(tasks, key)]
    busy = F.coalesce(F.col(key).isin(*heavy), F.lit(False))
    return [frame.filter(~busy).repartition(tasks, key), frame.filter(busy)]


def hot_keys(frame: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys holding at least ``share`` of the rows, and how many: never more than 1/share of them."""
    sized = frame.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = sized.agg(F.sum("_rows").alias("_all"))
    return sized.join(F.broadcast(total)).filter(F.col("_rows") >= F.greatest(F.col("_all") * share, F.lit(1))).select(key, "_rows")


def spread_join(
    fact: DataFrame, other: DataFrame, key: str, how: str = "inner", share: float = 0.01, rows_per_task: int = 1_000_000,
) -> DataFrame:
    """Equi-join of two large frames where single keys of ``fact`` hold much of it.

    Rows of a hot key are spread over as many sub-keys as it has times ``rows_per_task`` rows, and
    the matching rows of the other side are repeated for each. The sub-key comes from a hash of the
    row and its map partition, so a retried task sends its rows to the same place and exact copies
    still spread. There are at most 1/share hot keys whatever the size of the table, so their list is
    always small enough to broadcast, and it must be: the salt has to be read before the rows are
    shuffled.
    """
    if how not in ("inner", "left"):
        raise ValueError("spread_join supports inner and left joins")
    copies = F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_copies")
    hot = F.broadcast(durable(hot_keys(fact, key, share).select(key, copies)))
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[c for c in fact.columns]), F.coalesce("_copies", F.lit(1))).cast("int")
    left = fact.join(hot, key, "left").withColumn("_spread", salt).drop("_copies")
    every = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    right = other.join(hot, key, "left").withColumn("_spread", F.explode(every)).drop("_copies")
    return left.join(right, [key, "_spread"], how).drop("_spread")


# --- integrity ------------------------------------------------------------------------


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, nullable: bool = False) -> DataFrame:
    """Child rows whose foreign key has no parent. Blank keys count only if not nullable."""
    parents = parent.select(F.col(pk).alias("_pk"))
    broken = child.join(parents, F.col(fk) == F.col("_pk"), "left_anti")
    return broken.filter(present(F.col(fk).cast("string"))) if nullable else broken


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str, nullable: bool = False) -> DataFrame:
    """Orphan rows and keys, pre-aggregated by key so a hot foreign key is one row."""
    sized = child.groupBy(fk).agg(F.count(F.lit(1)).alias("_rows"))
    lost = orphans(sized, fk, parent, pk, nullable)
    return lost.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")
    )


def integrity_report(tables: Mapping[str, DataFrame], keys: Sequence[tuple[str, str, str, str, bool]]) -> DataFrame:
    """One row per foreign key with its orphan counts."""
    parts = [
        orphan_count(tables[child], fk, tables[parent], pk, nullable).select(
            F.lit(f"{child}.{fk}").alias("foreign_key"), F.lit(f"{parent}.{pk}").alias("references"),
            "orphan_rows", "orphan_keys",
        )
        for child, fk, parent, pk, nullable in keys
    ]
    return reduce(DataFrame.unionByName, parts)


def inconsistent_owner(
    child: DataFrame, fk: str, owner: str, parent: DataFrame, pk: str, parent_owner: str,
) -> DataFrame:
    """Child rows whose own owner differs from their parent's (claim customer vs policy customer)."""
    owners = parent.select(F.col(pk).alias("_pk"), F.col(parent_owner).alias("expected_owner"))
    return child.join(owners, F.col(fk) == F.col("_pk")).drop("_pk").filter(
        ~F.col(owner).eqNullSafe(F.col("expected_owner"))
    )


# --- sets -----------------------------------------------------------------------------


def only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def key_set_difference(expected: DataFrame, visible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of keys missing from and unexpected in ``visible``, and whether the sets agree."""
    sides = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("v")).unionByName(
        visible.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("v"))
    )
    per_key = sides.groupBy(*keys).agg(F.max("e").alias("e"), F.max("v").alias("v"))
    return per_key.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_keys"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("visible_keys"),
        F.count_if((F.col("e") == 1) & (F.col("v") == 0)).alias("missing_keys"),
        F.count_if((F.col("e") == 0) & (F.col("v") == 1)).alias("unexpected_keys"),
    ).withColumn("complete", (F.col("missing_keys") == 0) & (F.col("unexpected_keys") == 0))


def keys_in_several(frame: DataFrame, key: str, group: str) -> DataFrame:
    """Keys present in more than one group (splits must be disjoint)."""
    return frame.groupBy(key).agg(
        F.min(group).alias("_low"), F.max(group).alias("_high")
    ).filter(F.col("_low") != F.col("_high")).select(key)


def changed_versions(previous: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """added / changed / unchanged / deleted per key, comparing a version column."""
    both = previous.select(F.col(key), F.col(version).alias("_old")).join(
        current.select(F.col(key), F.col(version).alias("_new")), key, "full_outer"
    )
    return both.select(
        key,
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed").alias("change"),
    )


def new_files(landing: DataFrame, ledger: DataFrame, file_id: str = "source_file_id") -> DataFrame:
    """Landed files with status NEW or DUPLICATE by content, name ignored.

    A content already in the ledger is a duplicate; within one landing the first object name
    of a content is the new one.
    """
    done = ledger.select(file_id).distinct().withColumn("_done", F.lit(True))
    first = landing.groupBy(file_id).agg(F.min("source_object").alias("_first"))
    marked = landing.join(first, file_id).join(done, file_id, "left")
    is_new = F.col("_done").isNull() & (F.col("source_object") == F.col("_first"))
    return marked.withColumn("status", F.when(is_new, "NEW").otherwise("DUPLICATE")).drop("_done", "_first")


# --- manifests ------------------------------------------------------------------------


def semi_by_manifest(frame: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the manifest names."""
    return frame.join(manifest.select(*keys), list(keys), "left_semi")


def match_manifest(features: DataFrame, manifest: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Manifest rows with their features; ``match`` says ok, label mismatch or missing."""
    side = features.withColumns({"_label": F.col(label), "_seen": F.lit(True)}).drop(label)
    matched = manifest.join(side, list(keys), "left")
    verdict = (
        F.when(F.col("_seen").isNull(), "missing")
        .when(F.col("_label").eqNullSafe(F.col(label)), "ok").otherwise("label_mismatch")
    )
    return matched.withColumn("match", verdict).drop("_label", "_seen")


# --- as-of ----------------------------------------------------------------------------


def asof_join(
    facts: DataFrame, versions: DataFrame, *, key: str, time: str, version_time: str,
    take: Mapping[str, str], effective_to: str | None = None, tie: str | None = None,
) -> DataFrame:
    """Add the newest version at or before each fact's time, or NULL.

    The answer depends only on (key, time), so facts are first reduced to their distinct
    points; rows at one point, even a third of the table, ask once. Points and versions are
    stacked, cut into ranges of (key, time) by row count and carried forward per (key, range), so
    a busy key is spread however dense its time is. What a range inherits is the newest version of
    earlier ranges, from one row per (key, range). No fact meets more than the version it takes.

    ``effective_to`` drops the taken version when the fact is at or past its end. ``tie``
    settles versions with equal time. ``take`` maps output names to version columns.
    """
    payload = F.struct(
        F.col("_t").alias("t"),
        (F.col(tie) if tie else F.lit(0)).alias("tie"),
        *[F.col(c).alias(name) for name, c in take.items()],
        *([micros(effective_to).alias("ends")] if effective_to else []),
    )
    keyed = (
        versions.withColumn("_t", micros(version_time)).filter(F.col("_t").isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).alias("_k"), "_t", payload.alias("_version"), F.lit(1).alias("_kind"))
    )
    empty = F.lit(None).cast(keyed.schema["_version"].dataType).alias("_version")
    points = facts.select(F.col(key).alias("_k"), micros(time).alias("_t")).dropna().distinct().select(
        "_k", "_t", empty, F.lit(2).alias("_kind")
    )
    stacked = range_ordered(points.unionByName(keyed), ["_k", "_t", "_kind", F.col("_version").asc_nulls_first()]).withColumnRenamed("_part", "_b").drop("_local")

    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    newest = stacked.groupBy("_k", "_b").agg(F.max("_version").alias("_version"))
    inherited = newest.select("_k", "_b", F.last("_version", ignorenulls=True).over(earlier).alias("_version")).filter(
        F.col("_version").isNotNull()
    ).select("_k", F.lit(None).cast("long").alias("_t"), "_b", "_version", F.lit(0).alias("_kind"))

    # NULL time (the inherited version) sorts first, then versions before points of equal time.
    inside = Window.partitionBy("_k", "_b").orderBy(
        F.col("_t").asc_nulls_first(), "_kind", F.col("_version").asc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = (
        stacked.unionByName(inherited)
        .withColumn("_version", F.last("_version", ignorenulls=True).over(inside))
        .filter(F.col("_kind") == 2)
    )
    valid = F.lit(True)
    if effective_to:
        valid = F.col("_version.ends").isNull() | (F.col("_t") < F.col("_version.ends"))
    taken = answered.select("_k", "_t", *[F.when(valid, F.col(f"_version.{name}")).alias(name) for name in take])
    return facts.join(taken, (F.col(key) == F.col("_k")) & (micros(time) == F.col("_t")), "left").drop("_k", "_t")


def future_reference_count(facts: DataFrame, versions: DataFrame, *, key: str, time: str, version_time: str) -> DataFrame:
    """Joined reference rows, and those newer than the prediction they would be used for.

    Counted without pairing: facts and versions are counted per (key, time), and the versions later
    than a fact are a running count over the key from its newest version back.
    """
    asked = facts.select(F.col(key).alias("_k"), F.col(time).cast("timestamp").alias("_t"), F.lit(1).alias("_facts"), F.lit(0).alias("_versions"))
    known = versions.select(F.col(key).alias("_k"), F.col(version_time).cast("timestamp").alias("_t"), F.lit(0).alias("_facts"), F.lit(1).alias("_versions"))
    counted = durable(
        asked.unionByName(known).filter(F.col("_k").isNotNull()).groupBy("_k", "_t")
        .agg(F.sum("_facts").alias("_facts"), F.sum("_versions").alias("_versions"))
    )
    pairs = counted.groupBy("_k").agg((F.sum("_facts").cast("decimal(38,0)") * F.sum("_versions").cast("decimal(38,0)")).alias("n"))
    later = running_before(counted.filter(F.col("_t").isNotNull()).withColumn("_back", -micros("_t")), ["_back"], {"_later": "_versions"}, within=["_k"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return pairs.agg(total("n").alias("compared_rows")).join(later.agg(total(F.col("_facts") * F.col("_later")).alias("future_rows")))
