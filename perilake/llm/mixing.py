"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in order of their ids, form one stream of words that is packed into blocks
of ``block_words`` words. An output shard of ``shard_slots`` slots draws its sources slot by slot
from the target shares, so its source counts are one multinomial draw. The slots of a source are
numbered through all shards; slot ``k`` reads block ``permutation(k mod blocks)`` of pass
``k div blocks``, a keyed swap-or-not permutation of the source's block numbers, so no list is
shuffled. Draws beyond a source's quota are left empty and the sources that fell short get their
rest in closing shards; totals are then the quotas exactly. Blocks are joined by (source, number).

Every draw is a hash of (seed, shard, slot, source), so runs agree. Positions come from prefix sums
over ranges: a source with a third of all rows is cut into many ranges.

Defined results: a missing text has size 0; a missing source is a source of its own, last in order;
rows with the same id are documents of their own. An empty table gives an empty result. A source
without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import durable, query, table
from perilake.operators.ordering import ordered_index, running_before
from perilake.session import reducers

WEIGHTS = (5, 2, 1)
ROUNDS = 16  # of the permutation
SOURCE = ["__none", "__name"]  # whether the source is missing, and its name; never NULL, in order


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """Pseudorandom number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(sized: DataFrame, share: float, limit: float) -> DataFrame:
    """Per source: size, weight and target, where targets stop at ``limit`` times the size.

    Sources by rising ratio of limit to weight reach their limit first, so one pass over that order
    finds who stops: a source stops if its ratio is below the level the rest could still get.
    """
    totals = sized.groupBy(*SOURCE).agg(F.sum("__size").alias("__total"))
    placed = ordered_index(totals, SOURCE, "__rank")
    weighed = placed.withColumn("__weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("__rank") % len(WEIGHTS) + 1).cast("int")))
    weighed = weighed.withColumns({"__most": F.col("__total") * F.lit(float(limit)), "__ratio": F.col("__total") * F.lit(float(limit)) / F.col("__weight")})
    before = durable(running_before(weighed, ["__ratio", "__rank"], {"__stopped": "__most", "__gone": "__weight"}))
    whole = before.agg(F.sum("__total").alias("__all"), F.sum("__weight").alias("__weights"))
    # What is left for this source and those after it, per unit of weight, if all before it stopped.
    level = (F.col("__all") * F.lit(float(share)) - F.col("__stopped")) / (F.col("__weights") - F.col("__gone"))
    levelled = before.join(F.broadcast(whole)).withColumn("__level", level)  # one row of totals
    free = levelled.filter("__level < __ratio").agg(F.min(F.struct("__ratio", "__rank", "__level")).alias("__free"))
    bounded = levelled.join(F.broadcast(free)).withColumn("__fair", F.col("__weight") * F.col("__free.__level"))
    return bounded.select(
        *SOURCE, "__rank", F.col("__total").alias("__source_size"), "__weight",
        F.when(F.col("__free").isNull(), F.col("__most")).otherwise(F.least("__most", "__fair")).alias("__target"),
    )


def permuted(frame: DataFrame, position: str, size: str, out: str, *key: Column) -> DataFrame:
    """Adds ``out``: a pseudorandom permutation of 0 .. size-1 applied to ``position``.

    Swap-or-not: in each round a number and its mirror image about a keyed centre change places or
    not, decided by a hash of the larger of the two. Each round is its own inverse, for any size.
    """
    def turn(number: Column, step: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, step), F.col(size)) - number, F.col(size))
        swap = F.xxhash64(F.greatest(number, mirror), *key, step + ROUNDS).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(number)

    return frame.withColumn(out, F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.col(position), turn))


def draw_shards(quotas: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, source rank, first, last): numbered slots of a source in an output shard.

    The number line [0, 1) is cut by the sources' shares and covered by a grid; a slot meets only the
    sources of its grid cell, so the lookup is an equality join whatever the number of sources.
    """
    spark = quotas.sparkSession
    line = durable(running_before(quotas.filter("__quota > 0"), ["__rank"], {"__before": "__quota"}))
    total, sources = line.agg(F.coalesce(F.sum("__quota"), F.lit(0)), F.count(F.lit(1))).first()  # two numbers
    cells = max(64, 4 * sources)
    edge = lambda c: (c / F.lit(float(max(total, 1)))).cast("double")
    cut = line.withColumns({"__lo": edge(F.col("__before")), "__hi": edge(F.col("__before") + F.col("__quota"))})
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    grid = cut.withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi"))))).select("__cell", "__lo", "__hi", "__rank")
    slots = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("__shard"), F.col("id").alias("__slot"))
    thrown = slots.withColumn("__u", uniform(F.lit(seed), F.col("__shard"), F.col("__slot"))).withColumn("__cell", cell(F.col("__u")))
    met = thrown.join(grid, "__cell").filter("__lo <= __u AND __u < __hi")
    counts = met.groupBy("__shard", "__rank").agg(F.count(F.lit(1)).alias("__n"))
    shards = -(-total // shard_slots)
    # Closing shards hold what the draws left short; a source's draws end at its quota.
    drawn = counts.groupBy("__rank").agg(F.sum("__n").alias("__drawn"))
    short = line.join(drawn, "__rank", "left").withColumn("__n", F.col("__quota") - F.coalesce("__drawn", F.lit(0))).filter("__n > 0")
    closing = short.select(F.lit(shards).cast("long").alias("__shard"), "__rank", "__n")
    numbered = running_before(counts.unionByName(closing), ["__shard"], {"__first": "__n"}, within=["__rank"])
    kept = numbered.join(line.select("__rank", "__quota", "__blocks"), "__rank").filter("__first < __quota")
    return kept.withColumn("__last", F.least(F.col("__first") + F.col("__n"), F.col("__quota")) - 1)


def mix_sources(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
    limit: float = 2.0, block_words: int = 64, shard_slots: int = 4096, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents' part in it.

    First: one row per slot, ``shard, slot, source, block, pass`` (block numbers count words of the
    source in steps of ``block_words``). Second: per document ``doc_id, size, source_size, target,
    taken`` and its place ``first_word`` in the source's stream.
    """
    # Named apart from any input column; a size is computed once and written down with its offset.
    sized = documents.select(
        F.col(doc_id).alias("__doc"), F.col(source).isNull().alias("__none"), F.coalesce(F.col(source), F.lit("")).alias("__name"),
        word_count(text).alias("__size"),
    )
    streams = durable(running_before(sized, ["__doc", "__size"], {"__start": "__size"}, within=SOURCE))
    targets = durable(source_targets(streams, share, limit))
    blocks = F.ceil(F.col("__source_size") / block_words)
    quota = F.when(F.col("__source_size") > 0, F.round(F.col("__target") * F.col("__blocks") / F.col("__source_size"))).otherwise(0)
    quotas = targets.withColumn("__blocks", blocks).withColumn("__quota", F.least(quota, F.floor(F.col("__blocks") * limit)).cast("long"))
    # Few rows that become many: dealt out by number, so they aren't gathered into one task by their bytes.
    shards = draw_shards(quotas, shard_slots, seed).repartition(reducers(documents.sparkSession), "__shard", "__rank")
    slots = shards.withColumn("__k", F.explode(F.sequence("__first", "__last"))).withColumns({
        "__pass": F.floor(F.col("__k") / F.col("__blocks")), "__place": F.col("__k") % F.col("__blocks"),
    })
    mapped = permuted(slots, "__place", "__blocks", "__block", F.lit(seed), F.col("__rank"), F.col("__pass"))

    ranked = streams.join(targets.drop("__target", "__weight"), SOURCE)
    pieces = ranked.filter("__size > 0").withColumn(
        "__block", F.explode(F.sequence(F.floor(F.col("__start") / block_words), F.floor((F.col("__start") + F.col("__size") - 1) / block_words)))
    ).withColumn("__words", F.least(F.col("__start") + F.col("__size"), (F.col("__block") + 1) * block_words) - F.greatest(F.col("__start"), F.col("__block") * block_words))
    reads = mapped.groupBy("__rank", "__block").agg(F.count(F.lit(1)).alias("__reads"))
    parts = pieces.select("__rank", "__block", "__doc", "__start", "__size", "__words").join(reads, ["__rank", "__block"])
    used = parts.groupBy("__rank", "__start", "__doc", "__size").agg(F.sum(F.col("__words") * F.col("__reads")).alias("__taken"))
    used = used.select(F.col("__rank").alias("__r"), F.col("__start").alias("__s"), "__taken")
    whole = streams.join(targets, SOURCE)
    named = F.when(~F.col("__none"), F.col("__name")).alias("source")
    at = (F.col("__rank") == F.col("__r")) & (F.col("__start") == F.col("__s")) & (F.col("__size") > 0)
    report = whole.join(used, at, "left").select(
        F.col("__doc").alias("doc_id"), named, F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"), F.col("__target").cast("double").alias("target"),
        F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"), F.col("__start").alias("first_word"),
    )
    mixed = mapped.join(targets.select("__rank", *SOURCE), "__rank").select(
        F.col("__shard").alias("shard"), F.col("__k").alias("slot"), named,
        F.col("__block").alias("block"), F.col("__pass").alias("pass"),
    )
    return mixed, report


@query("op8_mixing_sources")
def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return report.select("doc_id", "size", "source_size", "target", "taken")
