"""Similarity join of documents on word n-gram sets by a prefix tree.

1. Sets. A text's n-grams are hashed to 64 bits. A count sketch over all texts (fixed size, merged
   over all tasks) ranks hash cells from rare to common; an n-gram's key is (rank of its cell, rest
   of its hash), a one-to-one recoding whose order is the global order of all sets.
2. Classes. Documents with equal sets are one class; copies are never paired.
3. Clusters. Two linked sets share at least l of their rarest keys (prefix filter: of n keys, the
   first n - ceil(t n) + l, where l grows with n). The order begins with the keys of rare cells that
   one class alone has: they match nothing, and a class with so many of them that fewer than l other
   keys are left in its prefix links with nothing. What is left is judged again among itself, with
   its rare keys and its prefix: two linked sets share all of them but as many as may differ. Classes
   that share enough are paired, or chained along keys of many classes, so texts that have a passage
   in common but not most of their words make no clusters. Components of these edges are clusters:
   no link leaves a cluster.
4. Prefix tree. A cluster's sets, most common key first, go into a tree of shared paths. A set
   traverses the tree before it is added: the overlap with a path is counted once for all sets
   below, and a subtree is pruned when even its remaining lengths cannot reach the threshold, or
   when all of it is already connected with the set.
5. Large clusters are cut into blocks of bounded size in order of set size. A few central sets
   visit every block and join the blocks' groups; then only sets outside a cluster's main group
   visit the other blocks of fitting sizes. Every pair is either compared or known to be connected.

Defined results: a text of fewer than ``n`` words has its whole word sequence as its only element; a
text without words (also a missing one) has an empty set and links with nothing. Rows are documents
of their own, also with repeated ids; a missing id never is a component's id unless all are missing.
An empty table gives an empty result. Texts are read whole, and no group, partner or candidate is
capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilake.llm.common import column_values, durable, forget, int64, mix, query, same, table
from perilake.llm.components import Forest, components
from perilake.operators.ordering import running_before
from perilake.session import reducers

CELL_BITS = 18  # of the count sketch
CHUNK = 4096  # cells sent as one row
REST = np.uint64((1 << (64 - CELL_BITS)) - 1)
SHIFT = np.uint64(64 - CELL_BITS)
BLOCK_KEYS = 1 << 18  # keys of the sets in a block of a cluster
BLOCK_SETS = 160  # sets in a block
PIVOTS = 4
BROADCAST_ROWS = 300_000  # of about 60 bytes
BROADCAST_MARKS = 3_000_000  # of 8 bytes
MARKS = 1 << 23  # hashes of ids are cut to as many values
ROUNDS = 3  # of leaving out classes that link with nothing
FEW = 16  # classes with a key that are paired, not chained


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def ngram_hashes(text: str | None, n: int, words: WordHashes) -> np.ndarray:
    """Hashes of the n-grams of a text, in order and with repeats. ``bytes`` lower-cases exactly A-Z and splits at exactly space and 09-0D."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(n, len(found))
    with np.errstate(over="ignore"):
        total = np.full(len(found) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += each[i : len(found) - width + 1 + i]
    return mix(total)


def count_cells(documents: DataFrame, n: int) -> np.ndarray:
    """Sets holding an n-gram of each hash cell, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, words = np.zeros(1 << CELL_BITS, dtype=np.uint32), WordHashes()
        for batch in batches:
            sets = [np.unique(ngram_hashes(t, n, words)) for t in column_values(batch, "__text")]
            cells += np.bincount((np.concatenate(sets) >> SHIFT).astype(np.int64), minlength=1 << CELL_BITS).astype(np.uint32)
        parts = cells.reshape(-1, CHUNK)
        used = np.nonzero(parts.any(1))[0]
        yield pa.RecordBatch.from_arrays([int64(used), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(column_values(batch, "chunk"), column_values(batch, "counts"), strict=True):
                part = np.frombuffer(counts, dtype=np.uint32).astype(np.uint64)
                total[chunk] = total[chunk] + part if chunk in total else part
        yield pa.RecordBatch.from_arrays([int64(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    kind = "chunk long, counts binary"
    merged = documents.mapInArrow(count, kind).repartition(reducers(documents.sparkSession), "chunk").mapInArrow(add, kind)
    out = np.zeros((1 << CELL_BITS) // CHUNK * CHUNK, dtype=np.uint64).reshape(-1, CHUNK)
    for row in merged.collect():  # 2 ** CELL_BITS counters, whatever the input
        out[row.chunk] = np.frombuffer(row.counts, dtype=np.uint64)
    return out.reshape(-1)


def ordered_keys(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Distinct keys in the global order, rarest cell first."""
    return np.unique((rank[(hashes >> SHIFT).astype(np.int64)] << SHIFT) | (hashes & REST))


def least_shared(n: int) -> int:
    """Keys that two linked sets must share in their prefixes: one, and one more for each hundred."""
    return 1 + n // 100


def prefix_length(n: int, percent: int) -> int:
    """Any linked set shares its first ``least_shared`` common keys within this many first keys."""
    return min(n, n - (percent * n + 99) // 100 + least_shared(n))


def digest(keys: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(keys.tobytes())


def rare_below(counts: np.ndarray, percent: int) -> np.uint64:
    """The key below which keys are rare: cells from the rarest on, with somewhat more of all n-grams than prefixes have."""
    share = min(1.0, 0.02 + 1.4 * (100 - percent) / 100)
    cells = np.searchsorted(np.cumsum(np.sort(counts)), share * float(counts.sum()))
    return np.uint64(min(int(cells), len(counts) - 1)) << SHIFT


def own_keys(rows: DataFrame, name: str) -> DataFrame:
    """(name, own): how many of a class's rare keys no other class has. Copies have one name, so they count once."""
    rare = rows.select(name, F.explode(F.slice("keys", 1, F.col("n_rare"))).alias("key"))
    alone = rare.groupBy("key").agg(F.min(name).alias("one"), F.max(name).alias("other")).filter("one = other")
    return alone.groupBy(F.col("one").alias(name)).agg(F.count(F.lit(1)).alias("own"))


def shared_part(size: str, percent: int) -> Column:
    """Keys of a set that any linked set has too, at least."""
    return F.floor((F.col(size) * percent + 99) / 100)


def may_link(described: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """``class, least, size, digest, n_rare, keys`` of the classes that may link.

    Classes are first told apart by a 64-bit mark, half as long as a digest; classes with one mark are
    all kept until digests part them.
    """
    enough = F.coalesce("own", F.lit(0)) <= F.col("size") - shared_part("size", percent)
    marked = facts.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    stay = durable(marked.join(own_keys(described.filter("size > 0"), "mark"), "mark", "left").filter(enough | (F.col("n") > 1)).select("mark"))
    if stay.count() <= BROADCAST_MARKS:
        stay = F.broadcast(stay)
    rest = described.filter("size > 0").join(stay, "mark", "left_semi").groupBy("digest").agg(
        F.min("__id").alias("least"), *[F.first(c).alias(c) for c in ("size", "n_rare", "keys")])
    left = durable(rest.withColumn("class", F.monotonically_increasing_id()))
    for turn in range(1, ROUNDS):
        judged = left.join(own_keys(left, "class"), "class", "left").filter(enough).drop("own")
        before, left = left, durable(judged)
        forget(before)
    return left


def candidate_chains(postings: DataFrame, percent: int) -> DataFrame:
    """(class, prior, shared): edges such that any two classes that may link are connected by them.

    ``postings`` has ``class, size, n_rare, key``: a set's ``n_rare`` rare keys and its prefix. Linked classes
    share ``least_shared`` of the prefix, and all their rare keys but those that may differ, so long sets that
    meet in a few keys or in a passage aren't candidates. A class with fewer shared keys in all is out.
    ``FEW`` classes or less with a key are paired, and a pair is an edge if these keys, and the keys either
    shares in larger companies, could be enough. In larger companies the classes with enough such keys are
    chained in order of size; a chain is cut where sizes are too far apart to link. No group gives more than
    ``FEW`` edges a row.
    """
    company = Window.partitionBy("key")
    # What a class shares with its smallest partner at least.
    needed = F.greatest(F.floor(F.floor(F.col("size") * percent / 100) / 100) + 1, F.col("n_rare") - F.col("size") + shared_part("size", percent))
    met = durable(postings.withColumn("company", F.count(F.lit(1)).over(company)).filter("company > 1").select("class", "size", "n_rare", "key"))
    live = met.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("n_rare").alias("n_rare")).filter(F.col("n") >= needed).select("class")
    left = durable(met.join(live, "class").withColumn("company", F.count(F.lit(1)).over(company)).filter("company > 1"))
    crowded = left.filter(F.col("company") > FEW).groupBy("class").agg(F.count(F.lit(1)).alias("crowded"))

    few = left.filter(F.col("company") <= FEW)
    others = few.select("key", F.col("class").alias("prior"), F.col("size").alias("prior_size"), F.col("n_rare").alias("prior_rare"))
    before = F.struct("prior_size", "prior") < F.struct(F.col("size").alias("prior_size"), F.col("class").alias("prior"))
    together = few.join(others, "key").filter(before & (F.col("prior_size") * 100 >= F.col("size") * percent))
    pairs = together.groupBy("class", "prior").agg(F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("size", "n_rare", "prior_size", "prior_rare")])
    of_class, of_prior = (crowded.select(F.col("class").alias(c), F.col("crowded").alias(f"{c}_crowded")) for c in ("class", "prior"))
    known = pairs.join(of_class, "class", "left").join(of_prior, "prior", "left")
    more = F.least(F.coalesce("class_crowded", F.lit(0)), F.coalesce("prior_crowded", F.lit(0)))
    overlap = F.floor(((F.col("size") + F.col("prior_size")) * percent + 99 + percent) / (100 + percent))  # of linked sets
    enough = F.greatest(F.floor(F.col("prior_size") / 100) + 1, F.col("n_rare") - F.col("size") + overlap, F.col("prior_rare") - F.col("prior_size") + overlap)
    direct = known.filter(F.col("shared") + more >= enough)

    heavy = left.filter(F.col("company") > FEW).join(crowded, "class").filter(F.col("crowded") >= needed)
    by_size = company.orderBy("size", "class")
    seen = heavy.withColumns({"prior": F.lag("class").over(by_size), "prior_size": F.lag("size").over(by_size)})
    chained = seen.filter(F.col("prior_size") * 100 >= F.col("size") * percent).groupBy("class", "prior").agg(F.count(F.lit(1)).alias("shared"))
    found = durable(direct.select("class", "prior", "shared").unionByName(chained))
    forget(met)
    forget(left)
    return found


class _Node:
    __slots__ = ("keys", "children", "low", "high", "member", "mixed", "here")

    def __init__(self, keys: np.ndarray, size: int, member: int):
        self.keys, self.children = keys, {}
        self.low = self.high = size  # sizes of the sets below
        self.member, self.mixed = member, False  # one set below; whether sets of several groups may be
        self.here: list[tuple[int, int]] = []  # (member, size) of sets that end here


class PrefixTree:
    """Sets as paths of keys, most common first. ``percent`` is the least Jaccard similarity in percent."""

    def __init__(self, percent: int, groups: Forest):
        self.percent, self.groups = percent, groups
        self.root: dict[int, _Node] = {}

    def may_link(self, overlap: int, of_query: int, query: int, depth: int, low: int, high: int) -> bool:
        """Whether a set of ``low`` .. ``high`` keys below can link: the size that gains most decides."""
        size = min(max(depth + of_query, low), high)
        shared = overlap + min(of_query, size - depth)
        return (100 + self.percent) * shared >= self.percent * (query + size)

    def join(self, member: int, keys: np.ndarray) -> None:
        """Union ``member`` with every set in the tree that it links with and isn't connected to yet."""
        rising, total, find = keys[::-1], len(keys), self.groups.find
        stack = [(node, 0, 0) for node in self.root.values()]
        while stack:
            node, depth, overlap = stack.pop()
            if not node.mixed and find(node.member) == find(member):
                continue
            at = np.searchsorted(rising, node.keys)
            overlap += int((rising[np.minimum(at, total - 1)] == node.keys).sum())
            depth += len(node.keys)
            left = int(at[-1])  # keys of the query beyond the path
            if not self.may_link(overlap, left, total, depth, node.low, node.high):
                continue
            for other, size in node.here:
                if (100 + self.percent) * overlap >= self.percent * (total + size):
                    self.groups.union(member, other)
            stack.extend((child, depth, overlap) for child in node.children.values())

    def add(self, member: int, keys: np.ndarray) -> None:
        size, level = len(keys), self.root
        while True:
            node = level.get(int(keys[0]))
            if node is None:
                node = level[int(keys[0])] = _Node(keys, size, member)
                node.here.append((member, size))
                return
            least = min(len(node.keys), len(keys))
            differ = np.nonzero(node.keys[:least] != keys[:least])[0]
            shared = int(differ[0]) if len(differ) else least
            if shared < len(node.keys):  # split the path
                lower = _Node(node.keys[shared:], size, node.member)
                lower.children, lower.low, lower.high, lower.mixed, lower.here = node.children, node.low, node.high, node.mixed, node.here
                node.keys, node.children, node.here = node.keys[:shared], {int(lower.keys[0]): lower}, []
            node.low, node.high = min(node.low, size), max(node.high, size)
            node.mixed = node.mixed or self.groups.find(node.member) != self.groups.find(member)
            if shared == len(keys):
                node.here.append((member, size))
                return
            keys, level = keys[shared:], node.children


def _members(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted classes: one document of each, found by its id and checked by its digest.

    While the counted list is short it goes to the texts; beyond, only hashes of its ids do, and the texts
    that they leave are shuffled.
    """
    wanted = durable(wanted)
    rows = wanted.count()
    if rows <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    elif rows <= BROADCAST_MARKS:
        mark = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
        marks = F.broadcast(wanted.select(mark("least").alias("__mark")).distinct())
        documents = documents.join(marks, mark("__id") == F.col("__mark"), "left_semi")
    return documents.join(wanted, same(F.col("__id"), F.col("least"))).select("cluster", "block", "class", "digest", "size", "visits", "group", "__text")


def _tree_join(visits: DataFrame, rank, n: int, percent: int) -> DataFrame:
    """(member, root) after joining each (cluster, block): residents enter the tree, visitors only traverse it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, here, groups, tree, known = WordHashes(), None, Forest(), None, {}
        for batch in batches:
            columns = [column_values(batch, c) for c in ("cluster", "block", "class", "digest", "visits", "group", "__text")]
            out: list[tuple[int, int]] = []
            for cluster, block, member, mark, visits_, group, text in zip(*columns, strict=True):
                if (cluster, block) != here:
                    out += groups.pairs()
                    here, groups, known = (cluster, block), Forest(), {}
                    tree = PrefixTree(percent, groups)
                keys = ordered_keys(ngram_hashes(text, n, words), rank.value)
                if digest(keys) != mark or known.get(member):
                    continue  # another document with the same id, or the same row again
                known[member] = True
                if group is not None:
                    groups.union(member, group)
                tree.join(member, keys[::-1])
                if not visits_:
                    tree.add(member, keys[::-1])
            if out:
                yield pa.RecordBatch.from_arrays([int64([a for a, _ in out]), int64([b for _, b in out])], names=["u", "v"])
        last = list(groups.pairs())
        yield pa.RecordBatch.from_arrays([int64([a for a, _ in last]), int64([b for _, b in last])], names=["u", "v"])

    placed = visits.repartition(reducers(visits.sparkSession), "cluster", "block").sortWithinPartitions("cluster", "block", "visits", "size", "class")
    return placed.mapInArrow(run, "u long, v long")


def ngram_links(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85,
    block_keys: int = BLOCK_KEYS, block_sets: int = BLOCK_SETS,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` (set size) and ``component_id``, the smallest id reachable by links."""
    spark = documents.sparkSession
    id_kind = documents.schema[doc_id].dataType.simpleString()
    named = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    counts = count_cells(named.select("__text"), n)
    ranks = np.empty(len(counts), dtype=np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    rank = spark.sparkContext.broadcast(ranks)  # 2 MB, whatever the input
    rare = rare_below(counts, percent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [ordered_keys(ngram_hashes(t, n, words), rank.value) for t in column_values(batch, "__text")]
            n_rare = [int(np.searchsorted(keys, rare)) for keys in sets]
            firsts = [keys[: max(r, prefix_length(len(keys), percent))] if len(keys) else keys for keys, r in zip(sets, n_rare, strict=True)]
            offsets = np.cumsum([0, *(len(f) for f in firsts)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), int64(np.concatenate(firsts)))
            marks = [digest(k) for k in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.binary()), int64(np.array([int.from_bytes(m[:8]) for m in marks], dtype=np.uint64)), int64([len(k) for k in sets]), pa.array(n_rare, pa.int32()), listed],
                names=["__id", "digest", "mark", "size", "n_rare", "keys"],
            )

    described = durable(named.mapInArrow(describe, f"__id {id_kind}, digest binary, mark long, size long, n_rare int, keys array<long>"))
    copies = durable(described.filter("size > 0").groupBy("digest").agg(F.min("__id").alias("least"), F.first("size").alias("size"), F.first("mark").alias("mark")))
    numbered = may_link(described, copies, percent)
    # Tables that are not read again are deleted; keys are most of what is written here.
    listed = durable(described.select("__id", "size", "digest"))
    forget(described)
    classes = durable(numbered.select("class", "least", "size", "digest"))
    chains = candidate_chains(numbered.select("class", "size", "n_rare", F.explode("keys").alias("key")), percent)
    forget(numbered)
    clusters = components(chains, "class", "prior")
    roots = clusters.select(F.col("root").alias("class"), F.col("root").alias("cluster")).distinct()
    active = clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")).unionByName(roots)
    facts = classes.select("class", "least", "size", "digest")
    ordered = running_before(active.join(facts, "class").withColumn("one", F.lit(1)), ["size", "class"], {"keys": "size", "sets": "one"}, within=["cluster"])
    block = F.floor(F.greatest(F.col("keys") / block_keys, F.col("sets") / block_sets))
    residents = durable(ordered.select("cluster", block.alias("block"), "class", "least", "size", "digest"))
    stay = residents.withColumns({"visits": F.lit(False), "group": F.lit(None).cast("long")})
    wide = residents.groupBy("cluster").agg(F.max("block").alias("last")).filter("last > 0")
    wide = durable(wide)
    split = not wide.isEmpty()
    visitors = stay
    if split:
        # Central sets share most prefix keys with others; they visit every block of their cluster.
        central = chains.groupBy("class").agg(F.sum("shared").alias("shared"))
        order = Window.partitionBy("cluster").orderBy(F.col("shared").desc(), "class")
        pivots = residents.join(wide, "cluster").join(central, "class", "left").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
        roaming = pivots.withColumn("home", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).filter("block <> home")
        visitors = stay.unionByName(roaming.select("cluster", "block", "class", "least", "size", "digest", F.lit(True).alias("visits"), F.lit(None).cast("long").alias("group")))
    links = durable(_tree_join(_members(named, visitors), rank, n, percent))
    groups = components(links, "u", "v")
    if split:
        # What is not in the main group of a cut cluster visits the other blocks of fitting sizes.
        grouped_residents = residents.join(wide, "cluster").join(groups, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("root", "class")).drop("node", "root")
        marked = durable(grouped_residents)
        sizes = marked.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("cluster").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
        strays = durable(marked.join(main, "cluster").filter("`group` <> main").drop("main"))
        if not strays.isEmpty():
            spans = marked.groupBy("cluster", "block").agg(F.min("size").alias("low"), F.max("size").alias("high")).withColumnRenamed("block", "to")
            fits = (F.col("low") * percent <= F.col("size") * 100) & (F.col("size") * percent <= F.col("high") * 100)
            going = strays.join(spans, "cluster").filter(fits & (F.col("to") != F.col("block"))).drop("block").withColumnRenamed("to", "block")
            columns = ["cluster", "block", "class", "least", "size", "digest", "visits", "group"]
            targets = going.select("cluster", "block").distinct()
            at_home = marked.join(targets, ["cluster", "block"], "left_semi").withColumn("visits", F.lit(False)).select(*columns)
            again = at_home.unionByName(going.withColumn("visits", F.lit(True)).select(*columns))
            more = durable(_tree_join(_members(named, again), rank, n, percent))
            groups = components(links.unionByName(more), "u", "v")

    named_groups = groups.select(F.col("node").alias("class"), "root").unionByName(groups.select(F.col("root").alias("class"), "root").distinct())
    of_class = classes.select("class", "digest", "least").join(named_groups, "class")
    smallest = of_class.groupBy("root").agg(F.min("least").alias("component"))
    linked = of_class.join(smallest, "root").select("digest", "component")
    found = listed.join(copies.select("digest", "least"), "digest", "left").join(linked, "digest", "left")
    component = F.when(F.col("component").isNotNull(), F.col("component")).when(F.col("size") > 0, F.col("least")).otherwise(F.col("__id"))
    return found.select(F.col("__id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"))


def one_of_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose id is their group's smallest, with all columns; rows that repeat id and text stay once."""
    report = ngram_links(documents, doc_id=doc_id, text=text, n=n, percent=percent)
    stay = report.filter(same(F.col("doc_id"), F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return documents.join(stay, same(F.col(doc_id), F.col("__stay")), "left_semi").dropDuplicates([doc_id, text])


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  WHERE 100 * p.n >= 85 * q.n AND 100 * q.n >= 85 * p.n
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d JOIN reach r ON r.x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op9_ngram_jaccard_join", SQL)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(table(spark, sf_dir, "documents"))
