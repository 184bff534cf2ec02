"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared as UTF-8 bytes with A-Z lower-cased and white space runs made
one space. An item is cut into segments of ``segment`` bytes that overlap by half, so a passage taken
from the middle of an item still holds whole segments. A segment of m bytes may differ by
``k = m * budget`` edits.

Q-gram lemma: text within k edits of a segment shares at least ``T = m - q + 1 - k q`` of its q-grams,
on diagonals at most k apart. First a bitmap of all segments' q-grams gives, for every text position,
whether any segment has the q-gram there; a window with fewer than T such positions can hold no
segment. In what is left, shared q-grams are counted per segment in diagonal bands of width 2k + 1
that overlap by half, and bands with T of them are retained. A retained region is verified by
alignment in a band of 2k + 1 diagonals, so the answer is exact: nothing is missed or guessed.

Documents never move. A block of items is bounded by ``block_bytes``, and that is what a task gets; a
larger benchmark takes more blocks. Rows are judged as they stand, one by one: searching more blocks
numbers the rows first, and filtering passes them from block to block, so no id decides about a row.

Defined results: missing and empty texts hold no passage; missing or empty items, and items of fewer
than ``min_item`` bytes, match nothing; an item without an id is named ``null`` and listed last;
repeated rows and rows without an id, or sharing one, are judged by their own text; a span starts a
segment's length before its end; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import column_values, durable, query, table

Q = 12
BITS = 22  # of the bitmap of q-grams


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def qgrams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the q-gram that starts at each byte (empty if there is none)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    words = np.lib.stride_tricks.as_strided(data, shape=(len(data) - 7, 8), strides=(1, 1))
    eight = np.ascontiguousarray(words).view(np.uint64).reshape(-1)
    with np.errstate(over="ignore"):
        return (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[Q - 8 : n + Q - 8] * np.uint64(0xC2B2AE3D27D4EB4F))


def slot(grams: np.ndarray) -> np.ndarray:
    return ((grams ^ (grams >> np.uint64(29))) >> np.uint64(64 - BITS)).astype(np.int64)


def aligned_end(segment: bytes, data: bytes, lo: int, hi: int, k: int) -> int:
    """End of a part of ``data`` within k edits of ``segment``, aligned on diagonals lo .. hi, or -1.

    A row holds, for each diagonal of the band, the least edits after a number of segment bytes. The
    part may start on any diagonal of the band and end anywhere in it.
    """
    exact = data.find(segment, max(lo, 0), hi + 1 + len(segment))
    if exact >= 0:
        return exact + len(segment)
    width = hi - lo + 1
    text = np.full(len(segment) + width, 256, dtype=np.int64)  # 256 equals no byte
    part = np.frombuffer(data[max(lo, 0) : max(lo + len(text), 0)], dtype=np.uint8)
    text[max(-lo, 0) : max(-lo, 0) + len(part)] = part
    steps = np.arange(width)
    row = np.where(steps + lo >= 0, 0, k + 1)
    for i, byte in enumerate(segment):
        here = np.minimum(row + (text[i : i + width] != byte), np.append(row[1:], k) + 1)
        row = np.minimum.accumulate(here - steps) + steps  # text bytes left out run along the row
        if row.min() > k:
            return -1
    return min(len(data), len(segment) + lo + int(row.argmin()))


class SegmentIndex:
    """Segments of a bounded block of items, with the bitmap and postings of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], segment: int, budget: float):
        self.segments: list[tuple[int, bytes, int]] = []  # item, bytes, edits
        for item, data in items:
            starts = [0] if len(data) <= segment else [*range(0, len(data) - segment, segment // 2), len(data) - segment]
            for at in starts:
                piece = data[at : at + segment]
                self.segments.append((item, piece, min(int(len(piece) * budget), (len(piece) - Q) // Q)))
        self.edits = np.array([k for _, _, k in self.segments], dtype=np.int64)
        self.shared = np.array([len(p) - Q + 1 - k * Q for _, p, k in self.segments], dtype=np.int64)  # T
        self.bitmap = np.zeros(1 << BITS, dtype=np.uint8)
        grams, owner, place = [], [], []
        for number, (_, piece, _) in enumerate(self.segments):
            g = qgrams(np.frombuffer(piece, dtype=np.uint8))
            grams.append(g)
            owner.append(np.full(len(g), number))
            place.append(np.arange(len(g)))
        self.grams = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams = self.grams[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, dtype=np.int64)
        self.bitmap[slot(self.grams)] = 1
        self.least = int(self.shared.min(initial=Q))
        self.reach = max((len(p) + k for _, p, k in self.segments), default=1)

    def busy(self, hits: np.ndarray) -> np.ndarray:
        """Hit positions lying in some window of ``reach`` bytes with at least ``least`` hits."""
        if len(hits) < self.least:
            return hits[:0]
        ahead = hits[self.least - 1 :] - hits[: len(hits) - self.least + 1] < self.reach
        mark = np.zeros(len(hits) + 1, dtype=np.int64)
        np.add.at(mark, np.nonzero(ahead)[0], 1)
        np.add.at(mark, np.nonzero(ahead)[0] + self.least, -1)
        return hits[np.cumsum(mark[:-1]) > 0]

    def passages(self, data: bytes, hits: np.ndarray, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) in the normalised text of each verified segment.

        ``hits`` are busy positions and ``grams`` their q-grams.
        """
        lo, hi = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        times = hi - lo
        if not times.any():
            return []
        posting = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        number, place = self.owner[posting], self.place[posting]
        half = self.edits[number] + 1
        band = (np.repeat(hits, times) - place) // half
        # Each match counts in two bands; a q-gram of the segment counts once a band.
        triple = np.unique(np.stack((np.tile(number, 2), np.concatenate((band, band - 1)), np.tile(place, 2)), axis=1), axis=0)
        bands, counts = np.unique(triple[:, :2], axis=0, return_counts=True)
        out, done = [], set()
        for owner, first in bands[counts >= self.shared[bands[:, 0]]].tolist():
            item, piece, k = self.segments[owner]
            end = aligned_end(piece, data, first * (k + 1) - k, (first + 2) * (k + 1) + k, k)
            if end >= 0 and (owner, end) not in done:
                done.add((owner, end))
                out.append((item, max(0, end - len(piece)), end))
        return out


def merged_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans of one item as one span, ordered by item and start."""
    out: list[tuple[int, int, int]] = []
    for item, start, end in sorted(spans, key=lambda s: (s[0] is None, "" if s[0] is None else s[0], s[1], s[2])):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((item, start, end))
    return out


def find_in_block(index: SegmentIndex, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Passages of each normalised text; the texts are searched as one array, apart by a byte no text has."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.frombuffer(b"\xff".join([*texts, b"\xff" * 8]), dtype=np.uint8)
    grams = qgrams(data)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hits = index.busy(np.nonzero(index.bitmap[slot(grams)])[0])
    owner = np.searchsorted(starts, hits, "right") - 1
    edges = np.nonzero(np.diff(owner, prepend=-1, append=len(texts) + 1))[0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        doc = int(owner[a])
        out[doc] = merged_spans(index.passages(texts[doc], hits[a:b] - starts[doc], grams[hits[a:b]]))
    return out


def searched(index: SegmentIndex, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Passages of each text, about a megabyte at a time, which stays in the processor's cache."""
    plain = [normal(t) for t in texts]
    found, at = [], 0
    while at < len(plain):
        end, size = at, 0
        while end < len(plain) and (end == at or size < 1 << 20):
            size += len(plain[end])
            end += 1
        found += find_in_block(index, plain[at:end])
        at = end
    return found


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, min_item: int, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Normalised items of ``min_item`` bytes or more, about ``block_bytes`` at a time."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield [(row.item, data) for row in part.collect() if len(data := normal(row.text)) >= min_item]


def find_passages(
    documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", segment: int = 80, budget: float = 0.06, min_item: int = 30, block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per document that holds a passage: ``doc_id, n_passages, items, spans``.

    ``items`` and ``spans`` are comma-joined item ids and ``item:start:end`` (bytes of the normalised text), by item and start.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    blocks = list(item_blocks(benchmark, item_id, item_text, min_item, block_bytes))  # what tasks get, a block each
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    if len(blocks) > 1:
        named = durable(named)  # every block sees the same numbers
    made = f"doc_id {kind}, __row long, found array<struct<place:int,item:string,start:long,end:long>>"
    shape = pa.list_(pa.struct([("place", pa.int32()), ("item", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = {item: i for i, item in enumerate(sorted({item for block in blocks for item, _ in block}, key=lambda x: (x is None, "" if x is None else x)))}

    def search(known: list[tuple[object, bytes]]):
        places = {item: order[item] for item, _ in known}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = SegmentIndex(known, segment, budget)
            for batch in batches:
                found = searched(index, column_values(batch, "__text"))
                rows = [i for i, f in enumerate(found) if f]
                told = [[{"place": places[x], "item": "null" if x is None else f"{x}", "start": a, "end": b} for x, a, b in found[i]] for i in rows]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("doc_id", "__row")] + [pa.array(told, shape)], names=["doc_id", "__row", "found"])

        return named.mapInArrow(run, made)

    found = documents.sparkSession.createDataFrame([], made)
    for number, known in enumerate(blocks):
        found = found.unionByName(search(known)) if number else search(known)
    if len(blocks) > 1:
        found = found.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.collect_list("found")).alias("found"))  # one row a block
    spans = F.transform(F.array_sort("found"), lambda s: F.concat_ws(":", s["item"], s["start"].cast("string"), s["end"].cast("string")))
    items = F.array_distinct(F.transform(F.array_sort("found"), lambda s: s["item"]))
    return found.select("doc_id", F.size("found").cast("long").alias("n_passages"), F.array_join(items, ",").alias("items"), F.array_join(spans, ",").alias("spans"))


def without_passages(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    segment: int = 80, budget: float = 0.06, min_item: int = 30, block_bytes: int = 4 << 20,
) -> DataFrame:
    """Documents that hold no benchmark passage, with all their columns; each row is judged by its own text."""
    for known in item_blocks(benchmark, item_id, item_text, min_item, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            index = SegmentIndex(known, segment, budget)
            for batch in batches:
                yield batch.filter(pa.array([not f for f in searched(index, column_values(batch, text))], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
