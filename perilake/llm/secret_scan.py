"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models are trained on the table itself. Samples are labelled by the fixed
patterns: the values they find are random strings, and all other runs of code-like characters are
ordinary words and identifiers. Counting covers every text; what leaves a task is one pair of count matrices,
whose size is fixed by the alphabet. A candidate (a long run of code-like characters that no pattern
found) is a secret if the mean log-likelihood ratio per character exceeds ``threshold`` and its
character kinds are mixed. Scores depend on the table, so the threshold is set under its own models: random
tokens of every kind in ``RANDOM`` and of the least length are scored, and at most ``MISSED`` of any kind
fall below. Longer tokens score closer to their mean and are missed less often.

Defined results: a missing text is empty; every row gives one row, also with repeated or missing
ids; an empty table gives an empty result. Positions are code points, end exclusive. Texts are
scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import column_values, int64, query, table

# --- fixed values -----------------------------------------------------------------------
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RANDOM = ("base64", ALPHABET[:64]), ("alphanumeric", ALPHABET[:62]), ("letters", ALPHABET[:52]), ("lower and digits", ALPHABET[26:62]), ("upper and digits", ALPHABET[:26] + ALPHABET[52:62]), ("hex", "0123456789abcdef")
MISSED, SAMPLES = 0.01, 4000
# ----------------------------------------------------------------------------------------

_ASSIGN = re.compile(ASSIGN)
# A run that starts where a shorter failing run starts fails too, so the least length may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4))
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_CODE = np.full(256, -1, dtype=np.int16)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1  # one more symbol for the start


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def transitions(run: str) -> np.ndarray:
    """Cells of the transitions into each code-like character; what follows any other starts anew."""
    codes = _CODE[np.frombuffer(run.encode(), dtype=np.uint8)]
    before = np.full(len(codes), SIZE - 1, dtype=np.int16)
    before[1:] = np.where(codes[:-1] < 0, SIZE - 1, codes[:-1])
    return (before * SIZE + codes)[codes >= 0]


def pieces(parts: list[str], size: int = 1 << 20) -> Iterator[str]:
    """The parts joined by line feeds, about ``size`` characters at a time; only a longer part makes more."""
    some, length = [], 0
    for part in parts:
        some.append(part)
        length += len(part)
        if length >= size:
            yield "\n".join(some)
            some, length = [], 0
    if some:
        yield "\n".join(some)


def without(text: str, spans) -> str:
    """The text with its spans blanked out."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, _ in spans:
        parts += [text[at:a], " " * max(0, b - max(a, at))]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def runs_outside(text: str, spans) -> Iterator[re.Match]:
    """Long runs of code-like characters that touch no span."""
    taken = [(a, b) for a, b, _ in spans]
    for m in _RUN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            yield m


def count_transitions(documents: DataFrame, text: str) -> np.ndarray:
    """Counts of (random, identifier) transitions over all texts: a (2, SIZE, SIZE) array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for batch in batches:
            secret, words = [], []
            for value in column_values(batch, "__text"):
                spans = base_spans(value or "")
                secret += [_ASSIGN.match(value[a:b])[2] if kind == 0 else value[a:b] for a, b, kind in spans]
                words.append(without(value or "", spans))
            for side, parts in enumerate((secret, words)):
                for piece in pieces(parts):
                    total[side] += np.bincount(transitions(piece), minlength=SIZE * SIZE)
        at = np.nonzero(total.reshape(-1))[0]
        yield pa.RecordBatch.from_arrays([int64(at), int64(total.reshape(-1)[at])], names=["cell", "n"])

    cells = documents.select(F.col(text).alias("__text")).mapInArrow(run, "cell long, n long")
    out = np.zeros(2 * SIZE * SIZE)
    for cell, n in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 2 * SIZE * SIZE rows
        out[cell] = n
    return out.reshape(2, SIZE, SIZE)


def log_ratio(counts: np.ndarray, prior: float = 1000.0) -> np.ndarray:
    """Log-likelihood ratio of each transition, random against identifier.

    Random strings are smoothed towards even odds, so a table without labelled secrets still has a
    model of randomness; identifiers are smoothed towards their own character frequencies.
    """
    random, word = counts
    even = np.full(SIZE, 1.0 / len(ALPHABET))
    usual = (word.sum(0) + 1.0) / (word.sum() + SIZE)
    p = (random + prior * even) / (random.sum(1, keepdims=True) + prior)
    q = (word + prior * usual) / (word.sum(1, keepdims=True) + prior)
    return np.log(p) - np.log(q)


def mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run) >= 2


def score(run: str, ratio: np.ndarray) -> float:
    return float(ratio.reshape(-1)[transitions(run)].mean())


def looks_random(run: str, ratio: np.ndarray, threshold: float) -> bool:
    return mixed(run) and score(run, ratio) > threshold


def random_threshold(ratio: np.ndarray, length: int, missed: float = MISSED) -> float:
    """Score that all but ``missed`` of the random mixed tokens of each kind exceed; never one at which the identifier model is likelier."""
    rng = np.random.default_rng(0)
    least = []
    for _, alphabet in RANDOM:
        tokens = ["".join(t) for t in rng.choice(list(alphabet), (SAMPLES, max(2, length)))]
        least.append(np.quantile([score(t, ratio) for t in tokens if mixed(t)], missed))
    return max(0.0, float(min(least)))


def scan_secrets(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_run: int = 16, threshold: float | None = None,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_assign, n_access, n_hex, n_markov``, ``base_spans`` and ``spans``.

    ``threshold`` is :func:`random_threshold` of the table unless given.
    """
    ratio = log_ratio(count_transitions(documents, text))
    threshold = random_threshold(ratio, min_run) if threshold is None else threshold
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every = [], [], []
            for value in column_values(batch, "__text"):
                value = value or ""
                spans = base_spans(value)
                more = [(m.start(), m.end(), 3) for m in runs_outside(value, spans) if m.end() - m.start() >= min_run and looks_random(m[0], ratio, threshold)]
                base.append(joined(spans))
                every.append(joined(sorted(spans + more, key=lambda s: (s[0], s[2]))))
                kinds = [k for _, _, k in spans]
                counts.append([kinds.count(0), kinds.count(1), kinds.count(2), len(more)])
            table_ = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(int64(table_[:, i]) for i in range(4)), pa.array(base, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_spans", "spans"],
            )

    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return named.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_spans string, spans string")


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans", "n_markov")
