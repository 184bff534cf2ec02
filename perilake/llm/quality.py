"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation
estimates each labeller's vote probabilities for good and bad documents and the share of bad ones,
without any gold label. It needs only how often each combination of votes occurs: that is counted
over all documents, and the number of combinations is fixed by the number of labellers (3 ** 7). The
posterior of a combination labels its documents, and a linear scorer over hashed features (byte-class
trigrams and binned measures) is fitted to a sample of them, ``train_rows`` a class in expectation,
chosen by a hash of the text. Every document is then scored.

Defined results: a document without words (also a missing text) scores 0 and is rejected. Equal texts
get equal scores; every row gives one row, also with repeated or missing ids. An empty table gives an
empty result. Texts are read whole. If the sample holds one class only, the other is taken as unseen
and all documents with words fall to the class that is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.llm.common import column_values, of_batches, query, table

# Measures with the bounds of the votes: beyond ``bad`` is a bad vote, within ``good`` a good one.
LABELLERS = {  # name: (good, bad); the measure grows with badness
    "shouting": (0.15, 0.25),  # upper-case share of ASCII letters
    "symbols": (0.02, 0.06),  # share of symbol characters
    "bars_and_bangs": (0.05, 0.15),  # bars and exclamation marks a word
    "stutter": (0.06, 0.12),  # words equal to the one before
    "monotony": (0.70, 0.90),  # share of words seen before in the text; longer texts abstain
    "repeated_lines": (0.30, 0.60),  # share of lines seen before in the text
    "few_letters": (0.15, 0.25),  # share of characters that are no letters; short texts abstain
}
NAMES = tuple(LABELLERS)
GOOD = np.array([g for g, _ in LABELLERS.values()])
BAD = np.array([b for _, b in LABELLERS.values()])
COMBINATIONS = 3 ** len(NAMES)
SYMBOLS = b"*#$%&|!~^=<>@{}[]\\_+`"
BINS = 8
BUCKETS = 1024

_CLASS = np.full(256, 1, dtype=np.int64)  # lower case and all beyond ASCII
_CLASS[:128] = 12
for _code, _chars in enumerate((b" \t\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b".", b",;:", b"!", b"|", SYMBOLS.replace(b"!", b"").replace(b"|", b""), b"'\"", b"()")):
    _CLASS[list(_chars)] = _code


def measures(data: bytes) -> np.ndarray | None:
    """The labellers' measures of a text, NaN where one abstains; None for a text without words."""
    words = data.split()
    n = len(words)
    if not n:
        return None
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    inner = len(data) - seen[[32, 9, 10, 11, 12, 13]].sum()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return np.array([
        upper / (upper + lower) if upper + lower >= 20 else np.nan,
        seen[list(SYMBOLS)].sum() / inner,
        (seen[33] + seen[124]) / n,
        sum(map(eq, words, words[1:])) / n if n >= 10 else np.nan,
        1 - len(set(words)) / n if 20 <= n <= 5000 else np.nan,
        1 - len(set(lines)) / len(lines) if len(lines) >= 4 else np.nan,
        1 - (upper + lower + seen[128:].sum()) / inner if n >= 20 else np.nan,
    ])


def combination(values: np.ndarray) -> int:
    """Votes as one number in base 3: 0 abstains, 1 is good, 2 is bad."""
    votes = np.where(values <= GOOD, 1, np.where(values >= BAD, 2, 0))
    return int(votes @ (3 ** np.arange(len(NAMES))))


def votes_of(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(NAMES))) % 3


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, false_alarms: float = 0.005, seen: tuple[float, float] = (0.05, 0.75)) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote combinations.

    Returns the posterior of being bad of each combination, the vote probabilities
    (class, labeller, vote) and the share of bad documents. It starts from "any bad vote". A bad vote
    on a good document is held to be no likelier than ``false_alarms``, and its likelihood on a bad one
    stays within ``seen``, else a kind of badness that few labellers see could pass as a habit of good
    documents.
    """
    votes = votes_of(codes)
    bad = np.where((votes == 2).any(1), 0.9, 0.05)
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float)
    one_hot[:, :, 0] = 0  # abstaining says nothing: short texts abstain often and aren't bad for that
    share, tables = 0.5, np.zeros((2, len(NAMES), 3))
    for _ in range(rounds):
        for side, weight in enumerate((1 - bad, bad)):
            mass = np.tensordot(weight * counts, one_hot, 1) + 0.1
            mass[:, 0] = 0
            tables[side] = mass / mass.sum(1, keepdims=True)
            if side == 0:
                tables[0, :, 2] = np.minimum(tables[0, :, 2], false_alarms)
                tables[0, :, 1] = 1 - tables[0, :, 2]
            else:
                tables[1, :, 2] = np.clip(tables[1, :, 2], *seen)
                tables[1, :, 1] = 1 - tables[1, :, 2]
            tables[side, :, 0] = 1
        share = (bad @ counts + 1) / (counts.sum() + 2)
        log = np.log(tables)[:, np.arange(len(NAMES)), votes].sum(2)
        odds = np.clip(np.log(share) - np.log1p(-share) + log[1] - log[0], -50, 50)
        new = 1 / (1 + np.exp(-odds))
        moved, bad = np.abs(new - bad).max(initial=0), new
        if moved < 1e-9:
            break
    return bad, tables, float(share)


def features(data: bytes, values: np.ndarray) -> np.ndarray:
    """Hashed features: root frequencies of byte-class trigrams and one mark per binned measure."""
    kinds = _CLASS[np.frombuffer(data, dtype=np.uint8)]
    out = np.zeros(BUCKETS, dtype=np.float32)
    if len(kinds) >= 3:
        grams = np.bincount((kinds[:-2] << 8) | (kinds[1:-1] << 4) | kinds[2:], minlength=4096)
        at = np.nonzero(grams)[0]
        np.add.at(out, (at * 2654435761 >> 8) % BUCKETS, np.sqrt(grams[at] / len(kinds)))
    step = np.where(np.isnan(values), BINS - 1, np.minimum(BINS - 2, values / BAD * 3)).astype(np.int64)
    np.add.at(out, ((np.arange(len(values)) * BINS + step + 1) * 40503 >> 2) % BUCKETS, 1.0)
    return out


def fit_scorer(x: np.ndarray, bad: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by accelerated gradient descent; scores goodness."""
    weights, bias = np.zeros(x.shape[1]), 0.0
    if not len(x):
        return weights, 4.0
    side = np.array([max((1 - bad).sum(), 1.0), max(bad.sum(), 1.0)])
    each = (1 - bad) / side[0] + bad / side[1]  # both classes weigh the same
    rate = 4.0 / (float((x * x).sum(1).max()) + 1) / max(each.sum(), 1e-9)
    ahead_w, ahead_b = weights, bias
    for step in range(steps):
        error = each * (1 / (1 + np.exp(-(x @ ahead_w + ahead_b))) - (1 - bad))
        new_w, new_b = ahead_w - rate * (error @ x + ridge * ahead_w), ahead_b - rate * error.sum()
        push = step / (step + 3)
        ahead_w, ahead_b = new_w + push * (new_w - weights), new_b + push * (new_b - bias)
        weights, bias = new_w, new_b
    return weights, float(bias)


class QualityModel:
    """Fitted labellers and scorer; small and fixed in size."""

    def __init__(self, posterior: dict[int, float], tables: np.ndarray, share: float, weights: np.ndarray, bias: float):
        self.posterior, self.tables, self.share, self.weights, self.bias = posterior, tables, share, weights, bias

    def score(self, text: str | None) -> float:
        data = (text or "").encode()
        values = measures(data)
        if values is None:
            return 0.0
        return float(1 / (1 + np.exp(-(features(data, values) @ self.weights + self.bias))))


def fit_quality(documents: DataFrame, *, text: str = "text", train_rows: int = 3000) -> QualityModel:
    """Vote over all documents, estimate, and fit the scorer to about ``train_rows`` texts of each class."""
    named = documents.select(F.col(text).alias("__text"))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measures((t or "").encode()) for t in column_values(batch, "__text")]
        codes = [combination(v) for v in found if v is not None]
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int32())], names=["code"])

    counted = named.mapInArrow(of_batches(vote), "code int").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.collect()  # at most COMBINATIONS rows
    codes, counts = np.array([r.code for r in rows], dtype=np.int64), np.array([r.n for r in rows], dtype=float)
    bad, tables, share = estimate(codes, counts)
    posterior = dict(zip(codes.tolist(), bad.tolist(), strict=True))
    sizes = [float(((1 - bad) * counts).sum()), float((bad * counts).sum())]
    part = [min(1.0, train_rows / max(s, 1e-9)) for s in sizes]
    scale = 1 << 20
    drawn = named.withColumn("__draw", F.pmod(F.xxhash64("__text", F.lit(3)), F.lit(scale)).cast("int")).filter(F.col("__draw") < max(part) * scale)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, label = [], []
            for value, draw in zip(column_values(batch, "__text"), column_values(batch, "__draw"), strict=True):
                data = (value or "").encode()
                if (values := measures(data)) is None:
                    continue
                p = posterior.get(combination(values), share)
                if draw < part[p >= 0.5] * scale:
                    out.append(features(data, values).tobytes())
                    label.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(label, pa.float64())], names=["x", "bad"])

    taken = drawn.mapInArrow(sample, "x binary, bad double").collect()  # about 2 * train_rows rows
    x = np.frombuffer(b"".join(bytes(r.x) for r in taken), dtype=np.float32).reshape(-1, BUCKETS)
    weights, bias = fit_scorer(x, np.array([r.bad for r in taken], dtype=float))
    return QualityModel(posterior, tables, share, weights, bias)


def scored(documents: DataFrame, model: QualityModel, *, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with the score of their text, 0 (bad) to 1 (good)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return documents.withColumn(name, score(F.col(text)))


def keep_quality(documents: DataFrame, *, text: str = "text", least: float = 0.5, train_rows: int = 3000) -> DataFrame:
    """Documents that the classifier accepts, with their own columns."""
    model = fit_quality(documents, text=text, train_rows=train_rows)
    return scored(documents, model, text=text, name="__score").filter(F.col("__score") >= least).drop("__score")


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents the classifier keeps, with their scores."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(documents, fit_quality(documents)).filter("score >= 0.5").select("doc_id", "score")
