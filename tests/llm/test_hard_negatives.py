import math

import numpy as np
import pytest

from perilake.llm.hard_negatives import hard_negatives, lookup_scores, plane_bytes, subset_sums

COLUMNS = "vec_id long, embedding array<float>, label int, rank string, cell long"


def brute(rows, step=50, shift=7):
    first = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % shift == 0 else label
        key = (label, list(v))
        first[i] = min(first.get(i, key), key)
    items = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in first.items()}
    out = set()
    for a, (label, v) in items.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in items.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, i) for n, i, other in scored if other != label and 50 * -s <= 100 * -n <= 95 * -s]
            out |= {(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits[:3])}
    return out


def found(rows, spark, **more):
    frame = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], COLUMNS)
    got = [tuple(r) for r in hard_negatives(frame, shift_every=7, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("dims, low, high", [(64, -150, 150), (1, -1, 0), (8, 0, 1), (11, -(2**40), 2**40), (20, 5, 9), (0, 0, 1), (17, -128, 127)])
def test_lookups_give_inner_products(dims, low, high):
    rng = np.random.default_rng(dims)
    anchors, others = rng.integers(low, high + 1, (9, dims)), rng.integers(low, high + 1, (301, dims))
    planes = plane_bytes(others)
    with np.errstate(over="ignore"):
        want = others @ anchors.T
    assert (lookup_scores(subset_sums(anchors, len(planes)), planes).astype(np.int64) == want).all()


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 70, "anchor_rows": 4}])
def test_against_brute_force(spark, sizes):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 13))
    rows = []
    for i in range(900):
        label = int(rng.integers(0, 6))
        rows.append((i - 100, [float(x) for x in (middle[label] + rng.normal(size=13)).astype(np.float32)], label))
    assert found(rows, spark, **sizes) == brute(rows)


def test_one_label_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5, -0.25], 0) for i in range(0, 400)] + [(i, [0.75, 0.375, -0.25], 1) for i in range(400, 800)]
    assert found(rows, spark, shard_rows=90) == brute(rows)
    assert found([r for r in rows if r[2] == 0 and r[0] % 7], spark) == set()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 1.0], 0), (1, [1.0, 1.0], None), (2, None, 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0),
            (50, [1.0, 1.0], 2), (51, [1.0, 0.9], 2), (52, [0.9, 0.9], 3), (53, [0.5, 0.6], 3), (53, [0.4, 0.6], 3), (53, [0.5, 0.6], 3), (54, [0.6, 0.6], 4),
            (100, [], 1), (101, [], 1), (102, [], 2), (150, [1.0], -3), (151, [0.5], -3), (154, [0.3], -1), (153, [0.3], 8), (200, [-1.0, -1.0], 2),
            (250, [0.0, 0.0], 9), (251, [0.0, 0.0], 9), (252, [0.0, 0.0], 9), (50, [1.0, 1.0], 2)]
    got = found(rows, spark)
    assert got == brute(rows)
    assert (100, 101, 1, 102, 0, 0) in got and any(r[0] == 150 for r in got)
    empty = spark.createDataFrame([], COLUMNS)
    assert hard_negatives(empty).collect() == []
