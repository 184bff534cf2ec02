import math

import numpy as np
import pytest

from perilake.llm.vector_search import nearest

MEDIUM = "/root/testdata/sf0.1"


def brute(rows, k=10, step=100):
    first = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)), key=lambda r: (r[0], r[1])):
        first.setdefault(i, np.array(v, dtype=float))
    out = {}
    for q in (i for i in first if i % step == 0):
        near = sorted((float(np.sqrt(((v - first[q]) ** 2).sum())), i) for i, v in first.items() if i != q and len(v) == len(first[q]))
        if near:
            out[q] = near[:k]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_exact_at_factor_one_and_recall(spark):
    frame = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    want = brute(rows)
    got = answers(nearest(frame, relax=1.0, shard_rows=300))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    for q, v in want.items():
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in v], rel=1e-12)
    rough = answers(nearest(frame))
    recall = np.mean([len({i for _, i in rough[q]} & {i for _, i in v}) / len(v) for q, v in want.items()])
    assert recall >= 0.95


def test_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 700)] + [(1000, None), (1100, []), (1200, [0.0, 0.0]), (1300, [float("nan"), 1.0]), (1400, [None, 1.0]),
            (None, same), (1500, [float("inf"), 1.0]), (1600, [1.0, 2.0, 3.0]), (1601, [1.0, 2.0, 4.0]), (300, same), (300, [9.0, 9.0]), (1700, [5.0])]
    frame = spark.createDataFrame([(i, v, 3.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = answers(nearest(frame, relax=1.0, shard_rows=100))
    assert got == brute(rows)
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[1600] == [(1.0, 1601)] and 1700 not in got
    assert nearest(frame.limit(0)).collect() == []
