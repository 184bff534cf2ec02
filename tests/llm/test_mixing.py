import re

import pytest

from perilake.llm.mixing import WEIGHTS, mix_sources

SCHEMA = "doc_id long, text string, source string, size string, block string"


def targets(sizes, share=1.5, limit=2.0):
    """Reshare the excess until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        fair = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if fair[s] > limit * sizes[s]]
        if not over:
            return out | fair
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", None) for i, t, s in rows], SCHEMA)


def sizes_of(rows):
    out = {}
    for _, text, source in rows:
        out[source] = out.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


ROWS = [(i, "w " * (i * 37 % 300 + 1), f"s{i % 5}" if i % 3 else "hot") for i in range(300)] + [
    (7, "twice the same id", "s1"), (None, "no id", "s2"), (900, None, "s3"), (901, "", "s4"), (902, " \t\n", "hot"),
    (903, "v " * 50_000, "long"), (904, "orphan words here", None), (904, "orphan words here", None), (905, " x y z", "é"),
]


def test_targets_taken_and_limits(spark):
    slots, report = mix_sources(frame(spark, ROWS))
    got = report.collect()
    sizes = sizes_of(ROWS)
    want = targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted(
        (i is None, i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in ROWS)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 128, source  # two blocks
    reads = slots.groupBy("source", "block").count().collect()
    assert max(r["count"] for r in reads) <= 2
    assert slots.groupBy("source", "slot").count().filter("count > 1").isEmpty()


def test_reruns_agree(spark):
    keep = lambda: sorted(map(tuple, mix_sources(frame(spark, ROWS[:200]))[1].collect()), key=str)
    assert keep() == keep()


def test_empty(spark):
    slots, report = mix_sources(frame(spark, []))
    assert report.collect() == [] and slots.collect() == []
    slots, report = mix_sources(frame(spark, [(1, None, None), (2, "", "a")]))
    assert [(r.doc_id, r.size, r.target, r.taken) for r in report.orderBy("doc_id").collect()] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
