import random

import numpy as np
import pytest

from perilake.llm import ngram_join
from perilake.llm.components import Forest, components
from perilake.llm.ngram_join import ngram_links, one_of_each


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n=4, percent=85):
    """Component ids by comparing all pairs; rows with equal ids are rows of their own."""
    sets = [shingles(t, n) for _, t in rows]
    trees = Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                trees.union(i, j)
    least = {}
    for i, (name, _) in enumerate(rows):
        root = trees.find(i)
        names = [x for x in (least.get(root), name) if x is not None]
        least[root] = min(names) if names else None
    return sorted(((name, len(sets[i]), least[trees.find(i)]) for i, (name, _) in enumerate(rows)), key=str)


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice(([], ["edit%d" % rng.randrange(9)], [out[at], "more"]))
    return " ".join(out)


def corpus(seed, bases, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        if rng.random() < 0.4:
            base += passage
        rows += [near(rng, base, rng.randrange(edits)) for _ in range(rng.randrange(1, copies))]
    rng.shuffle(rows)
    return list(enumerate(rows))


ODD = [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two three"), (506, "a b c d"), (None, "a  b\tc D"), (None, "alone is this text"),
       (None, None), (999, "repeated id but other text entirely here"), (999, "repeated id but other text entirely here"), (507, "x " * 9000), (508, "y x " * 9000)]


def result(frame, **options):
    return sorted((tuple(r) for r in ngram_links(frame, **options).collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, cluster string, size int")


def test_same_as_all_pairs(spark):
    rows = corpus(1, 25, 8, 5) + ODD
    assert result(make(spark, rows)) == brute(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_cut_clusters_lose_no_link(spark, seed):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(300)}" for _ in range(70)]
    rows = [(i, near(rng, base, rng.randrange(9))) for i in range(60)] + [(100 + i, t) for i, t in corpus(seed, 6, 6, 4)]
    assert result(make(spark, rows), block_sets=7) == brute(rows)


def test_one_stays(spark):
    rows = corpus(4, 10, 6, 3) + ODD
    frame = make(spark, rows)
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    want = {(i, t) for (i, t) in rows for (name, _, c) in [next(x for x in brute([*rows], 5, 80) if x[0] == i)] if name == c}
    assert {(r.doc_id, r.text) for r in kept.collect()} >= {w for w in want if w[0] is not None and w[0] != 999}
    assert kept.filter("doc_id = 999").count() == 1
    assert one_of_each(frame.limit(0)).collect() == [] and result(frame.limit(0)) == []


def test_texts_with_common_passages_make_no_cluster(spark, monkeypatch):
    rng = random.Random(8)
    passages = [[f"p{i}_{rng.randrange(10**6)}" for _ in range(60)] for i in range(61)]
    rows = [(i, " ".join(passages[i] + [f"u{i}_{k}" for k in range(200)] + passages[i + 1])) for i in range(60)]
    rows += [(100 + i, near(rng, rows[i][1].split(), 3)) for i in range(2)]
    edges = []

    def counted(found, *names):
        edges.append(found.count())
        return components(found, *names)

    monkeypatch.setattr(ngram_join, "components", counted)
    monkeypatch.setattr(ngram_join, "count_cells", lambda *_: np.ones(1 << ngram_join.CELL_BITS, dtype=np.uint64))  # as in large tables
    assert result(make(spark, rows)) == brute(rows)
    assert edges[0] == 2


def test_long_lists_of_texts_are_fetched_by_marks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = corpus(9, 6, 5, 4) + ODD
    assert result(make(spark, rows)) == brute(rows)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(80)]
    trees = Forest()
    for a, b in edges:
        trees.union(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b").collect()}
    assert got == dict(trees.pairs())
