import numpy as np

from perilake.llm.quality import NAMES, estimate, fit_quality, keep_quality, op2_quality_classifier, scored, votes_of

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    kept = {r.doc_id for r in op2_quality_classifier(spark, MEDIUM).collect()}
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()
    right = [(r.doc_id in kept) == (r.quality == 1) for r in labels]
    assert np.mean(right) > 0.97  # the labels were never used
    assert np.mean([r.doc_id in kept for r in labels if r.quality == 1]) > 0.98


def test_estimate_finds_the_accuracies():
    rng = np.random.default_rng(3)
    bad = rng.random(40_000) < 0.2
    rates = np.linspace(0.55, 0.9, len(NAMES))  # how often a labeller spots a bad document
    votes = np.where(rng.random((len(bad), len(NAMES))) < np.where(bad[:, None], rates, 0.03), 2, 1)
    votes[rng.random(votes.shape) < 0.3] = 0
    codes, counts = np.unique(votes @ (3 ** np.arange(len(NAMES))), return_counts=True)
    assert (votes_of(codes) @ (3 ** np.arange(len(NAMES))) == codes).all()
    _, tables, share = estimate(codes, counts.astype(float), false_alarms=0.1, seen=(0.01, 0.99))
    assert abs(share - 0.2) < 0.02 and np.abs(tables[1, :, 2] - rates).max() < 0.05 and tables[0, :, 2].max() < 0.05


def test_odd_rows(spark):
    good = "An ordinary sentence about rivers, towns and the people who live there. Another follows it with other words."
    junk = "BUY NOW!! CHEAP!! DEAL!! CLICK!! HERE!! FAST!! " * 5
    rows = [(i, f"{good} number {i}", 1.0) for i in range(60)] + [(100 + i, junk + str(i), 1.0) for i in range(20)]
    rows += [(200, None, 1.0), (201, "", 1.0), (202, " \n ", 1.0), (None, good, 1.0), (5, rows[5][1], 1.0), (203, good * 4000, 1.0), (204, junk * 4000, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    kept = keep_quality(frame)
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(60)), "5", "None", "203"])
    model = fit_quality(frame)
    assert {r.s for r in scored(frame.filter("doc_id between 200 and 202"), model, name="s").collect()} == {0.0}
    assert keep_quality(frame.limit(0)).collect() == []
