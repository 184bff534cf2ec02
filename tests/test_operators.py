"""Operators on small frames, against hand-computed or brute-force answers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from perilake.functions.identity import row_hash
from perilake.functions.money import risk_level
from perilake.functions.temporal import iso_event_time, reporting_delay_days
from perilake.functions.text import decoded_key, is_run_id, run_id
from perilake.operators import audit, changes, contracts, governance, history, joins, marts, metrics, ordering, quality
from perilake.operators.dedup import latest_per_key
from perilake.operators.quality import AtLeast, IsComplete, IsUnique
from perilake.plans.contracts import CLAIM_FILE, oltp_rules, raw_claim_rules, read_raw_claims, typed_claim_rules, vocabulary_rules
from test_ingestion import CLAIM, claim


def text_frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in CLAIM) for r in rows], ", ".join(f"{c} string" for c in CLAIM))


# --- contracts ----------------------------------------------------------------------------


@pytest.mark.parametrize("broken,message", [
    ({"claim_amount": "-1"}, "claim_amount must be non-negative"),
    ({"claim_amount": ""}, "claim_amount is required"),
    ({"claim_amount": "ten"}, "claim_amount is not a decimal amount"),
    ({"claim_status": "LOST"}, "claim_status is not an allowed value"),
    ({"claim_id": "  "}, "claim_id is required"),
    ({"currency_code": "AUDX"}, "currency_code must be a 3-character ISO code"),
    ({"incident_date": "2026-13-01"}, "incident_date is not an ISO date"),
    ({"incident_date": "2026-09-03"}, "incident_date cannot be after submitted_at"),
    ({"updated_at": "2026-09-01T00:00:00Z"}, "updated_at cannot be before submitted_at"),
    ({"submitted_at": "2026-09-02T00:00:00"}, "submitted_at is not an ISO-8601 timestamp with timezone"),
    ({"approved_amount": "100.01"}, "approved_amount cannot exceed claim_amount"),
])
def test_each_fault_has_its_message(spark, broken, message):
    found = read_raw_claims(text_frame(spark, [claim(**broken)])).select(contracts.failed_rules(raw_claim_rules()).alias("f")).first().f
    assert found == [message]


def test_clean_row_passes_raw_and_typed_contracts(spark):
    frame = text_frame(spark, [claim()])
    assert read_raw_claims(frame).select(contracts.failed_rules(raw_claim_rules())).first()[0] == []
    typed = contracts.conform(frame, CLAIM_FILE)
    assert typed.select(contracts.all_hold(typed_claim_rules())).first()[0] is True
    assert typed.first().claim_status == "SUBMITTED" and typed.first().approved_amount is None


def test_conform_rounds_half_up_and_never_raises(spark):
    typed = contracts.conform(text_frame(spark, [claim(claim_amount="1.005", incident_date="x", updated_at="?")]), CLAIM_FILE).first()
    assert str(typed.claim_amount) == "1.01" and typed.incident_date is None and typed.updated_at is None


def test_null_in_a_rule_is_a_failure(spark):
    frame = spark.createDataFrame([(None,), (1,)], "x int")
    rules = [contracts.Rule("positive", F.col("x") > 0)]
    split = contracts.split_by_rules(frame, rules, run_id="r", source="s", entity="e", record_columns=["x"])
    assert split.valid.count() == 1
    bad = split.rejected.first()
    assert bad.failed_rules == ["positive"] and bad.source_record == "{}"


def test_schema_errors():
    assert contracts.schema_errors(["a", "b", "a"], ["c", "a"]) == ["duplicate columns: a", "missing columns: c"]


def test_hash_tells_nulls_apart_only_with_a_token(spark):
    frame = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    columns = ["x", "y", "z"]
    assert frame.select(row_hash(columns)).distinct().count() == 2
    assert frame.select(row_hash(columns, None)).distinct().count() == 1


def test_oltp_and_vocabulary_rules_build_for_every_entity(spark):
    row = contracts.conform(text_frame(spark, [claim()]), CLAIM_FILE)
    assert row.select(contracts.all_hold(oltp_rules("claims"))).first()[0]
    assert row.select(contracts.all_hold(vocabulary_rules("claims"))).first()[0]
    rates = spark.createDataFrame([(0.1,), (1.5,)], "commission_rate double")
    assert rates.filter(contracts.all_hold(vocabulary_rules("broker_master"))).count() == 1


# --- text and time ------------------------------------------------------------------------


def test_text_and_time_forms(spark):
    frame = spark.createDataFrame([("2026-09-02T00:00:00Z", "2026-08-30", "a%2Fb+c")], "s string, i string, k string")
    got = frame.select(
        iso_event_time(F.lit("2026-09-02")).alias("day"), iso_event_time(F.lit("2026-09-02T01:02:03.456789Z")).alias("ms"),
        iso_event_time(F.lit("2026-09-02 01:02:03 UTC")).alias("utc"), iso_event_time(F.lit("2026-09-02T10:00:00+10:00")).alias("zone"),
        reporting_delay_days("i", "s").alias("delay"), decoded_key("k").alias("key"),
        run_id("Bad batch!", F.lit("2026-09-02 00:00:00").cast("timestamp"), F.lit("0123abcd")).alias("run"),
        risk_level(F.lit("0.70000").cast("decimal(6,5)")).alias("high"), risk_level(F.lit("0.29999").cast("decimal(6,5)")).alias("low"),
    ).first()
    assert (got.day, got.ms, got.utc) == ("2026-09-02T00:00:00Z", "2026-09-02T01:02:03.456Z", "2026-09-02T01:02:03Z")
    assert got.zone == "2026-09-02T00:00:00Z" and got.delay == 3.0 and got.key == "a/b c"
    assert got.run == "v5-bad-batch-20260902T000000Z-0123abcd" and (got.high, got.low) == ("HIGH", "LOW")
    assert frame.select(is_run_id(F.lit(got.run)), is_run_id(F.lit("v5-x"))).first()[:] == (True, False)


# --- changes ------------------------------------------------------------------------------


def log(spark, rows):
    frame = spark.createDataFrame(rows, "claim_id string, status string, Op string, _dms_timestamp string")
    return changes.envelope(frame, "claims", "claim_id")


def test_change_order_decides_not_arrival(spark):
    rows = [("a", "NEW", "I", "2026-09-01"), ("a", "DONE", "U", "2026-09-03"), ("a", "OLD", "U", "2026-09-02"),
            ("b", "NEW", "I", "2026-09-01"), ("b", None, "D", "2026-09-02"), ("c", "T1", "U", "2026-09-02"), ("c", "T2", "U", "2026-09-02")]
    forward = changes.current_state(log(spark, rows), "claim_id").select("claim_id", "status").collect()
    backward = changes.current_state(log(spark, rows[::-1]), "claim_id").select("claim_id", "status").collect()
    assert sorted(forward) == sorted(backward) and dict(forward)["a"] == "DONE" and "b" not in dict(forward)


def test_incremental_equals_full_for_every_prefix(spark):
    source = random.Random(3)
    rows = [(f"k{source.randrange(6)}", f"s{i}", source.choice("IUD"), f"2026-09-{source.randrange(1, 20):02d}") for i in range(40)]
    everything = log(spark, rows)
    full = sorted(changes.current_state(everything, "claim_id").select("claim_id", "status").collect())
    for cut in (0, 13, 27, 40):
        state = changes.newest_changes(log(spark, rows[:cut]), "claim_id")
        state = changes.apply_changes(state, log(spark, rows[cut:]), "claim_id")
        state = changes.apply_changes(state, log(spark, rows[:cut]), "claim_id")  # replay
        assert sorted(changes.live(state).select("claim_id", "status").collect()) == full


# --- quality ------------------------------------------------------------------------------


def test_suite_metrics_and_gate(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, -1.0)], "k string, v double")
    results = quality.evaluate(frame, "e", [IsComplete("k"), IsUnique("k"), AtLeast("v", 0)])
    assert {r.rule: r.metric for r in results.collect()} == {'IsComplete "k"': 0.75, 'IsUnique "k"': 0.25, 'ColumnValues "v" >= 0': 0.5}
    summary = quality.summarise(results).first()
    assert (summary.failed_rules, summary.quality_score, summary.status) == (3, 0.0, "FAIL")
    with pytest.raises(quality.GateFailure):
        quality.gate(results)
    empty = quality.evaluate(frame.limit(0), "e", [IsUnique("k"), IsComplete("k")])
    assert {r.outcome for r in quality.gate(empty)} == {"Skipped"}
    assert quality.summarise(empty).first().status == "SKIPPED"


def test_stage_counts_reconcile(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", -1)], "k string, v int")
    counts = quality.stage_counts(frame, F.col("v") > 0, "k").first()
    assert counts[:] == (4, 2, 1, 1)


# --- order --------------------------------------------------------------------------------


def skewed_rows(n=3000, keys=20, seed=5):
    """A third of the rows on one key, a block of exact copies, and second-level ties."""
    source = random.Random(seed)
    start = datetime(2026, 1, 1)
    out = []
    for i in range(n):
        key = 0 if i < n // 3 else source.randrange(1, keys)
        at = start + timedelta(seconds=source.randrange(0, 40 * 86400)) if i >= 200 else start + timedelta(days=7)
        out.append((i, key, at, source.randrange(100)))
    return out


def test_ordered_index_is_dense_under_any_partitioning(spark):
    rows = skewed_rows()
    expected = {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    for parts in (1, 7):
        frame = spark.createDataFrame(rows, "id int, k int, t timestamp_ntz, v int").repartition(parts)
        got = {r.id: r.row_id for r in ordering.ordered_index(frame, ["t", "id"], partitions=5).collect()}
        assert got == expected


@pytest.mark.parametrize("n", [5, 20, 120, 997])
def test_split_cut_points(spark, n):
    start = datetime(2026, 1, 1)
    rows = [(f"c{i:04d}", start + timedelta(hours=(i * 7919) % n // 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "id string, t timestamp_ntz")
    got = {r.id: r.split for r in ordering.chronological_split(frame, "t", "id").collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for place, (key, _) in enumerate(ordered):
        assert got[key] == ("train" if place < n * 6 // 10 else "validation" if place < n * 8 // 10 else "test")


def test_each_split_needs_both_classes(spark):
    frame = spark.createDataFrame([("train", 0), ("train", 1), ("validation", 1), ("test", 0), ("test", 1)], "split string, y int")
    with pytest.raises(ValueError, match="validation split must contain both"):
        ordering.require_both_classes(frame, "y")


def test_positional_join_needs_equal_sizes(spark):
    with pytest.raises(ordering.CountMismatch):
        ordering.positional_join(spark.range(3).withColumnRenamed("id", "row_id"), spark.range(4).withColumnRenamed("id", "row_id"))


# --- metrics ------------------------------------------------------------------------------


def brute_auc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics_of_the_documented_case(spark):
    got = metrics.evaluate_binary(spark.createDataFrame([(0, .1), (0, .4), (1, .6), (1, .9)], "y int, p double"), "y", "p")
    assert got["auc"] == 1.0 and got["accuracy"] == 1.0 and got["f1"] == 1.0 and 0 < got["log_loss"] < 1
    for bad in ([(1, .5)], []):
        with pytest.raises(metrics.MetricError):
            metrics.evaluate_binary(spark.createDataFrame(bad, "y int, p double"), "y", "p")


def test_auc_matches_pairwise_counting_with_ties_and_groups(spark):
    source = random.Random(9)
    rows = [(source.choice("ab"), round(source.random(), 1) if source.random() < .7 else 0.5, source.randrange(2)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "g string, p double, y int")
    assert metrics.auc(frame, "y", "p", partitions=6).first().auc == pytest.approx(brute_auc([(p, y) for _, p, y in rows]), abs=1e-12)
    per = {r.g: r.auc for r in metrics.auc(frame, "y", "p", by=["g"], partitions=6).collect()}
    for g in "ab":
        assert per[g] == pytest.approx(brute_auc([(p, y) for h, p, y in rows if h == g]), abs=1e-12)


# --- history ------------------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_range", [65_536, 40])
def test_prior_features_equal_the_plain_window_on_a_hot_key(spark, rows_per_range):
    frame = spark.createDataFrame(skewed_rows(), "id int, k int, t timestamp_ntz, v int").withColumn("one", F.lit(1))
    at = F.unix_micros(F.col("t").cast("timestamp"))
    span = lambda n: Window.partitionBy("k").orderBy(at).rangeBetween(-n * 86_400_000_000, -1)
    plain = frame.select("id", *[F.coalesce(F.sum(c).over(span(n)), F.lit(0)).alias(f"{m}_{n}d") for m, c in (("n", "one"), ("v", "v")) for n in (1, 10)])
    keyless = frame.unionByName(frame.limit(3).withColumns({"k": F.lit(None).cast("int"), "id": F.lit(-1)}))
    got = history.prior_features(keyless, key="k", time="t", measures={"n": "one", "v": "v"}, days=[1, 10], rows_per_range=rows_per_range)
    assert got.columns == [*frame.columns, "n_1d", "n_10d", "v_1d", "v_10d"]
    assert got.filter("k IS NULL").agg(F.count("*"), F.sum("n_10d")).first()[:] == (3, 0)
    known = got.filter("k IS NOT NULL").select(plain.columns)
    assert known.exceptAll(plain).count() == 0 and known.count() == plain.count()


@pytest.mark.parametrize("rows_per_range", [65_536, 3])
def test_prior_features_keep_digits_and_types(spark, rows_per_range):
    day = lambda d: datetime(2026, 1, 1) + timedelta(days=d)
    rows = [(1, "a", day(0), 1e16), (2, "a", day(20), 0.1), (3, "a", day(45), 0.2), (4, "a", day(60), 0.3), (5, "a", day(60), 5.0), (6, "b", day(1), 7.0),
            (7, "a", day(70), 1.0), (8, "a", None, 12.0), (9, "a", None, 12.0), (10, None, day(3), 4.0), (1, "a", day(0), 1e16)]
    frame = spark.createDataFrame(rows, "id int, k string, t timestamp_ntz, v double").withColumn("money", F.col("id").cast("decimal(18,2)"))
    got = history.prior_features(frame, key="k", time="t", measures={"v": "v", "m": "money"}, days=[30], rows_per_range=rows_per_range)
    found = sorted((r.id, r.v_30d, float(r.m_30d)) for r in got.collect())
    want = []
    for i, k, t, _ in rows:
        near = [(v, j) for j, q, u, v in rows if None not in (k, t, u) and q == k and t - timedelta(days=30) <= u < t]
        want.append((i, sum(v for v, _ in near), float(sum(j for _, j in near))))
    assert found == sorted(want)
    assert got.schema["m_30d"].dataType.simpleString() == "decimal(28,2)" and got.schema["v_30d"].dataType.simpleString() == "double"


def test_a_dense_key_is_cut_by_row_count(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"),
                                      (F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("t"), "id")
    sizes = [r.n for r in ordering.range_ordered(rows, ["k", "t", "id"], 8).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 40_000 / 8


def test_ranges_follow_the_data(spark):
    rows = lambda n: spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 20).alias("wide"))
    sizes = {}
    for n in (20_000, 200_000):
        parts = ordering.range_ordered(rows(n), ["k"], rows_per_range=2_000).groupBy("_part").count().collect()
        sizes[n] = [r["count"] for r in parts]
    assert len(sizes[20_000]) == 10 and len(sizes[200_000]) == 100
    assert max(max(x) for x in sizes.values()) <= 2 * 2_000
    assert ordering.range_count(rows(0).limit(0)) == 1


def test_future_references_are_counted_without_pairs(spark):
    rng = random.Random(3)
    facts = [("hot", rng.randrange(900)) for _ in range(1000)] + [("one", 5), (None, 3), ("hot", None), ("lonely", 1)]
    versions = [("hot", rng.randrange(900)) for _ in range(1000)] + [("one", 9), ("one", 5), (None, 3), ("hot", None)]
    stamp = lambda rows: spark.createDataFrame([(k, None if t is None else datetime(2026, 1, 1) + timedelta(hours=t)) for k, t in rows], "k string, t timestamp_ntz")
    got = joins.future_reference_count(stamp(facts), stamp(versions), key="k", time="t", version_time="t").first()
    pairs = [(t, u) for k, t in facts for q, u in versions if k is not None and k == q]
    assert got[:] == (len(pairs), sum(None not in p and p[1] > p[0] for p in pairs))


def test_asof_join_matches_brute_force(spark):
    rows = skewed_rows(900)
    facts, versions = rows[:600:2] + rows[1::3], rows[:600:3] + rows[::7]
    versions = list({v[0]: v for v in versions}.values())
    f = spark.createDataFrame(facts, "id int, k int, t timestamp_ntz, v int").withColumn("n", F.monotonically_increasing_id())
    v = spark.createDataFrame(versions, "id int, k int, t timestamp_ntz, v int").withColumnRenamed("v", "value")
    got = joins.asof_join(f, v, key="k", time="t", version_time="t", take={"version": "id"}, tie="id").collect()
    assert len(got) == len(facts)
    for r in got:
        known = [(w[2], w[0]) for w in versions if w[1] == r.k and w[2] <= r.t]
        assert r.version == (max(known)[1] if known else None)


def test_asof_respects_the_end_of_a_version(spark):
    f = spark.createDataFrame([("a", datetime(2026, 1, 5)), ("a", datetime(2026, 3, 5)), ("b", None)], "k string, t timestamp_ntz")
    v = spark.createDataFrame([("a", datetime(2026, 1, 1), datetime(2026, 2, 1), "v1")], "k string, s timestamp_ntz, e timestamp_ntz, name string")
    got = joins.asof_join(f, v, key="k", time="t", version_time="s", take={"name": "name"}, effective_to="e")
    assert sorted((r.k, r.name) for r in got.collect() if r.name) == [("a", "v1")] and got.count() == 3


@pytest.mark.parametrize("rows_per_range", [65_536, 50, 8])
def test_status_history_spans_buckets(spark, rows_per_range):
    rows = skewed_rows(600)
    frame = spark.createDataFrame([(i, k, t, "ABC"[v % 3]) for i, k, t, v in rows], "id int, k int, t timestamp_ntz, status string")
    got = history.status_history(frame, key="k", status="status", time="t", tie="id", rows_per_range=rows_per_range).collect()
    found = {(r.k, r.source_order): (r.previous_status, r.status, r.valid_to) for r in got}
    expected = {}
    for key in {r[1] for r in rows}:
        mine = sorted((t, i, "ABC"[v % 3]) for i, k, t, v in rows if k == key)
        moves = [m for n, m in enumerate(mine) if n == 0 or mine[n - 1][2] != m[2]]
        for n, (t, i, s) in enumerate(moves):
            before = moves[n - 1][2] if n else None
            expected[(key, i)] = (before, s, moves[n + 1][0] if n + 1 < len(moves) else None)
    assert found == expected


def test_overlap_sees_any_earlier_version(spark):
    day = lambda d: datetime(2026, 1, d)
    rows = [("p", day(1), day(20)), ("p", day(3), day(4)), ("p", day(10), day(12)), ("p", day(20), None), ("p", day(25), day(26)), ("q", day(1), None)]
    frame = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz")
    got = history.overlapping_validity(frame, key="k", start="s", end="e").collect()
    assert sorted(r.s.day for r in got) == [3, 10, 25]


# --- joins --------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, how):
    facts = spark.createDataFrame(skewed_rows(900), "id int, k int, t timestamp_ntz, v int").repartition(6)
    other = spark.createDataFrame([(k, f"n{k}") for k in range(0, 15)] + [(0, "second")], "k int, name string")
    columns = ["id", "k", "name"]
    spread = joins.spread_join(facts, other, "k", how, share=0.1, rows_per_task=100).select(columns)
    plain = facts.join(other, "k", how).select(columns)
    assert spread.exceptAll(plain).count() == 0 and spread.count() == plain.count()


def test_orphans_and_nullable_keys(spark):
    child = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", None), ("4", "")], "id string, fk string")
    parent = spark.createDataFrame([("a",)], "pk string")
    assert joins.orphans(child, "fk", parent, "pk").count() == 3
    assert [r.id for r in joins.orphans(child, "fk", parent, "pk", nullable=True).collect()] == ["2"]
    assert joins.orphan_count(child, "fk", parent, "pk", True).first()[:] == (1, 1)


def test_new_files_by_content(spark):
    landing = spark.createDataFrame([("a.csv", "h1"), ("b.csv", "h1"), ("c.csv", "h2"), ("d.csv", "h3")], "source_object string, source_file_id string")
    ledger = spark.createDataFrame([("h2",)], "source_file_id string")
    got = {r.source_object: r.status for r in joins.new_files(landing, ledger).collect()}
    assert got == {"a.csv": "NEW", "b.csv": "DUPLICATE", "c.csv": "DUPLICATE", "d.csv": "NEW"}


def test_key_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert joins.key_set_difference(a, b, ["k"]).first()[:] == (2, 2, 1, 1, False)
    assert [r.k for r in joins.only_in(a, b, ["k"]).collect()] == [1]
    assert joins.key_set_difference(a, a, ["k"]).first().complete


def test_latest_is_independent_of_partitioning(spark):
    rows = [(k, t, h) for k in range(5) for t in range(3) for h in "xy"]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = latest_per_key(spark.createDataFrame(rows, "k int, t int, h string").repartition(3), ["k"], ["t", "h"]).collect()
        assert {(r.k, r.t, r.h) for r in got} == {(k, 2, "y") for k in range(5)}


# --- audit, marts, governance ---------------------------------------------------------------


def test_audit_errors(spark):
    schema = ("run_id string, pipeline_name string, source string, stage string, status string, input_count long, "
              "output_count long, rejected_count long, duplicate_count long, reconciliation_passed boolean")
    rows = [("r", "p", "s", "silver", "SUCCEEDED", 3, 1, 1, 1, True), ("r", "p", "s", "silver", "SUCCEEDED", 3, 1, 0, 1, False),
            ("r", "p", "s", "silver", "SUCCEEDED", -1, 0, 0, 0, True), (None, "p", "s", "silver", "SUCCEEDED", None, 0, 0, 0, True)]
    frame = spark.createDataFrame(rows, schema)
    assert [r[0] for r in frame.select(audit.audit_errors(frame)).collect()] == [
        [], ["batch reconciliation failed", "reconciliation_passed is not true"], ["audit counts must be non-negative integers"],
        ["missing audit fields: input_count,run_id"]]


def test_score_of_an_empty_run_is_one(spark):
    runs = spark.createDataFrame([("SUCCEEDED", 0, 0, 0, 0), ("FAILED", 2, 2, 0, 0)], "status string, input_count long, output_count long, rejected_count long, duplicate_count long")
    got = audit.finish_audit(runs).collect()
    assert (got[0].quality_score, got[0].reconciliation_passed, got[1].reconciliation_passed) == (1.0, True, False)


def test_constant_columns_and_coverage(spark):
    frame = spark.createDataFrame([("a", 1, None), ("A", 1, None), ("", 1, 2)], "c string, one int, part int")
    assert [r.feature for r in marts.constant_columns(frame, ["c", "one", "part"]).collect()] == ["one"]
    assert {(r.level, r.row_count) for r in marts.categorical_coverage(frame, ["c"]).collect()} == {("A", 2), ("MISSING", 1)}


def test_governance(spark):
    fact = spark.createDataFrame([("c", "u", "n", 1.0, "text")], "claim_id string, customer_id string, claim_number string, claim_amount double, description string")
    assert governance.governed_view(fact, "Analyst", "fact_claim").columns == ["claim_id", "claim_amount"]
    reviewed = governance.approved_columns("Analyst", "fact_claim", ["claim_id"])
    assert governance.governed_view(fact, "Analyst", "fact_claim", reviewed).columns == ["claim_id"]  # drift stays out
    for persona, table in (("RAGApplication", "fact_claim"), ("MLEngineer", "fact_claim"), ("Analyst", "claim"), ("Guest", "claim_risk")):
        with pytest.raises(governance.AccessDenied):
            governance.governed_view(fact, persona, table)
    got = {r.column_name: (r.sensitivity, r.personal, r.exposed_values) for r in governance.pii_columns(fact).collect()}
    assert got["description"] == ("HIGH", True, 1) and got["claim_amount"] == ("MEDIUM", False, 1)
