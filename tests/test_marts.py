"""Policy and broker marts against plain sums, with dimensions joined below and above the aggregation."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest

from conftest import rows
from perilake.operators import quality
from perilake.operators.dedup import latest_per_key
from perilake.operators.joins import Dimension, dealt_by, heavy_keys
from perilake.operators.marts import policy_performance
from perilake import session
from perilake.session import durable

KEYS = ["policy_id", "category", "broker_id", "broker_name", "currency"]


def made(n, hot):
    """Claims in several versions; policy 7 holds ``hot`` of them."""
    rng = random.Random(n)
    return [(f"c{rng.randrange(n // 2)}", 7 if rng.random() < hot else rng.choice([None, *range(1, 200)]), rng.choice([1, 2, 3, 4, None]), rng.choice([10, 20, 30]),
             rng.choice(["A", "B"]), Decimal(rng.randrange(10_000)) / 100, rng.choice([None, Decimal(rng.randrange(5_000)) / 100]), rng.randrange(100)) for _ in range(n)]


PRODUCTS = {1: "home", 2: "home", 3: "auto"}  # two products of one category; 4 is unknown
BROKERS = {10: "ten", 20: "twenty"}
POLICIES = {p: Decimal(p) for p in range(1, 190)}  # policies from 190 on are unknown and go


def brute(claims):
    groups = defaultdict(list)
    for claim, policy, product, broker, currency, amount, approved, sent in claims:
        if policy in POLICIES:
            groups[policy, PRODUCTS.get(product), broker, BROKERS.get(broker), currency].append((claim, amount, approved or 0, sent))
    return {key: (POLICIES[key[0]], len({c for c, *_ in found}), sum(a for _, a, _, _ in found), sum(a for _, _, a, _ in found), max(s for *_, s in found))
            for key, found in groups.items()}


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_policy_performance_with_dimensions(spark, hot):
    claims = made(4000, hot)
    fact = spark.createDataFrame(claims, "claim_id string, policy_id int, product_id int, broker_id int, currency string, claim_amount decimal(18,2), approved_amount decimal(18,2), submitted_at int")
    assert heavy_keys(fact, "policy_id") == ([7] if hot else [])
    dimensions = [
        Dimension(durable(spark.createDataFrame(list(POLICIES.items()), "p int, premium decimal(18,2)")), "p", "policy_id", {"annual_premium_amount": "premium"}, how="inner"),
        Dimension(durable(spark.createDataFrame(list(PRODUCTS.items()), "p int, kind string")), "p", "product_id", {"category": "kind"}),
        Dimension(durable(spark.createDataFrame(list(BROKERS.items()), "b int, name string")), "b", "broker_id", {"broker_name": "name"}),
    ]
    got = policy_performance(fact, KEYS, dimensions=dimensions)
    plan = got._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r[k] for k in KEYS): (r["annual_premium_amount"], r["claim_count"], r["total_claim_amount"], r["total_approved_amount"], r["latest_claim_submitted_at"]) for r in rows(got)}
    assert found == brute(claims)
    one = next(r for r in rows(got) if r["policy_id"] == 7)
    assert float(one["loss_ratio"]) == pytest.approx(float(one["total_approved_amount"]) / 7, abs=1e-4)
    if not hot:
        dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "BroadcastExchange" not in line]
        assert len(dealt) == 1 and "policy_id" in dealt[0] and "broker" not in dealt[0]


def test_policy_performance_of_an_enriched_fact(spark):
    claims = [c for c in made(600, 0.3) if c[1] in POLICIES]
    wide = [(*c, POLICIES[c[1]], PRODUCTS.get(c[2]), BROKERS.get(c[3])) for c in claims]
    fact = spark.createDataFrame(wide, "claim_id string, policy_id int, product_id int, broker_id int, currency string, claim_amount decimal(18,2), approved_amount decimal(18,2), submitted_at int, annual_premium_amount decimal(18,2), category string, broker_name string")
    got = policy_performance(fact, KEYS)
    found = {tuple(r[k] for k in KEYS): (r["annual_premium_amount"], r["claim_count"], r["total_claim_amount"], r["total_approved_amount"], r["latest_claim_submitted_at"]) for r in rows(got)}
    assert found == brute(claims)
    assert policy_performance(fact.limit(0), KEYS).count() == 0


def test_tasks_follow_the_number_of_claims(spark, monkeypatch):
    monkeypatch.setattr(session.tasks_for, "__defaults__", (100,))
    claims = [c for c in made(2000, 0.0) if c[1] in POLICIES]
    wide = [(*c, POLICIES[c[1]], PRODUCTS.get(c[2]), BROKERS.get(c[3])) for c in claims]
    fact = spark.createDataFrame(wide, "claim_id string, policy_id int, product_id int, broker_id int, currency string, claim_amount decimal(18,2), approved_amount decimal(18,2), submitted_at int, annual_premium_amount decimal(18,2), category string, broker_name string")
    got = policy_performance(fact, KEYS)
    assert "hashpartitioning(policy_id#" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert f", {-(-len(claims) // 100)}), REPARTITION_BY_NUM" in plan
    found = {tuple(r[k] for k in KEYS): (r["annual_premium_amount"], r["claim_count"], r["total_claim_amount"], r["total_approved_amount"], r["latest_claim_submitted_at"]) for r in rows(got)}
    assert found == brute(claims)


@pytest.mark.parametrize("hot", [0, 300])
def test_uniqueness_of_dealt_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(session.tasks_for, "__defaults__", (100,))
    claims = [(f"c{i % 700}", i) for i in range(1000)] + [("c5", -i) for i in range(hot)] + [(None, 1), (None, 2)]
    frame = spark.createDataFrame(claims, "claim_id string, at int")
    parts = dealt_by(frame, "claim_id")
    assert len(parts) == (2 if hot else 1) and sum(p.count() for p in parts) == len(claims)
    assert parts[0].rdd.getNumPartitions() == -(-len(claims) // 100)
    for now in (parts, [latest_per_key(p, ["claim_id"], ["at"]) for p in parts]):
        whole = now[0].unionByName(now[1]) if hot else now[0]
        assert rows(quality.evaluate_parts(now, "c", [quality.IsUnique("claim_id")])) == rows(quality.evaluate(whole, "c", [quality.IsUnique("claim_id")]))
    plan = quality.evaluate_parts(dealt_by(frame, "claim_id")[:1], "c", [quality.IsUnique("claim_id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(claim_id") == 1 and "hashpartitioning(k" not in plan
