"""Gold tables, BI cuts, profiles, governance and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.operators import contracts, governance, history, joins, marts, quality
from perilake.operators.contracts import Rule
from perilake.operators.dedup import latest_per_key
from perilake.operators.quality import IsUnique
from perilake.workload.base import (
    BROKER_KEYS, CLAIM_LINES, ENRICHED, POLICIES, POLICY_KEYS, Tables, as_double, cents, claim_dimensions, claim_lines, day, enriched_claims,
    instant, query,
)

# --- star join and performance ----------------------------------------------------------------


@query(sql=f"""WITH {ENRICHED}
SELECT claim_id, policy_id, customer_id, product_id, product_type, product_category, product_name, broker_id, broker_name, branch_id,
       branch_name, broker_region_code, coverage_tier, claim_category, claim_status, overall_risk_band, currency_code,
       coalesce(vehicle_risk_category, '') AS vehicle_risk_category, strftime(incident_date, '%Y-%m-%d') AS incident_date,
       strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at, CAST(claim_amount AS DOUBLE) AS claim_amount,
       CAST(approved_amount AS DOUBLE) AS approved_amount, CAST(annual_premium_amount AS DOUBLE) AS annual_premium_amount
FROM enriched""")
def enriched_fact(t: Tables) -> DataFrame:
    return enriched_claims(t).drop("region_key", "line_number", "discount", "tax", "product_size", "broker_balance").withColumns({
        "incident_date": day("incident_date"), "submitted_at": instant("submitted_at"),
        "vehicle_risk_category": F.coalesce("vehicle_risk_category", F.lit("")),
        **as_double("claim_amount", "approved_amount", "annual_premium_amount"),
    })


@query(sql=f"""WITH {CLAIM_LINES} SELECT o_custkey AS customer_id, o_orderstatus AS claim_status, count(*) AS claim_count, CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount
FROM claims JOIN orders ON policy_id = o_orderkey GROUP BY 1, 2""")
def spread_claims_to_policies(t: Tables) -> DataFrame:
    """Claims meet their policy by a join that spreads the policies holding most of the claims."""
    policies = t.orders.select(F.col("o_orderkey").alias("policy_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("claim_status"))
    joined = joins.spread_join(claim_lines(t), policies, "policy_id", share=0.0001)
    return joined.groupBy("customer_id", "claim_status").agg(
        F.count(F.lit(1)).alias("claim_count"), F.sum("claim_amount").cast("double").alias("total_claim_amount"))


def _policies(t: Tables) -> DataFrame:
    return marts.policy_performance(claim_lines(t), POLICY_KEYS, dimensions=claim_dimensions(t))


def _brokers(t: Tables) -> DataFrame:
    return marts.broker_performance(_policies(t), BROKER_KEYS)


_RATIO = "CASE WHEN {d} > 0 THEN round(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE), 6) END"


@query(sql=f"""WITH {POLICIES}
SELECT policy_id, broker_id, currency_code, product_type, product_category, branch_name, claim_count,
       CAST(annual_premium_amount AS DOUBLE) AS annual_premium_amount, CAST(total_claim_amount AS DOUBLE) AS total_claim_amount,
       CAST(total_approved_amount AS DOUBLE) AS total_approved_amount,
       strftime(latest_claim_submitted_at, '%Y-%m-%d %H:%M:%S') AS latest_claim_submitted_at,
       {_RATIO.format(n='total_approved_amount', d='annual_premium_amount')} AS loss_ratio FROM policies""")
def policy_performance(t: Tables) -> DataFrame:
    rows = _policies(t).withColumns({
        "loss_ratio": F.round(F.col("loss_ratio").cast("double"), 6), "latest_claim_submitted_at": instant("latest_claim_submitted_at"),
        **as_double("annual_premium_amount", "total_claim_amount", "total_approved_amount")})
    return rows.select("policy_id", "broker_id", "currency_code", "product_type", "product_category", "branch_name", "claim_count",
                       "annual_premium_amount", "total_claim_amount", "total_approved_amount", "latest_claim_submitted_at", "loss_ratio")


BROKER_SELECT = f"""SELECT broker_id, broker_name, branch_id, branch_name, broker_region_code, currency_code, active_policy_count,
       CAST(total_annual_premium AS DOUBLE) AS total_annual_premium, CAST(claim_count AS BIGINT) AS claim_count,
       CAST(total_claim_amount AS DOUBLE) AS total_claim_amount, CAST(total_approved_amount AS DOUBLE) AS total_approved_amount,
       {_RATIO.format(n='total_approved_amount', d='total_annual_premium')} AS loss_ratio FROM brokers"""


def _broker_output(brokers: DataFrame) -> DataFrame:
    return brokers.withColumns({
        "loss_ratio": F.round(F.col("loss_ratio").cast("double"), 6),
        **as_double("total_annual_premium", "total_claim_amount", "total_approved_amount")})


@query(sql=f"WITH {POLICIES} {BROKER_SELECT}")
def broker_performance(t: Tables) -> DataFrame:
    return _broker_output(_brokers(t))


@query(sql=f"""WITH {POLICIES}, b AS ({BROKER_SELECT}) SELECT broker_id, broker_name, branch_id, branch_name, broker_region_code,
  active_policy_count, total_annual_premium, claim_count, loss_ratio FROM b ORDER BY total_annual_premium DESC""")
def bi_broker_ranking(t: Tables) -> DataFrame:
    return marts.broker_ranking(_broker_output(_brokers(t)))


@query(sql=f"""WITH {ENRICHED} SELECT claim_category, overall_risk_band, count(*) AS claim_count, CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount
FROM enriched GROUP BY 1, 2 ORDER BY 4 DESC""")
def bi_category_band(t: Tables) -> DataFrame:
    return marts.claims_by_category_band(enriched_claims(t)).withColumns(as_double("total_claim_amount"))


@query(sql=f"""WITH {POLICIES} SELECT product_category, count(DISTINCT policy_id) AS policy_count, CAST(sum(annual_premium_amount) AS DOUBLE) AS written_premium,
  CAST(sum(claim_count) AS BIGINT) AS claim_count, round(CAST(sum(total_approved_amount) AS DOUBLE) / nullif(CAST(sum(annual_premium_amount) AS DOUBLE), 0), 6) AS loss_ratio
FROM policies GROUP BY 1 ORDER BY 3 DESC""")
def bi_product_kpis(t: Tables) -> DataFrame:
    return marts.product_category_kpis(_policies(t)).withColumns({
        "loss_ratio": F.round(F.col("loss_ratio").cast("double"), 6), **as_double("written_premium")})


@query(sql=f"""WITH {ENRICHED} SELECT coverage_tier, coalesce(vehicle_risk_category, 'NOT_APPLICABLE') AS vehicle_risk_category, count(*) AS claim_count,
  CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount FROM enriched GROUP BY 1, 2 ORDER BY 4 DESC""")
def bi_coverage_cut(t: Tables) -> DataFrame:
    return marts.coverage_vehicle_cut(enriched_claims(t)).withColumns(as_double("total_claim_amount"))


@query(sql=f"""WITH {ENRICHED} SELECT claim_id, claim_status, CAST(claim_amount AS DOUBLE) AS claim_amount, CAST(approved_amount AS DOUBLE) AS approved_amount,
  currency_code, strftime(incident_date, '%Y-%m-%d') AS incident_date, strftime(submitted_at, '%Y-%m-%d') AS submitted_at,
  strftime(submitted_at, '%Y-%m-%d') AS updated_at, policy_id, customer_id FROM enriched""")
def bi_fact_claim(t: Tables) -> DataFrame:
    fact = contracts.drop_sensitive(enriched_claims(t).withColumn("updated_at", F.col("submitted_at")), ["product_name"])
    return marts.bi_fact_claim(fact).withColumns({
        **{c: day(c) for c in ("incident_date", "submitted_at", "updated_at")}, **as_double("claim_amount", "approved_amount")})


@query(sql=f"""WITH {ENRICHED} SELECT strftime(incident_date, '%Y-%m-%d') AS incident_date, claim_status, currency_code, count(*) AS claim_count,
  CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount, CAST(sum(coalesce(approved_amount, 0)) AS DOUBLE) AS total_approved_amount,
  sha256(concat_ws('||', strftime(incident_date, '%Y-%m-%d'), claim_status, currency_code)) AS record_hash FROM enriched GROUP BY 1, 2, 3""")
def daily_summary(t: Tables) -> DataFrame:
    summary = marts.daily_summary(enriched_claims(t), ["incident_date", "claim_status", "currency_code"])
    return summary.withColumnRenamed("_record_hash", "record_hash").withColumns({
        "incident_date": day("incident_date"), **as_double("total_claim_amount", "total_approved_amount")})


@query(sql=f"""WITH {ENRICHED} SELECT strftime(incident_date, '%Y-%m-%d') AS incident_date, claim_status, count(*) AS claim_count,
  CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount, CAST(sum(coalesce(approved_amount, 0)) AS DOUBLE) AS total_approved_amount, currency_code
FROM enriched GROUP BY incident_date, claim_status, currency_code""")
def bi_claim_daily_summary(t: Tables) -> DataFrame:
    summary = marts.daily_summary(enriched_claims(t), ["incident_date", "claim_status", "currency_code"])
    return marts.bi_daily_summary(summary).withColumns({
        "incident_date": day("incident_date"), **as_double("total_claim_amount", "total_approved_amount")})


@query(sql=f"""WITH {ENRICHED} SELECT coalesce(claim_status, 'ALL') AS status, count(*) AS claim_count, CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount,
  CAST(sum(approved_amount) AS DOUBLE) AS total_approved_amount FROM enriched GROUP BY ROLLUP (claim_status)""")
def dashboard_kpis(t: Tables) -> DataFrame:
    return marts.dashboard_kpis(enriched_claims(t)).withColumns(as_double("total_claim_amount", "total_approved_amount"))


# --- profiles ---------------------------------------------------------------------------------


@query(sql="""SELECT quality, count(*) AS row_count, round(avg(CAST(n_chars AS DOUBLE)), 4) AS average_chars, round(avg(CAST(toxic AS DOUBLE)), 6) AS average_toxic,
  round(avg(CAST(doc_id AS DOUBLE)), 4) AS average_doc FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_profile(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    profile = marts.label_profile(rows, "quality", {"average_chars": "n_chars", "average_toxic": "toxic", "average_doc": "doc_id"})
    return profile.withColumns({
        "average_chars": F.round("average_chars", 4), "average_toxic": F.round("average_toxic", 6), "average_doc": F.round("average_doc", 4)})


@query(sql="""SELECT count(*) AS total_rows, count(*) FILTER (quality IS NULL) AS missing_quality, count(*) FILTER (toxic IS NULL) AS missing_toxic,
  count(*) FILTER (lang IS NULL) AS missing_lang, count(*) FILTER (source IS NULL) AS missing_source, count(*) FILTER (text IS NULL) AS missing_text
FROM documents LEFT JOIN labels USING (doc_id)""")
def completeness(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    return marts.completeness_profile(rows, {f"missing_{c}": c for c in ("quality", "toxic", "lang", "source", "text")})


@query(sql=f"""WITH {ENRICHED} SELECT count(*) AS total_rows, count(*) FILTER (submitted_at IS NULL) AS missing_prediction_timestamp,
  count(*) FILTER (incident_date > CAST(submitted_at AS DATE)) AS future_incident_date, count(*) FILTER (claim_amount < 0) AS invalid_claim_amount FROM enriched""")
def pit_profile(t: Tables) -> DataFrame:
    return marts.point_in_time_profile(enriched_claims(t), submitted="submitted_at", incident="incident_date", amount="claim_amount")


@query(sql="""SELECT lang, quality, count(*) AS row_count FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def class_distribution(t: Tables) -> DataFrame:
    return marts.class_distribution(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), "quality", ["lang"])


@query(sql="""SELECT 'p_brand' AS feature, upper(p_brand) AS level, count(*) AS row_count FROM part GROUP BY 2
UNION ALL SELECT 'p_type', upper(p_type), count(*) FROM part GROUP BY 2
UNION ALL SELECT 'size_band', coalesce(CASE WHEN p_size > 25 THEN 'LARGE' END, 'MISSING'), count(*) FROM part GROUP BY 2""")
def categorical_coverage(t: Tables) -> DataFrame:
    rows = t.part.withColumn("size_band", F.when(F.col("p_size") > 25, "large"))
    return marts.categorical_coverage(rows, ["p_brand", "p_type", "size_band"])


@query(sql="""SELECT feature FROM (
  SELECT 'prefix' AS feature, count(DISTINCT left(c_name, 9)) AS n FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer
  UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'positive', count(DISTINCT c_custkey >= 0) FROM customer) WHERE n <= 1""")
def constant_features(t: Tables) -> DataFrame:
    rows = t.customer.withColumns({"prefix": F.substring("c_name", 1, 9), "positive": F.col("c_custkey") >= 0})
    return marts.constant_columns(rows, ["prefix", "c_mktsegment", "c_nationkey", "positive"])


@query(sql="SELECT count(DISTINCT l_orderkey || '-' || l_linenumber) AS distinct_claims FROM lineitem")
def distinct_claims(t: Tables) -> DataFrame:
    return marts.distinct_claims(claim_lines(t), "claim_id")


# --- integrity --------------------------------------------------------------------------------


@query(sql="""SELECT 'lineitem.l_orderkey' AS foreign_key, 'late_orders.o_orderkey' AS "references", count(*) AS orphan_rows, count(DISTINCT l_orderkey) AS orphan_keys
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'orders.o_custkey', 'customer.c_custkey', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'labels.doc_id', 'documents.doc_id', count(*), count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def integrity_report(t: Tables) -> DataFrame:
    tables = {"lineitem": t.lineitem, "late_orders": t.orders.filter(F.col("o_orderstatus") != "P"), "orders": t.orders,
              "customer": t.customer, "labels": t.labels, "documents": t.documents}
    return joins.integrity_report(tables, [
        ("lineitem", "l_orderkey", "late_orders", "o_orderkey", False), ("orders", "o_custkey", "customer", "c_custkey", False),
        ("labels", "doc_id", "documents", "doc_id", True)])


@query(sql="""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)""")
def orphans(t: Tables) -> DataFrame:
    large = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
    return joins.orphans(t.customer, "c_custkey", large, "o_custkey").select("c_custkey", "c_mktsegment")


@query(sql="""SELECT l_orderkey, l_linenumber, l_suppkey, s_nationkey AS owner, c_nationkey AS expected_owner FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey""")
def owner_consistency(t: Tables) -> DataFrame:
    """Line items whose supplier sits in another nation than the ordering customer."""
    sold = joins.star_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), [
        joins.Dimension(t.supplier, "s_suppkey", "l_suppkey", how="inner", columns={"owner": "s_nationkey"})])
    ordered = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joins.inconsistent_owner(sold, "l_orderkey", "owner", ordered, "o_orderkey", "c_nationkey")


@query(sql="""SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS expected_keys, (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_acctbal >= 0) AS visible_keys,
 (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal >= 0)) AS missing_keys,
 (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal >= 0 EXCEPT SELECT o_custkey FROM orders)) AS unexpected_keys""")
def key_set_difference(t: Tables) -> DataFrame:
    expected = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    visible = t.customer.filter(F.col("c_acctbal") >= 0).select("c_custkey")
    return joins.key_set_difference(expected, visible, ["c_custkey"]).drop("complete")


@query(sql="""SELECT 'c_name' AS business_key, count(*) AS row_count, round(count(DISTINCT c_name) / count(*), 6) AS metric, 'Passed' AS outcome FROM customer
UNION ALL SELECT 's_name', count(*), round(count(DISTINCT s_name) / count(*), 6), 'Passed' FROM supplier
UNION ALL SELECT 'p_name', CAST(sum(n) AS BIGINT), round(sum((n = 1)::INT) / sum(n), 6), 'Failed' FROM (SELECT count(*) AS n FROM part GROUP BY p_name)""")
def unique_business_keys(t: Tables) -> DataFrame:
    parts = [quality.evaluate(frame, key, [IsUnique(key)]) for frame, key in ((t.customer, "c_name"), (t.supplier, "s_name"), (t.part, "p_name"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select(F.col("entity").alias("business_key"), F.col("total").alias("row_count"), "metric", "outcome")


@query(sql=f"""WITH {ENRICHED} SELECT count(*) AS row_count, count(DISTINCT claim_id) AS unique_keys, count(*) FILTER (claim_amount < 0) AS negative_amounts,
  count(*) FILTER (policy_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS deleted_visible FROM enriched""")
def post_publish_checks(t: Tables) -> DataFrame:
    from perilake.operators.audit import post_publish_checks as checks

    gold = enriched_claims(t)
    deleted = joins.semi_by_manifest(claim_lines(t), t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("policy_id")), ["policy_id"])
    return checks(gold, "claim_id", "claim_amount", deleted.select("claim_id").distinct())


@query(sql=f"""WITH {ENRICHED}, j AS (SELECT claim_id, broker_id, list_filter([
  CASE WHEN NOT annual_premium_amount >= 5000 THEN 'premium_amount must be at least 5000' END,
  CASE WHEN approved_amount > claim_amount THEN 'approved_amount cannot exceed claim_amount' END,
  CASE WHEN NOT incident_date < CAST(submitted_at AS DATE) THEN 'start_date must be before end_date' END], lambda x: x IS NOT NULL) AS f FROM enriched)
SELECT broker_id, failed AS failed_rule, count(*) AS row_count FROM (SELECT broker_id, unnest(f) AS failed FROM j) GROUP BY 1, 2""")
def oltp_checks(t: Tables) -> DataFrame:
    rules = [
        Rule("premium_amount must be at least 5000", F.col("annual_premium_amount") >= 5000),
        Rule("approved_amount cannot exceed claim_amount", F.col("approved_amount").isNull() | (F.col("approved_amount") <= F.col("claim_amount"))),
        Rule("start_date must be before end_date", F.col("incident_date") < F.to_date("submitted_at")),
    ]
    broken = contracts.rule_violations(enriched_claims(t), rules, ["broker_id"])
    return broken.groupBy("broker_id", "failed_rule").agg(F.count(F.lit(1)).alias("row_count"))


# --- governance -------------------------------------------------------------------------------


@query(sql=f"""WITH {ENRICHED} SELECT claim_id, policy_id, broker_name, claim_status, CAST(claim_amount AS DOUBLE) AS claim_amount FROM enriched""")
def governed_view(t: Tables) -> DataFrame:
    """The analyst's view of the enriched fact: customer_id and free text are not in it."""
    gold = enriched_claims(t).withColumnRenamed("product_name", "description").select(
        "claim_id", "policy_id", "customer_id", "broker_name", "claim_status", "claim_amount", "description")
    return governance.governed_view(gold, "Analyst", "fact_claim_enriched").withColumns(as_double("claim_amount"))


@query(sql=f"""WITH {ENRICHED} SELECT * FROM (
 SELECT 'customer_id' AS column_name, 'MEDIUM' AS sensitivity, true AS personal, count(customer_id) AS exposed_values FROM enriched
 UNION ALL SELECT 'claim_id', 'MEDIUM', true, count(claim_id) FROM enriched UNION ALL SELECT 'policy_id', 'MEDIUM', true, count(policy_id) FROM enriched
 UNION ALL SELECT 'approved_amount', 'MEDIUM', false, count(approved_amount) FROM enriched UNION ALL SELECT 'description', 'HIGH', true, count(product_name) FROM enriched
 UNION ALL SELECT 'broker_name', 'LOW', false, count(broker_name) FROM enriched)""")
def pii_columns(t: Tables) -> DataFrame:
    gold = enriched_claims(t).withColumnRenamed("product_name", "description").select(
        "claim_id", "policy_id", "customer_id", "broker_name", "approved_amount", "description")
    return governance.pii_columns(gold)


@query(sql="""SELECT c_custkey AS customer_id, c_nationkey, c_mktsegment FROM customer""")
def dim_customer(t: Tables) -> DataFrame:
    """Customer dimension without direct personal data."""
    named = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("last_name"), "c_nationkey", "c_mktsegment")
    return governance.without_personal_data(named)


@query(sql="""SELECT o_orderkey AS policy_id, o_custkey AS customer_id, o_orderstatus AS policy_status, strftime(o_orderdate, '%Y-%m-%d') AS start_date, o_totalprice AS premium_amount FROM orders""")
def dim_policy(t: Tables) -> DataFrame:
    """Policy dimension without the policy number."""
    named = t.orders.select(
        F.col("o_orderkey").alias("policy_id"), F.concat(F.lit("POL-"), "o_orderkey").alias("policy_number"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("policy_status"), day("o_orderdate").alias("start_date"), F.col("o_totalprice").alias("premium_amount"))
    return governance.without_personal_data(named)


# --- documented marts -------------------------------------------------------------------------


@query(sql=f"""WITH {ENRICHED} SELECT product_type, broker_region_code, count(claim_id) AS claim_count, CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount,
  round(avg(CAST(claim_amount AS DOUBLE)), 4) AS average_claim_amount, CAST(max(claim_amount) AS DOUBLE) AS largest_claim_amount FROM enriched GROUP BY 1, 2""")
def frequency_severity(t: Tables) -> DataFrame:
    rows = marts.frequency_and_severity(enriched_claims(t), ["product_type", "broker_region_code"], amount="claim_amount", claim="claim_id")
    return rows.withColumns({"average_claim_amount": F.round("average_claim_amount", 4), **as_double("total_claim_amount", "largest_claim_amount")})


@query(sql="""SELECT c_mktsegment, count(*) AS payment_count, count(*) FILTER (o_orderstatus = 'F') AS failed_count,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS failed_amount
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def failed_payments(t: Tables) -> DataFrame:
    paid = joins.star_join(t.orders, [joins.Dimension(t.customer, "c_custkey", "o_custkey", how="inner", columns={"c_mktsegment": "c_mktsegment"})])
    rows = paid.select("c_mktsegment", F.col("o_totalprice").cast("decimal(18,2)").alias("payment_amount"),
                       F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCEEDED").alias("payment_status"))
    return marts.failed_payments(rows, ["c_mktsegment"]).withColumns(as_double("failed_amount"))


@query(sql=f"""WITH {CLAIM_LINES} SELECT o_orderkey AS payment_id, o_custkey AS customer_id, o_orderstatus AS payment_status, CAST(o_totalprice AS DOUBLE) AS payment_amount,
 strftime(o_orderdate, '%Y-%m-%d') AS payment_date FROM orders WHERE o_totalprice >= 0 AND o_custkey IN (SELECT c_custkey FROM customer)
 AND o_orderkey IN (SELECT policy_id FROM claims)""")
def fact_payment(t: Tables) -> DataFrame:
    """Payment grain: non-negative amounts with complete foreign keys, newest version only."""
    newest = latest_per_key(t.orders, ["o_orderkey"], ["o_orderdate", "o_totalprice"])
    rows = newest.filter(F.col("o_totalprice") >= 0).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rows = rows.join(claim_lines(t), F.col("o_orderkey") == F.col("policy_id"), "left_semi")
    return rows.select(F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("payment_status"),
                       F.col("o_totalprice").alias("payment_amount"), day("o_orderdate").alias("payment_date"))


@query(sql=f"""WITH {ENRICHED}, held AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1999-12-31'),
p AS (SELECT o_custkey AS customer_id, count(*) AS policy_count, count(*) FILTER (o_orderstatus = 'O') AS active_policy_count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_premium FROM held GROUP BY 1),
c AS (SELECT customer_id, count(*) AS claim_count, CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount FROM enriched WHERE submitted_at <= TIMESTAMP '1999-12-31' GROUP BY 1),
y AS (SELECT o_custkey AS customer_id, count(*) FILTER (o_orderpriority = '1-URGENT') AS failed_payment_count, count(*) AS payment_count FROM held GROUP BY 1)
SELECT c_custkey AS customer_id, c_mktsegment AS customer_status, coalesce(policy_count, 0) AS policy_count, coalesce(active_policy_count, 0) AS active_policy_count, total_premium,
 coalesce(claim_count, 0) AS claim_count, total_claim_amount, coalesce(failed_payment_count, 0) AS failed_payment_count, coalesce(payment_count, 0) AS payment_count,
 date_diff('day', DATE '1995-01-01', DATE '1999-12-31') AS tenure_days, '1999-12-31' AS as_of_date
FROM customer LEFT JOIN p ON c_custkey = p.customer_id LEFT JOIN c ON c_custkey = c.customer_id LEFT JOIN y ON c_custkey = y.customer_id""")
def customer_360(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("customer_status"),
                                  F.lit("1995-01-01").cast("timestamp").alias("created_at"))
    policies = t.orders.select(F.col("o_orderkey").alias("policy_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
                               F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("EXPIRED").alias("policy_status"),
                               F.col("o_totalprice").cast("decimal(18,2)").alias("premium_amount"))
    payments = t.orders.select(F.col("o_orderkey").alias("policy_id"), F.col("o_orderdate").cast("timestamp").alias("payment_timestamp"),
                               F.when(F.col("o_orderpriority") == "1-URGENT", "FAILED").otherwise("SUCCEEDED").alias("payment_status"))
    claims = enriched_claims(t).withColumn("submitted_at", F.col("submitted_at").cast("timestamp"))
    rows = marts.customer_360(customers, policies, claims, payments, F.lit("1999-12-31").cast("timestamp"))
    return rows.withColumns({"as_of_date": day("as_of_date"), "tenure_days": F.col("tenure_days").cast("long"), **as_double("total_premium", "total_claim_amount")})


@query(sql=f"""WITH {ENRICHED} SELECT 'policy_start' AS earlier, 'incident_date' AS later, count(*) FILTER (incident_date < DATE '1995-06-01') AS violations FROM enriched
UNION ALL SELECT 'incident_date', 'submitted_on', count(*) FILTER (CAST(submitted_at AS DATE) < incident_date) FROM enriched""")
def date_order(t: Tables) -> DataFrame:
    rows = enriched_claims(t).select(F.lit("1995-06-01").cast("date").alias("policy_start"), "incident_date", F.to_date("submitted_at").alias("submitted_on"))
    return marts.date_order_violations(rows, ["policy_start", "incident_date", "submitted_on"])


@query(sql="""SELECT * FROM (SELECT 'orders' AS entity, 'o_orderstatus is not an allowed value' AS failed_rule, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS row_count FROM orders
UNION ALL SELECT 'lineitem', 'commission_rate must be between 0 and 0.07', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.07) FROM lineitem) WHERE row_count > 0""")
def vocabulary_checks(t: Tables) -> DataFrame:
    suites = [("orders", t.orders, [Rule("o_orderstatus is not an allowed value", F.col("o_orderstatus").isin("O", "F"))]),
              ("lineitem", t.lineitem, [Rule("commission_rate must be between 0 and 0.07", F.col("l_discount").between(0, 0.07))])]
    parts = [contracts.rule_violations(frame, rules).withColumn("entity", F.lit(name)) for name, frame, rules in suites]
    return parts[0].unionByName(parts[1]).groupBy("entity", "failed_rule").agg(F.count(F.lit(1)).alias("row_count"))


@query(sql="""SELECT key, start_us, end_us FROM (SELECT *, max(end_us) OVER (PARTITION BY key ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM (
  SELECT o_custkey AS key, epoch_us(o_orderdate) AS start_us, epoch_us(o_orderdate) + CAST(round(o_totalprice * 100) AS BIGINT) * 300000 AS end_us FROM orders)) WHERE start_us < until""")
def validity_overlap(t: Tables) -> DataFrame:
    """Policy periods of a customer that start inside an earlier one (length from the price)."""
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    periods = t.orders.select(F.col("o_custkey").alias("key"), start.alias("start_us"), (start + cents("o_totalprice") * 300000).alias("end_us"))
    timed = periods.withColumns({"from": F.timestamp_micros("start_us"), "to": F.timestamp_micros("end_us")})
    return history.overlapping_validity(timed, key="key", start="from", end="to").select("key", "start_us", "end_us")
