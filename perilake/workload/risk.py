"""Ordering, splits, metrics, features, history, scoring and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.functions.temporal import iso_event_time, reporting_delay_days, vehicle_age
from perilake.operators import features, history, joins, marts, metrics, ordering, scoring
from perilake.operators.features import one_hot
from perilake.session import durable
from perilake.workload.base import CLAIM_LINES, ENRICHED, SCORED, Tables, cents, claim_lines, day, enriched_claims, instant, query, scored_documents

# --- order and split --------------------------------------------------------------------------


@query(sql="""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders""")
def ordered_index(t: Tables) -> DataFrame:
    return ordering.ordered_index(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_id")


@query(sql="""SELECT strftime(o_orderdate, '%Y-%m-%d') AS submitted_on, o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey""")
def ordered_export(t: Tables) -> DataFrame:
    rows = t.orders.orderBy("o_orderdate", "o_orderkey")
    return rows.select(day("o_orderdate").alias("submitted_on"), "o_orderkey", "o_custkey", "o_totalprice")


@query(sql="""SELECT a.o_orderkey AS claim, b.o_orderkey AS prediction FROM
 (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders) a JOIN
 (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) b USING (r)""")
def positional_join(t: Tables) -> DataFrame:
    by_date = ordering.ordered_index(t.orders.select("o_orderdate", F.col("o_orderkey").alias("claim")), ["o_orderdate", "claim"])
    by_price = ordering.ordered_index(t.orders.select("o_totalprice", F.col("o_orderkey").alias("prediction")), ["o_totalprice", "prediction"])
    return ordering.positional_join(by_date.select("row_id", "claim"), by_price.select("row_id", "prediction")).drop("row_id")


SPLIT_SQL = """ranked AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders),
labelled AS (SELECT *, CASE WHEN rn <= n * 6 // 10 THEN 'train' WHEN rn <= n * 8 // 10 THEN 'validation' ELSE 'test' END AS split,
 (o_totalprice > 300000)::INT AS high_risk FROM ranked)"""


def _split_orders(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("high_risk", (F.col("o_totalprice") > 300000).cast("int"))
    return ordering.chronological_split(rows, "o_orderdate", "o_orderkey")


@query(sql=f"WITH {SPLIT_SQL} SELECT o_orderkey, split FROM labelled")
def chrono_split(t: Tables) -> DataFrame:
    return _split_orders(t).select("o_orderkey", "split")


@query(sql=f"""WITH {SPLIT_SQL} SELECT split, count(*) AS row_count, count(*) FILTER (high_risk = 1) AS positive_count, round(avg(CAST(high_risk AS DOUBLE)), 6) AS positive_rate,
 strftime(min(o_orderdate), '%Y-%m-%d') AS min_prediction_timestamp, strftime(max(o_orderdate), '%Y-%m-%d') AS max_prediction_timestamp FROM labelled GROUP BY 1 ORDER BY 5""")
def split_profile(t: Tables) -> DataFrame:
    rows = marts.split_profile(_split_orders(t), label="high_risk", time="o_orderdate").orderBy("min_prediction_timestamp")
    return rows.withColumns({"positive_rate": F.round("positive_rate", 6), "min_prediction_timestamp": day("min_prediction_timestamp"),
                             "max_prediction_timestamp": day("max_prediction_timestamp")})


@query(sql=f"""WITH {SPLIT_SQL} SELECT split_order, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
 SELECT o_orderkey, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS split_order FROM labelled) GROUP BY 1""")
def concat_splits(t: Tables) -> DataFrame:
    """Splits put back together in train, validation, test order."""
    rows = _split_orders(t)
    parts = [rows.filter(F.col("split") == name).withColumn("split_order", F.lit(i)) for i, (name, _) in enumerate(ordering.SPLITS)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("split_order").agg(F.count(F.lit(1)).alias("row_count"), F.sum("o_orderkey").alias("keys"))


@query(sql=f"""WITH {SPLIT_SQL} SELECT o_custkey FROM labelled GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def disjoint_splits(t: Tables) -> DataFrame:
    """Customers seen in more than one split."""
    return joins.keys_in_several(_split_orders(t), "o_custkey", "split")


# --- metrics ----------------------------------------------------------------------------------


@query(sql=f"""WITH {SCORED}, c AS (SELECT lang, count(*) AS row_count, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp,
 count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality = 0 AND score < 0.5) AS tn,
 -avg(CASE WHEN quality = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, score))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END) AS ll FROM scored GROUP BY 1)
SELECT lang, row_count, tp, fp, fn, tn, round(ll, 6) AS log_loss, round((tp + tn) / row_count, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def binary_metrics(t: Tables) -> DataFrame:
    rows = metrics.threshold_metrics(scored_documents(t), "quality", "score", by=["lang"])
    return rows.drop("positives").withColumns({c: F.round(c, 6) for c in ("log_loss", "accuracy", "precision", "recall", "f1")})


AUC_SQL = """SELECT count(*) FILTER ({y} = 1) AS positives, count(*) FILTER ({y} = 0) AS negatives,
 round((sum(CASE WHEN {y} = 1 THEN r END) - count(*) FILTER ({y} = 1) * (count(*) FILTER ({y} = 1) + 1) / 2)
  / (count(*) FILTER ({y} = 1) * count(*) FILTER ({y} = 0)), 9) AS auc
 FROM (SELECT *, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2 AS r FROM {f})"""


@query(sql="WITH h AS (SELECT *, (o_totalprice > 300000)::INT AS y, o_custkey AS s FROM orders) " + AUC_SQL.format(y="y", s="s", f="h"))
def auc(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_totalprice") > 300000).cast("int").alias("y"), F.col("o_custkey").alias("s"))
    return metrics.auc(rows, "y", "s").withColumn("auc", F.round("auc", 9))


@query(sql=f"""WITH {SCORED}, long AS (SELECT quality, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS v FROM scored UNION ALL SELECT quality, 'toxic', toxic FROM scored UNION ALL SELECT quality, 'doc_id', doc_id FROM scored),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS r FROM long)
SELECT feature, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives,
 round((sum(CASE WHEN quality = 1 THEN r END) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 9) AS auc
FROM r GROUP BY 1""")
def univariate_auc(t: Tables) -> DataFrame:
    return metrics.univariate_auc(scored_documents(t), "quality", ["n_chars", "toxic", "doc_id"]).withColumn("auc", F.round("auc", 9))


@query(sql=f"""WITH {SCORED}, a AS (SELECT avg(CASE WHEN p.n_chars > n.n_chars THEN 1.0 WHEN p.n_chars = n.n_chars THEN 0.5 ELSE 0.0 END) AS x,
 avg(CASE WHEN p.doc_id > n.doc_id THEN 1.0 WHEN p.doc_id = n.doc_id THEN 0.5 ELSE 0.0 END) AS z FROM scored p JOIN scored n ON p.quality = 1 AND n.quality = 0)
SELECT round((SELECT avg(CAST(quality AS DOUBLE)) FROM scored), 6) AS positive_rate, round(greatest(x, z), 6) AS best_single_auc,
 (SELECT avg(quality) FROM scored) BETWEEN 0.2 AND 0.35 AS balance_ok, greatest(x, z) >= 0.65 AND greatest(x, z) < 0.9 AS signal_ok FROM a""")
def learnability(t: Tables) -> DataFrame:
    rows = metrics.learnability(scored_documents(t), "quality", ["n_chars", "doc_id"])
    return rows.withColumns({c: F.round(c, 6) for c in ("positive_rate", "best_single_auc")})


@query(sql=f"""WITH {SCORED}, m AS (SELECT lang, count(*) AS n, sum(quality) AS good, sum(toxic) AS bad FROM scored GROUP BY 1)
SELECT lang, 'quality' AS metric, CAST(good AS DOUBLE) AS value, true AS numeric FROM m UNION ALL SELECT lang, 'toxic', CAST(bad AS DOUBLE), true FROM m
UNION ALL SELECT lang, 'note', NULL, false FROM m UNION ALL SELECT lang, 'evaluation_row_count', CAST(n AS DOUBLE), true FROM m""")
def metric_rows(t: Tables) -> DataFrame:
    """Evaluation reports, one JSON document per language, flattened."""
    per_lang = scored_documents(t).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"))
    report = F.to_json(F.struct(
        F.struct(F.struct(F.col("good").alias("value")).alias("quality"), F.col("bad").alias("toxic"), F.lit("n/a").alias("note")).alias("binary_classification_metrics"),
        F.col("n").alias("row_count")))
    return metrics.metric_rows(per_lang.select("lang", report.alias("document")), "document")


# --- features ---------------------------------------------------------------------------------

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "OTHER")
STATUSES = ("O", "F", "OTHER")


@query(sql="""SELECT o_orderkey, o_totalprice, CAST(c_acctbal AS DOUBLE) AS c_acctbal,
 (c_mktsegment = 'AUTOMOBILE')::DOUBLE AS segment__AUTOMOBILE, (c_mktsegment = 'BUILDING')::DOUBLE AS segment__BUILDING, (c_mktsegment = 'FURNITURE')::DOUBLE AS segment__FURNITURE,
 (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE'))::DOUBLE AS segment__OTHER, (o_orderstatus = 'O')::DOUBLE AS status__O, (o_orderstatus = 'F')::DOUBLE AS status__F,
 (o_orderstatus NOT IN ('O', 'F'))::DOUBLE AS status__OTHER FROM orders JOIN customer ON o_custkey = c_custkey""")
def feature_vector(t: Tables) -> DataFrame:
    rows = joins.star_join(t.orders, [joins.Dimension(t.customer, "c_custkey", "o_custkey", how="inner", columns={"segment": "c_mktsegment", "c_acctbal": "c_acctbal"})])
    flags = [h.alias(f"segment__{v}") for h, v in zip(one_hot("segment", SEGMENTS), SEGMENTS)]
    flags += [h.alias(f"status__{v}") for h, v in zip(one_hot("o_orderstatus", STATUSES), STATUSES)]
    return rows.select("o_orderkey", features.number(rows, "o_totalprice").alias("o_totalprice"), features.number(rows, "c_acctbal").alias("c_acctbal"), *flags)


def risk_rows(t: Tables) -> DataFrame:
    """Claims in the shape of the feature table: every contract column, from the given tables."""
    choose = lambda condition, yes, no: F.when(condition, yes).otherwise(no)
    return enriched_claims(t).select(
        "claim_id", "policy_id", "customer_id", "broker_id", "incident_date", "submitted_at", "claim_amount",
        (F.col("claim_category") == "R").cast("int").alias("high_risk_claim"),
        F.col("product_size").alias("years_experience"),
        (F.col("branch_id") / 25).alias("catastrophe_risk_score"), F.col("discount").alias("region_theft_risk_score"),
        (F.col("product_size") / 50).alias("weather_risk_score"), F.col("tax").alias("accident_risk_score"),
        F.col("discount").alias("deductible_aud"), F.col("annual_premium_amount").alias("coverage_limit_aud"),
        (F.col("currency_code") == "F").cast("int").alias("optional_flag"), F.col("annual_premium_amount").alias("market_value_aud"),
        F.ceil(F.col("product_size") / 10).cast("int").alias("safety_rating"), F.col("product_size").alias("vehicle_age"),
        choose(F.col("product_type") == "PROMO", "auto", choose(F.col("product_type") == "SMALL", "HOME", F.col("product_type"))).alias("product_type"),
        choose(F.col("claim_status") == "O", "LOW", "HIGH").alias("product_risk_tier"),
        choose(F.col("broker_balance") >= 5000, "gold", "SILVER").alias("broker_tier"),
        choose(F.col("claim_category") == "A", "FIRE", "THEFT").alias("claim_category"),
        choose(F.col("overall_risk_band") == "1-URGENT", "HIGH", "LOW").alias("overall_risk_band"),
        choose(F.col("coverage_tier") == "BUILDING", "BASIC", "PLUS").alias("coverage_tier"),
        choose(F.col("discount") > 0.05, "MEDIUM", "LOW").alias("repair_cost_band"), choose(F.col("tax") > 0.04, "MEDIUM", "LOW").alias("theft_risk_band"),
        F.coalesce("vehicle_risk_category", F.lit("STANDARD")).alias("vehicle_risk_category"),
    )


RISK = ENRICHED + """, risk AS (SELECT *, (claim_category = 'R')::INT AS y, date_diff('day', incident_date, CAST(submitted_at AS DATE)) AS delay FROM enriched)"""


@query(sql=f"""WITH {RISK} SELECT claim_id, y AS high_risk_claim, CAST(claim_amount AS DOUBLE) AS claim_amount, CAST(delay AS DOUBLE) AS reporting_delay_days,
 CAST(product_size AS DOUBLE) AS years_experience, tax AS accident_risk_score, CAST(product_size AS DOUBLE) AS vehicle_age,
 (product_type = 'PROMO')::DOUBLE AS "product_type__AUTO", (product_type = 'SMALL')::DOUBLE AS "product_type__HOME", (product_type NOT IN ('PROMO', 'SMALL'))::DOUBLE AS "product_type__OTHER",
 (broker_balance >= 5000)::DOUBLE AS "broker_tier__GOLD", (coalesce(vehicle_risk_category, 'STANDARD') = 'STANDARD')::DOUBLE AS "vehicle_risk_category__STANDARD", 54 AS feature_count FROM risk""")
def claim_feature_matrix(t: Tables) -> DataFrame:
    """The 54-feature contract on every claim."""
    vectors = features.vectorize(risk_rows(t))
    return vectors.select(
        "claim_id", "high_risk_claim", "claim_amount", "reporting_delay_days", "years_experience", "accident_risk_score",
        "vehicle_age", "product_type__AUTO", "product_type__HOME", "product_type__OTHER", "broker_tier__GOLD", "vehicle_risk_category__STANDARD",
        F.lit(len(vectors.columns) - 2).alias("feature_count"))


@query(sql=f"""WITH {RISK}, e AS (SELECT list_filter([CASE WHEN delay < 0 THEN 'reporting_delay_days is null, invalid, or outside its allowed range' END], lambda x: x IS NOT NULL) AS f FROM risk)
SELECT issue, count(*) AS rows FROM (SELECT unnest(f) AS issue FROM e) GROUP BY 1""")
def feature_dataset_dq(t: Tables) -> DataFrame:
    return features.issue_counts(risk_rows(t))


@query(sql=f"""WITH {RISK} SELECT claim_id, CAST(delay AS DOUBLE) AS reporting_delay_days, CAST(year(submitted_at) - year(incident_date) AS BIGINT) AS vehicle_age FROM risk""")
def claim_timing(t: Tables) -> DataFrame:
    rows = enriched_claims(t)
    return rows.select("claim_id", reporting_delay_days(F.col("incident_date").cast("string"), F.col("submitted_at").cast("string")).alias("reporting_delay_days"),
                       vehicle_age("submitted_at", F.year("incident_date")).cast("long").alias("vehicle_age"))


@query(sql=f"""WITH {ENRICHED} SELECT claim_id, CAST(claim_amount AS DOUBLE) AS claim_amount, CAST(coalesce(approved_amount, 0) AS DOUBLE) AS approved_amount,
 CAST(date_diff('day', incident_date, CAST(submitted_at AS DATE)) AS DOUBLE) AS days_to_submit, (claim_status = 'F')::DOUBLE AS is_approved FROM enriched""")
def legacy_claim_features(t: Tables) -> DataFrame:
    rows = enriched_claims(t).withColumn("claim_status", F.when(F.col("claim_status") == "F", "approved").otherwise("open"))
    return features.legacy_claim_features(rows)


@query(sql="""SELECT event_id, CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
 ELSE CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END END AS event_time FROM events""")
def iso_event_times(t: Tables) -> DataFrame:
    """Three ways times are written: date only, seconds with `` UTC``, and microseconds."""
    text = F.when(F.col("event_type") == "view", day("ts")).when(F.col("event_type") == "click", F.concat(instant("ts"), F.lit(" UTC"))).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return t.events.select("event_id", iso_event_time(text).alias("event_time"))


@query(sql="""WITH h AS (SELECT sha256(concat_ws('||', l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), CAST(l_quantity AS BIGINT))) AS h FROM lineitem),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS s0, sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) AS s1,
 sum(CAST('0x' || substr(h, 33, 15) AS BIGINT)) AS s2, sum(CAST('0x' || substr(h, 49, 15) AS BIGINT)) AS s3 FROM h)
SELECT n AS row_count, 'feature-set-' || substr(sha256(concat_ws('|', n, s0, s1, s2, s3)), 1, 16) AS dataset_version FROM s""")
def dataset_version(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", day("l_shipdate").alias("shipdate"), F.col("l_quantity").cast("long").alias("quantity"))
    return features.dataset_version(rows, rows.columns, "feature-set")


READBACK_SQL = """WITH stored AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS event_time, event_id, ts, value, event_type = 'error' AS is_deleted FROM events),
wanted AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS event_time FROM events WHERE event_type = 'purchase'),
latest AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_time ORDER BY ts DESC, event_id DESC) AS rn FROM stored SEMI JOIN wanted USING (user_id, event_time) WHERE NOT is_deleted)"""


def _stored(t: Tables) -> DataFrame:
    return t.events.select("user_id", day("ts").alias("event_time"), F.col("ts").alias("api_invocation_time"), F.col("event_id").alias("write_time"),
                           "value", (F.col("event_type") == "error").alias("is_deleted"))


def _wanted(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type") == "purchase").select("user_id", day("ts").alias("event_time")).distinct()


@query(sql=READBACK_SQL + " SELECT user_id, event_time, event_id, value FROM latest WHERE rn = 1")
def feature_readback(t: Tables) -> DataFrame:
    keys = ("user_id", "event_time")
    visible = joins.semi_by_manifest(_stored(t), _wanted(t), keys)
    return features.latest_feature_record(visible, keys).select("user_id", "event_time", F.col("write_time").alias("event_id"), "value")


@query(sql=READBACK_SQL + """ SELECT (SELECT count(*) FROM wanted) AS expected_keys, (SELECT count(*) FROM latest WHERE rn = 1) AS visible_keys,
 (SELECT count(*) FROM wanted) - (SELECT count(*) FROM latest WHERE rn = 1) AS missing_keys, 0::BIGINT AS unexpected_keys""")
def readback_complete(t: Tables) -> DataFrame:
    keys = ("user_id", "event_time")
    visible = features.latest_feature_record(joins.semi_by_manifest(_stored(t), _wanted(t), keys), keys)
    return joins.key_set_difference(_wanted(t), visible, keys).drop("complete")


@query(sql="""SELECT doc_id, quality, CASE WHEN n_chars IS NULL THEN 'missing' WHEN (n_chars > 500)::INT = quality THEN 'ok' ELSE 'label_mismatch' END AS match, lang
FROM labels LEFT JOIN (SELECT * REPLACE (CASE WHEN n_chars >= 20000 THEN -1 - doc_id ELSE doc_id END AS doc_id) FROM documents) USING (doc_id)""")
def match_manifest(t: Tables) -> DataFrame:
    """Records of every document; those of very long ones are stored under another key, so the manifest misses them."""
    moved = F.when(F.col("n_chars") >= 20000, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id")
    stored = t.documents.select(moved, "lang", (F.col("n_chars") > 500).cast("int").alias("quality"))
    return joins.match_manifest(stored, t.labels.select("doc_id", "quality"), ["doc_id"], "quality")


@query(sql="""SELECT problem, count(*) AS records FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'not in manifest' WHEN (n_chars > 500)::INT <> quality THEN 'matrix/manifest label mismatch'
 WHEN lang = 'en' AND source = 'src1' THEN 'non-finite feature' ELSE 'usable' END AS problem FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def feature_records(t: Tables) -> DataFrame:
    odd = (F.col("lang") == "en") & (F.col("source") == "src1")
    vectors = t.documents.select(F.col("doc_id").alias("claim_id"), (F.col("n_chars") > 500).cast("int").alias("high_risk_claim"),
                                 F.when(odd, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double")).alias("size"))
    manifest = t.labels.select(F.col("doc_id").alias("claim_id"), F.lit("2026-01-01").alias("event_time"), F.lit("2026-01-01").alias("as_of_date"), F.col("quality").alias("high_risk_claim"))
    records = features.to_feature_records(vectors, manifest, ["size"])
    return records.groupBy(F.coalesce("problem", F.lit("usable")).alias("problem")).agg(F.count(F.lit(1)).alias("records"))


@query(sql=f"""WITH {SPLIT_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, strftime(o_orderdate, '%Y-%m-%d') AS as_of_date, 'v1' AS feature_version, 'version-1' AS dataset_version,
 split AS source_split, high_risk AS high_risk_claim FROM labelled""")
def sidecar_manifest(t: Tables) -> DataFrame:
    rows = _split_orders(t).select(F.col("o_orderkey").cast("string").alias("claim_id"), F.col("o_orderdate").alias("submitted_at"), F.col("high_risk").alias("high_risk_claim"), "split")
    return features.sidecar_manifest(rows, "version-1").drop("event_time")


@query(sql="""SELECT doc_id, quality, 'legacy-manifest-sha256:' || sha256('labels') AS dataset_version FROM labels""")
def manifest_lineage(t: Tables) -> DataFrame:
    return features.manifest_with_lineage(t.labels.select("doc_id", "quality"), F.sha2(F.lit("labels"), 256))


# --- history ----------------------------------------------------------------------------------


@query(sql="""SELECT o_orderkey, count(*) OVER w30 AS claims_30d, count(*) OVER w365 AS claims_365d, CAST(coalesce(sum(c) OVER w30, 0) AS BIGINT) AS cents_30d, CAST(coalesce(sum(c) OVER w365, 0) AS BIGINT) AS cents_365d
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, epoch_us(o_orderdate) AS t FROM orders)
WINDOW w30 AS (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING), w365 AS (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN 31536000000000 PRECEDING AND 1 PRECEDING)""")
def prior_window_features(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.lit(1).alias("one"), cents("o_totalprice").alias("c"))
    prior = history.prior_features(rows, key="o_custkey", time="o_orderdate", measures={"claims": "one", "cents": "c"}, days=[30, 365])
    return prior.select("o_orderkey", "claims_30d", "claims_365d", "cents_30d", "cents_365d")


@query(sql="""SELECT event_id, count(*) FILTER (event_type = 'error') OVER w AS failed_90d, count(*) OVER w AS events_90d, date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)) AS tenure_days
FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 7776000000000 PRECEDING AND 1 PRECEDING)""")
def customer_claim_features(t: Tables) -> DataFrame:
    """Payment failures and activity of the last 90 days, and tenure, before each event."""
    rows = t.events.select("event_id", "user_id", "ts", F.lit(1).alias("one"), (F.col("event_type") == "error").cast("int").alias("failed"))
    prior = history.prior_features(rows, key="user_id", time="ts", measures={"failed": "failed", "events": "one"}, days=[90])
    since = t.events.groupBy("user_id").agg(F.min("ts").alias("since"))
    return prior.join(since, "user_id").select("event_id", "failed_90d", "events_90d", history.tenure_days("ts", "since").cast("long").alias("tenure_days"))


@query(sql="""SELECT l_orderkey, l_linenumber, l_partkey, us, count(*) OVER w AS prior_claims_365d, CAST(coalesce(sum(c) OVER w, 0) AS BIGINT) AS prior_cents_365d
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, epoch_us(l_shipdate) AS us FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY us RANGE BETWEEN 31536000000000 PRECEDING AND 1 PRECEDING)""")
def policy_risk_features(t: Tables) -> DataFrame:
    """Claims of a policy in the year before each of its claims."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.lit(1).alias("one"), cents("l_extendedprice").alias("c"))
    prior = history.prior_features(rows, key="l_orderkey", time="l_shipdate", measures={"prior_claims": "one", "prior_cents": "c"}, days=[365])
    return prior.select("l_orderkey", "l_linenumber", "l_partkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), "prior_claims_365d", "prior_cents_365d")


@query(sql="""SELECT p.event_id, p.user_id, CASE WHEN epoch_us(p.ts) < max(epoch_us(v.ts)) + 86400000000 * 5 THEN max_by(v.event_id, (epoch_us(v.ts), v.event_id)) END AS version_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY p.event_id, p.user_id, p.ts""")
def asof_reference(t: Tables) -> DataFrame:
    """Purchases with the newest view at or before them, unless it expired after five days."""
    views = t.events.filter(F.col("event_type") == "view").select("user_id", "ts", "event_id", F.expr("ts + INTERVAL 5 DAYS").alias("ends"))
    bought = t.events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    return joins.asof_join(bought, views, key="user_id", time="ts", version_time="ts", take={"version_id": "event_id"}, tie="event_id",
                           effective_to="ends").select("event_id", "user_id", "version_id")


@query(sql="""SELECT count(*) AS compared_rows, count(*) FILTER (o_orderdate > l_shipdate) AS future_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def future_reference_check(t: Tables) -> DataFrame:
    facts = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("t"))
    return joins.future_reference_count(facts, t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("v")), key="k", time="t", version_time="v")


HISTORY_SQL = """moves AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
hist AS (SELECT user_id, prev, event_type AS status, ts, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM moves WHERE prev IS DISTINCT FROM event_type)"""


@query(sql=f"""WITH {HISTORY_SQL} SELECT user_id, coalesce(prev, '') AS previous_status, status, epoch_us(ts) AS from_us, coalesce(epoch_us(valid_to), -1) AS to_us, event_id AS source_order FROM hist""")
def status_history(t: Tables) -> DataFrame:
    rows = history.status_history(t.events.withColumn("ts", F.col("ts").cast("timestamp")), key="user_id", status="event_type", time="ts", tie="event_id")
    return rows.select("user_id", F.coalesce("previous_status", F.lit("")).alias("previous_status"), "status", F.unix_micros("valid_from").alias("from_us"),
                       F.coalesce(F.unix_micros("valid_to"), F.lit(-1)).alias("to_us"), "source_order")


@query(sql=f"""WITH {HISTORY_SQL} SELECT status, count(DISTINCT user_id) AS entities, count(*) AS visits, round(avg((epoch_us(valid_to) - epoch_us(ts)) / 86400000000.0::DOUBLE), 6) AS average_days FROM hist GROUP BY 1""")
def status_funnel(t: Tables) -> DataFrame:
    rows = history.status_history(t.events.withColumn("ts", F.col("ts").cast("timestamp")), key="user_id", status="event_type", time="ts", tie="event_id")
    return marts.status_funnel(rows, entity="user_id").withColumn("average_days", F.round("average_days", 6))


# --- scoring and publication ------------------------------------------------------------------


@query(sql=f"""WITH {SCORED}, p AS (SELECT *, CAST(round(score * 100000) AS BIGINT) AS u FROM scored) SELECT doc_id, u / 100000.0::DOUBLE AS high_risk_probability,
 CASE WHEN u >= 70000 THEN 'HIGH' WHEN u >= 30000 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, '2026-09-01' AS as_of_date, 'model-1' AS model_version, 'run-1' AS model_run_id FROM p""")
def publish_risk(t: Tables) -> DataFrame:
    rows = scored_documents(t).select("doc_id", F.col("score").alias("raw_probability"), F.lit("2026-09-01").alias("as_of_date"))
    published = scoring.claim_risk(rows, model_version="model-1", run_id="run-1")
    return published.select("doc_id", F.col("high_risk_probability").cast("double").alias("high_risk_probability"), "risk_level",
                            day("as_of_date").alias("as_of_date"), "model_version", "model_run_id")


@query(sql="""SELECT event_type, count(*) AS row_count, count(DISTINCT user_id) AS unique_claims, count(*) FILTER (value > 100) AS invalid_probabilities FROM events GROUP BY 1""")
def prediction_validation(t: Tables) -> DataFrame:
    """Per batch of predictions (an event type): rows, distinct keys and values outside [0, 1]."""
    rows = t.events.select("event_type", "user_id", (F.col("value") / 100).alias("p"))
    return scoring.prediction_validation(rows, "user_id", "p", by=["event_type"])


@query(sql="""SELECT count(*) AS row_count, count(DISTINCT doc_id) AS unique_claims, count(*) FILTER (n_chars > 16384) AS invalid_probabilities FROM documents""")
def gold_prediction_check(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", (F.col("n_chars") / 16384).alias("p"))
    return scoring.prediction_validation(rows, "doc_id", "p")


@query(sql="""SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN false WHEN c_acctbal < 0 THEN false ELSE true END AS usable, count(*) AS manifest_rows FROM customer GROUP BY 1""")
def manifest_validity(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("claim_id"), F.when(F.col("c_acctbal") >= 0, "2026-01-01").alias("as_of_date"),
                             F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise("v").alias("dataset_version"))
    return rows.groupBy(scoring.manifest_valid().alias("usable")).agg(F.count(F.lit(1)).alias("manifest_rows"))


@query()
def train_and_score(t: Tables) -> DataFrame:
    """Boosted trees on the chronological splits of the claim features, scored on every claim; with the rounds kept and the verdict of the gate."""
    rows = risk_rows(t).withColumn("row_key", F.concat_ws("|", "claim_id", F.col("submitted_at").cast("string"), F.col("claim_amount").cast("string"), "broker_id"))
    labelled = ordering.chronological_split(rows, "submitted_at", "row_key")
    vectors = durable(features.vectorize(labelled, keep=("row_key", "high_risk_claim", "split")))
    names = features.feature_names()
    model = scoring.train_classifier(vectors, names, "high_risk_claim")
    scored = durable(scoring.score_batch(model, vectors, names).select("row_key", "high_risk_claim", "split", "probability"))
    try:
        scoring.quality_gate(metrics.evaluate_binary(scored.filter(F.col("split") == "test"), "high_risk_claim", "probability"))
        passed = True
    except (metrics.MetricError, scoring.PublishRefused):
        passed = False
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("row_key").alias("unique_claims"), F.round(F.avg("probability"), 4).alias("average_probability"),
        F.count_if(~F.col("probability").between(0, 1)).alias("invalid_probabilities"), F.lit(model.getNumTrees).alias("rounds"), F.lit(passed).alias("gate_passed"))
