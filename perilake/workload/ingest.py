"""Contracts, quarantine, de-duplication, change logs, quality and audit."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.functions.identity import row_hash
from perilake.functions.text import decoded_key, is_run_id
from perilake.operators import audit, changes, contracts, dedup, joins, quality
from perilake.operators.contracts import Rule, TableContract
from perilake.operators.quality import AtLeast, IsComplete, IsUnique
from perilake.plans.contracts import raw_claim_rules, read_raw_claims, typed_claim_rules
from perilake.session import durable, run_folder
from perilake.sources.state import StateTable
from perilake.sources.tables import Lakehouse
from perilake.workload.base import CLAIM_LINES, ENRICHED, USER_CHANGES, Tables, cents, claim_lines, day, enriched_claims, instant, query, user_changes

def _line_rules() -> list[Rule]:
    return [
        Rule("approved_amount is missing", F.col("approved_amount").isNotNull()),
        Rule("claim_amount must be non-negative", F.col("claim_amount") >= 0),
        Rule("claim_category is not an allowed value", F.col("claim_category").isin("A", "N")),
        Rule("incident_date cannot be after submitted_at", F.col("incident_date") <= F.to_date("submitted_at")),
    ]


@query(sql=f"""WITH {ENRICHED}, judged AS (
  SELECT policy_id, line_number, claim_category, list_filter([
    CASE WHEN approved_amount IS NULL THEN 'approved_amount is missing' END,
    CASE WHEN NOT coalesce(claim_amount >= 0, false) THEN 'claim_amount must be non-negative' END,
    CASE WHEN NOT coalesce(claim_category IN ('A', 'N'), false) THEN 'claim_category is not an allowed value' END,
    CASE WHEN NOT coalesce(incident_date <= CAST(submitted_at AS DATE), false) THEN 'incident_date cannot be after submitted_at' END
  ], lambda x: x IS NOT NULL) AS failed FROM enriched)
SELECT '{{"policy_id":' || policy_id || ',"line_number":' || line_number || ',"claim_category":"' || claim_category || '"}}' AS source_record,
       array_to_string(failed, '; ') AS failed_rules, 'claim' AS entity
FROM judged WHERE len(failed) > 0""")
def contract_quarantine(t: Tables) -> DataFrame:
    split = contracts.split_by_rules(
        enriched_claims(t), _line_rules(), run_id="run", source="lineitem", entity="claim",
        record_columns=["policy_id", "line_number", "claim_category"],
    )
    return split.rejected.select("source_record", F.array_join("failed_rules", "; ").alias("failed_rules"), "entity")


@query(sql=f"""WITH {ENRICHED}
SELECT claim_category, coalesce(approved_amount IS NOT NULL AND claim_amount >= 0 AND claim_category IN ('A', 'N')
       AND incident_date <= CAST(submitted_at AS DATE), false)::INT AS valid, count(*) AS claim_count,
       CAST(sum(claim_amount) AS DOUBLE) AS total_claim_amount
FROM enriched GROUP BY 1, 2""")
def claim_validity(t: Tables) -> DataFrame:
    judged = enriched_claims(t).withColumn("valid", contracts.all_hold(_line_rules()).cast("int"))
    return judged.groupBy("claim_category", "valid").agg(
        F.count(F.lit(1)).alias("claim_count"), F.sum("claim_amount").cast("double").alias("total_claim_amount"))


def _text_claims(t: Tables) -> DataFrame:
    """Orders as a landed claim file: everything text, with the faults such files have."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    priority = F.substring("o_orderpriority", 1, 1)
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("claim_id"),
        F.concat(F.lit("  CLM-"), "o_orderkey", F.lit(" ")).alias("claim_number"),
        F.when(F.col("o_custkey") > 0, F.col("o_custkey").cast("string")).otherwise("  ").alias("policy_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "O", " submitted ").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("pending").alias("claim_status"),
        F.when(priority == "4", "unknown").otherwise(day("o_orderdate")).alias("incident_date"),
        F.when(priority == "1", stamp).otherwise(F.concat(stamp, F.lit("Z"))).alias("submitted_at"),
        F.when(priority == "2", "1994-12-31T00:00:00Z").otherwise(F.concat(stamp, F.lit("+00:00"))).alias("updated_at"),
        F.when(priority == "5", F.concat(F.lit("-"), amount)).when(priority == "3", "n/a").otherwise(amount).alias("claim_amount"),
        F.when(F.col("o_orderstatus") == "F", "250000.00").otherwise("").alias("approved_amount"),
        F.when(priority == "3", "AUST").otherwise("aud").alias("currency_code"),
        F.lit("").alias("description"),
    )


@query(sql="""WITH txt AS (
  SELECT o_orderkey, o_orderstatus s, substr(o_orderpriority, 1, 1) p, o_custkey, o_orderdate d,
         CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN -CAST(o_totalprice AS DECIMAL(18,2)) WHEN '3' THEN NULL
              ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders),
errors AS (
  SELECT 'policy_id is required' AS failed_rule FROM txt WHERE o_custkey = 0
  UNION ALL SELECT 'claim_status is not an allowed value' FROM txt WHERE s NOT IN ('O', 'F')
  UNION ALL SELECT 'incident_date is not an ISO date' FROM txt WHERE p = '4'
  UNION ALL SELECT 'submitted_at is not an ISO-8601 timestamp with timezone' FROM txt WHERE p = '1'
  UNION ALL SELECT 'updated_at cannot be before submitted_at' FROM txt WHERE p = '2' AND d > TIMESTAMP '1994-12-31'
  UNION ALL SELECT 'claim_amount must be non-negative' FROM txt WHERE amount < 0
  UNION ALL SELECT 'claim_amount is not a decimal amount' FROM txt WHERE p = '3'
  UNION ALL SELECT 'approved_amount cannot exceed claim_amount' FROM txt WHERE s = 'F' AND amount < 250000
  UNION ALL SELECT 'currency_code must be a 3-character ISO code' FROM txt WHERE p = '3')
SELECT failed_rule, count(*) AS claim_count FROM errors GROUP BY 1""")
def claim_errors(t: Tables) -> DataFrame:
    broken = contracts.rule_violations(read_raw_claims(_text_claims(t)), raw_claim_rules())
    return broken.groupBy("failed_rule").agg(F.count(F.lit(1)).alias("claim_count"))


@query(sql="""SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, 'CLM-' || o_orderkey AS claim_number,
       CASE o_orderstatus WHEN 'O' THEN 'SUBMITTED' WHEN 'F' THEN 'CLOSED' ELSE 'PENDING' END AS claim_status,
       CASE WHEN substr(o_orderpriority, 1, 1) = '4' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS incident_date,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS submitted_at,
       CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN NULL WHEN '5' THEN -o_totalprice ELSE o_totalprice END AS claim_amount,
       CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'AUST' ELSE 'AUD' END AS currency_code
FROM orders""")
def normalize_claim(t: Tables) -> DataFrame:
    from perilake.plans.contracts import CLAIM_FILE

    typed = contracts.conform(contracts.project_contract(_text_claims(t), CLAIM_FILE.columns), CLAIM_FILE)
    return typed.select(
        "claim_id", "claim_number", "claim_status", day("incident_date").alias("incident_date"),
        instant("submitted_at").alias("submitted_at"), F.col("claim_amount").cast("double").alias("claim_amount"), "currency_code")


@query(sql="""SELECT CASE WHEN o_custkey > 0 AND o_orderstatus IN ('O', 'F') AND substr(o_orderpriority, 1, 1) = '1'
         AND (o_orderstatus <> 'F' OR 250000 <= o_totalprice) THEN 'accepted' ELSE 'rejected' END AS verdict,
       count(*) AS claim_count FROM orders GROUP BY 1""")
def typed_claim_contract(t: Tables) -> DataFrame:
    """Contract on typed rows: a missing zone is read as UTC here, so only priority 1 is clean."""
    from perilake.plans.contracts import CLAIM_FILE

    typed = contracts.conform(_text_claims(t), CLAIM_FILE)
    verdict = F.when(contracts.all_hold(typed_claim_rules()), "accepted").otherwise("rejected")
    return typed.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("claim_count"))


@query(sql="""SELECT c_custkey, sha256(concat_ws('||', c_custkey, c_name, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT), coalesce(segment, '<NULL>'))) AS record_hash,
       sha256(concat_ws('||', c_custkey, c_name, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT), segment)) AS compatible_hash
FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer)""")
def lineage_hash(t: Tables) -> DataFrame:
    rows = t.customer.withColumns({
        "acctbal": cents("c_acctbal"), "segment": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))})
    hashed = ["c_custkey", "c_name", "c_nationkey", "acctbal", "segment"]
    lined = contracts.add_lineage(rows, run_id="run", source_system="file_reference", source_object="customer", hash_columns=hashed)
    return lined.select("c_custkey", F.col("_record_hash").alias("record_hash"), row_hash(hashed, None).alias("compatible_hash"))


PART_REFERENCE = TableContract(
    "part_reference", "p_brand",
    ddl="p_brand string, p_type string, p_name string, p_size int, p_retailprice decimal(18,4), p_partkey bigint")


@query(sql="""SELECT * EXCLUDE (rn) FROM (
  SELECT p_brand, p_type, p_name, p_size, p_partkey, p_retailprice,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1""")
def reference_dim(t: Tables) -> DataFrame:
    """Reference load: text in, typed by contract, keyless rows out, newest version per key."""
    text = t.part.select(*[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) for c in PART_REFERENCE.columns])
    typed = contracts.conform(text, PART_REFERENCE)
    keyed = typed.filter(F.col("p_brand") != "")
    newest = dedup.latest_per_key(keyed, ["p_brand"], ["p_retailprice", "p_partkey"])
    return newest.withColumn("p_retailprice", F.col("p_retailprice").cast("double"))


@query(sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS shipdate, price_cents FROM (
  SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
      sha256(concat_ws('||', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))) DESC) AS rn
  FROM lineitem) WHERE rn = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("price_cents", cents("l_extendedprice"))
    hashed = rows.withColumn("_record_hash", row_hash(["l_partkey", "l_suppkey", "price_cents"]))
    newest = dedup.latest_per_key(hashed, ["l_orderkey", "l_linenumber"], ["l_shipdate", "_record_hash"])
    return newest.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("shipdate"), "price_cents")


@query(sql="""SELECT count(*) AS input_count, count(DISTINCT id) AS output_count, count(*) - count(DISTINCT id) AS duplicate_count,
       CAST(max(n) AS BIGINT) AS most_copies
FROM (SELECT id, count(*) OVER (PARTITION BY id) AS n FROM (
  SELECT sha256(concat_ws('||', l_orderkey, l_linenumber, l_returnflag)) AS id FROM lineitem))""")
def dedup_exact_changes(t: Tables) -> DataFrame:
    rows = t.lineitem.select(row_hash(["l_orderkey", "l_linenumber", "l_returnflag"]).alias("_source_change_id"))
    return changes.repeat_counts(rows)


CURRENT_SQL = f"""WITH {USER_CHANGES}
SELECT user_id, event_id, event_type, op AS operation, value_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_us DESC, change_id DESC) AS rn FROM changes)
WHERE rn = 1 AND op <> 'D'"""


def _state(frame: DataFrame) -> DataFrame:
    return frame.select("user_id", "event_id", "event_type", F.col("_operation").alias("operation"), "value_cents")


@query(sql=CURRENT_SQL)
def cdc_current_state(t: Tables) -> DataFrame:
    return _state(changes.current_state(user_changes(t), "user_id"))


@query(sql=CURRENT_SQL)
def cdc_apply_incremental(t: Tables) -> DataFrame:
    """Two deliveries folded in one after the other, the first one replayed at the end."""
    log = user_changes(t)
    middle = F.lit("2024-01-15").cast("timestamp")
    early, late = log.filter(F.col("_source_order") < middle), log.filter(F.col("_source_order") >= middle)
    state = changes.newest_changes(early, "user_id")
    state = changes.apply_changes(state, late, "user_id")
    return _state(changes.live(changes.apply_changes(state, early, "user_id")))


@query(sql=CURRENT_SQL)
def cdc_two_deliveries(t: Tables) -> DataFrame:
    """The log in two deliveries, the second with a part of the first again, folded into a bucketed state."""
    log = user_changes(t)
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    lake = Lakehouse(t.spark, f"{run_folder(t.spark)}/deliveries-{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex[:12]}_")
    state = StateTable(lake, "users", "user_id", buckets=16)
    for run, part in (("d1", log.filter(half == 0)), ("d2", log.filter((half == 1) | (F.col("event_type") == "error")))):
        state.commit(state.fold(durable(part), run))
    return _state(changes.live(state.rows()))


@query(sql="""SELECT event_type, CASE WHEN event_type = 'view' THEN 'unsupported operation' ELSE 'value must be at least 10' END AS failed_rules, count(*) AS change_count
FROM events WHERE event_type = 'view' OR (event_type <> 'error' AND value < 10) GROUP BY 1, 2""")
def cdc_quarantine(t: Tables) -> DataFrame:
    """Envelope rules judge every change; tombstones are exempt from value rules."""
    operation = F.when(F.col("event_type") == "view", "X").when(F.col("event_type") == "error", "D").otherwise("U")
    log = t.events.withColumns({"_operation": operation, "_source_order": F.col("ts").cast("timestamp")})
    supported = F.col("_operation").isin("I", "U", "D")
    rules = [
        Rule("unsupported operation", supported),
        Rule("source order is required", F.col("_source_order").isNotNull()),
        Rule("value must be at least 10", ~supported | (F.col("_operation") == "D") | (F.col("value") >= 10)),
    ]
    bad = log.withColumn("failed_rules", F.array_join(contracts.failed_rules(rules), "; ")).filter(~contracts.all_hold(rules))
    return bad.groupBy("event_type", "failed_rules").agg(F.count(F.lit(1)).alias("change_count"))


@query(sql=f"""WITH {USER_CHANGES}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_us DESC, change_id DESC) AS rn FROM changes) WHERE rn = 1)
SELECT (SELECT count(*) FROM changes) AS input_count, (SELECT count(*) FROM newest WHERE op <> 'D') AS output_count, 0::BIGINT AS rejected_count,
       (SELECT count(*) FROM changes) - (SELECT count(*) FROM newest) AS duplicate_count, 1 AS reconciliation_passed""")
def cdc_reconciliation(t: Tables) -> DataFrame:
    """Counts of a change-log run: superseded changes are the duplicates."""
    log = user_changes(t)
    newest = changes.newest_changes(log, "user_id")
    total = log.agg(F.count(F.lit(1)).alias("input_count")).withColumn("_one", F.lit(1))
    kept = newest.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_operation") != "D").alias("output_count")).withColumn("_one", F.lit(1))
    run = total.join(kept, "_one").select(
        F.lit("SUCCEEDED").alias("status"), "input_count", "output_count", F.lit(0).cast("long").alias("rejected_count"),
        (F.col("input_count") - F.col("keys")).alias("duplicate_count"))
    done = audit.finish_audit(run, "changes")
    return done.select("input_count", "output_count", "rejected_count", "duplicate_count", F.col("reconciliation_passed").cast("int").alias("reconciliation_passed"))


# --- quality --------------------------------------------------------------------------------

ORDER_SUITE = (IsComplete("o_orderkey"), IsUnique("o_orderkey"), AtLeast("o_totalprice", 2000), IsComplete("o_custkey"))
LINE_SUITE = (IsComplete("l_orderkey"), IsUnique("line"), AtLeast("l_extendedprice", 0), IsComplete("l_partkey"), IsUnique("l_partkey"))

DQ_SQL = """suites AS (
  SELECT 'orders' AS entity, 'IsComplete "o_orderkey"' AS rule, avg((o_orderkey IS NOT NULL)::INT) AS m, count(*) AS total FROM orders
  UNION ALL SELECT 'orders', 'IsUnique "o_orderkey"', sum((n = 1)::INT) / sum(n), sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
  UNION ALL SELECT 'orders', 'ColumnValues "o_totalprice" >= 2000', avg((o_totalprice >= 2000)::INT), count(*) FROM orders
  UNION ALL SELECT 'orders', 'IsComplete "o_custkey"', avg((o_custkey IS NOT NULL)::INT), count(*) FROM orders
  UNION ALL SELECT 'lineitem', 'IsComplete "l_orderkey"', avg((l_orderkey IS NOT NULL)::INT), count(*) FROM lineitem
  UNION ALL SELECT 'lineitem', 'IsUnique "line"', sum((n = 1)::INT) / sum(n), sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
  UNION ALL SELECT 'lineitem', 'ColumnValues "l_extendedprice" >= 0', avg((l_extendedprice >= 0)::INT), count(*) FROM lineitem
  UNION ALL SELECT 'lineitem', 'IsComplete "l_partkey"', avg((l_partkey IS NOT NULL)::INT), count(*) FROM lineitem
  UNION ALL SELECT 'lineitem', 'IsUnique "l_partkey"', sum((n = 1)::INT) / sum(n), sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)),
judged AS (SELECT entity, rule, round(m, 6) AS metric, CAST(total AS BIGINT) AS total, CASE WHEN m = 1 THEN 'Passed' ELSE 'Failed' END AS outcome FROM suites)"""


def _suites(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return quality.evaluate(t.orders, "orders", ORDER_SUITE).unionByName(quality.evaluate(lines, "lineitem", LINE_SUITE))


@query(sql=f"WITH {DQ_SQL} SELECT entity, rule, metric, total, outcome FROM judged")
def dq_rules(t: Tables) -> DataFrame:
    return _suites(t).select("entity", "rule", "metric", "total", "outcome")


@query(sql=f"""WITH {DQ_SQL} SELECT entity, CAST(sum((outcome = 'Passed')::INT) AS BIGINT) AS passed_rules,
  CAST(sum((outcome = 'Failed')::INT) AS BIGINT) AS failed_rules, round(avg((outcome = 'Passed')::INT), 6) AS quality_score, 'FAIL' AS status FROM judged GROUP BY 1""")
def dq_summary(t: Tables) -> DataFrame:
    return quality.summarise(_suites(t))


@query(sql=f"""WITH {CLAIM_LINES}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY submitted_at DESC) AS rn FROM claims) WHERE rn = 1)
SELECT 'before_dedup' AS gate, round(sum((n = 1)::INT) / sum(n), 6) AS uniqueness, 'FAIL' AS status FROM (SELECT count(*) AS n FROM claims GROUP BY claim_id)
UNION ALL SELECT 'after_dedup', round(sum((n = 1)::INT) / sum(n), 6), 'PASS' FROM (SELECT count(*) AS n FROM newest GROUP BY claim_id)""")
def gate_position(t: Tables) -> DataFrame:
    """The same uniqueness gate before and after de-duplication."""
    lines = joins.dealt_by(claim_lines(t).select("claim_id", "submitted_at"), "claim_id")
    newest = [dedup.latest_per_key(part, ["claim_id"], ["submitted_at"]) for part in lines]
    parts = []
    for name, frames in (("before_dedup", lines), ("after_dedup", newest)):
        judged = quality.evaluate_parts(frames, name, [IsUnique("claim_id")])
        status = F.when(F.col("outcome") == "Passed", "PASS").otherwise("FAIL")
        parts.append(judged.select(F.col("entity").alias("gate"), F.col("metric").alias("uniqueness"), status.alias("status")))
    return reduce(DataFrame.unionByName, parts)


@query(sql=f"""WITH {ENRICHED}, j AS (SELECT claim_id, coalesce(incident_date <= CAST(submitted_at AS DATE) AND claim_amount >= 0, false) AS ok FROM enriched)
SELECT count(*) AS input_count, count(DISTINCT CASE WHEN ok THEN claim_id END) AS output_count, count(*) FILTER (NOT ok) AS rejected_count,
       count(*) FILTER (ok) - count(DISTINCT CASE WHEN ok THEN claim_id END) AS duplicate_count FROM j""")
def stage_counts(t: Tables) -> DataFrame:
    rules = [Rule("dates", F.col("incident_date") <= F.to_date("submitted_at")), Rule("amount", F.col("claim_amount") >= 0)]
    return quality.stage_counts(enriched_claims(t), contracts.all_hold(rules), "claim_id")


RUNS_SQL = """runs AS (
  SELECT l_suppkey AS run_id, count(*) AS input_count, count(DISTINCT l_orderkey) FILTER (l_returnflag <> 'R') AS output_count,
         count(*) FILTER (l_returnflag = 'R') AS rejected_count,
         count(*) FILTER (l_returnflag = 'N') AS duplicate_count FROM lineitem GROUP BY 1)"""


def _runs(t: Tables) -> DataFrame:
    """One audit row per supplier delivery; duplicates are mostly reported wrong on purpose."""
    accepted = F.col("l_returnflag") != "R"
    return t.lineitem.groupBy(F.col("l_suppkey").alias("run_id")).agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_distinct(F.when(accepted, F.col("l_orderkey"))).alias("output_count"),
        F.count_if(~accepted).alias("rejected_count"),
        F.count_if(F.col("l_returnflag") == "N").alias("duplicate_count"),
    ).withColumns({"pipeline_name": F.lit("batch-file"), "source": F.lit("lineitem"), "stage": F.lit("silver"), "status": F.lit("SUCCEEDED")})


@query(sql=f"""WITH {RUNS_SQL} SELECT run_id, input_count, output_count, rejected_count, duplicate_count,
  round((output_count + duplicate_count) / input_count, 6) AS quality_score,
  (input_count = output_count + rejected_count + duplicate_count)::INT AS reconciled,
  CASE WHEN input_count = output_count + rejected_count + duplicate_count THEN '' ELSE 'batch reconciliation failed; reconciliation_passed is not true' END AS errors
FROM runs""")
def audit_reconciliation(t: Tables) -> DataFrame:
    done = audit.finish_audit(_runs(t))
    return done.select(
        "run_id", "input_count", "output_count", "rejected_count", "duplicate_count", "quality_score",
        F.col("reconciliation_passed").cast("int").alias("reconciled"), F.array_join(audit.audit_errors(done), "; ").alias("errors"))


@query(sql="""SELECT event_type AS pipeline, strftime(time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) FILTER (value < 20) AS failures, count(*) AS executions,
  CASE WHEN count(*) FILTER (value < 20) >= 1 THEN 'ALARM' ELSE 'OK' END AS state FROM events GROUP BY 1, 2""")
def failure_alarm(t: Tables) -> DataFrame:
    runs = t.events.withColumn("status", F.when(F.col("value") < 5, "FAILED").when(F.col("value") < 12, "TIMED_OUT").when(F.col("value") < 20, "ABORTED").otherwise("SUCCEEDED"))
    alarms = audit.failure_alarm(runs, time="ts", group="event_type", status="status")
    return alarms.withColumn("window_start", instant("window_start"))


# --- files and identities ---------------------------------------------------------------------


@query(sql="""WITH landing AS (SELECT doc_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS source_object, sha256(text) AS fid FROM documents),
done AS (SELECT DISTINCT sha256(text) AS fid FROM documents JOIN labels USING (doc_id)),
first AS (SELECT fid, min(source_object) AS f FROM landing GROUP BY 1)
SELECT doc_id, CASE WHEN d.fid IS NULL AND source_object = f THEN 'NEW' ELSE 'DUPLICATE' END AS status
FROM landing JOIN first USING (fid) LEFT JOIN done d USING (fid)""")
def new_files(t: Tables) -> DataFrame:
    """Labelled documents count as already published; the rest arrive now."""
    name = F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    files = durable(t.documents.select("doc_id", name.alias("source_object"), F.sha2("text", 256).alias("source_file_id")))
    ledger = files.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return joins.new_files(files, ledger).select("doc_id", "status")


@query(sql="""SELECT status, count(*) AS event_count FROM (SELECT regexp_full_match(
  'v5-' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE event_type END || '-' || strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, CASE event_type WHEN 'view' THEN 7 ELSE 8 END),
  'v5-[a-z0-9-]+-\\d{8}T\\d{6}Z-[0-9a-f]{8}') AS status FROM events) GROUP BY 1""")
def run_id_filter(t: Tables) -> DataFrame:
    scenario = F.when(F.col("event_type") == "error", "ERROR").otherwise(F.col("event_type"))
    suffix = F.substring(F.sha2(F.col("event_id").cast("string"), 256), F.lit(1), F.when(F.col("event_type") == "view", 7).otherwise(8))
    ids = t.events.select(F.concat_ws("-", F.lit("v5"), scenario, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), suffix).alias("run_id"))
    return ids.groupBy(is_run_id("run_id").alias("status")).agg(F.count(F.lit(1)).alias("event_count"))


@query(sql="""SELECT page_id, url, length(html) AS html_chars, sha256(html) AS source_file_id FROM pages""")
def decoded_object_keys(t: Tables) -> DataFrame:
    """Object keys arrive percent-encoded; identity comes from the content alone."""
    encoded = t.pages.select("page_id", F.url_encode("url").alias("key"), "html")
    return encoded.select("page_id", decoded_key("key").alias("url"), F.length("html").alias("html_chars"), F.sha2("html", 256).alias("source_file_id"))
