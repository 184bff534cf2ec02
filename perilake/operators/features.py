"""Leakage-safe claim-risk features: projection, validation, vectors, records and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DatetimeType, NumericType

from perilake.functions.identity import row_hash
from perilake.functions.money import zero_if_missing
from perilake.functions.temporal import iso_event_time, text_date, vehicle_age
from perilake.functions.text import cleaned, names_where, present
from perilake.operators.dedup import latest_per_key

# --- fixed values: the feature contract ------------------------------------------------
ID, LABEL, EVENT_TIME = "claim_id", "high_risk_claim", "event_time"
VERSION_PREFIX = "claim-risk-v2"
MAX_DOUBLE = 1.7976931348623157e308
LEGACY_VERSION_PREFIX = "legacy-manifest-sha256:"

LEAKAGE = ("approved_amount", "paid_amount", "claim_status", "outcome_severity",
           "investigation_result", "settlement_duration", "updated_at")

NUMERIC = ("claim_amount", "reporting_delay_days", "years_experience", "catastrophe_risk_score",
           "region_theft_risk_score", "weather_risk_score", "accident_risk_score", "deductible_aud",
           "coverage_limit_aud", "optional_flag", "market_value_aud", "safety_rating", "vehicle_age")

LEVELS = {
    "product_type": ("AUTO", "HOME", "LIFE", "TRAVEL", "OTHER"),
    "product_risk_tier": ("LOW", "MEDIUM", "HIGH", "OTHER"),
    "broker_tier": ("BRONZE", "SILVER", "GOLD", "PLATINUM", "OTHER"),
    "claim_category": ("COLLISION", "FIRE", "THEFT", "WEATHER", "OTHER"),
    "overall_risk_band": ("LOW", "MEDIUM", "HIGH", "OTHER"),
    "coverage_tier": ("BASIC", "PLUS", "STANDARD", "PREMIUM", "ULTIMATE", "OTHER"),
    "repair_cost_band": ("LOW", "MEDIUM", "HIGH", "OTHER"),
    "theft_risk_band": ("LOW", "MEDIUM", "HIGH", "OTHER"),
    "vehicle_risk_category": ("STANDARD", "ELEVATED", "SPECIALIST", "OTHER"),
}

# Allowed range per numeric feature (low, high); None is open.
RANGES = {
    "claim_amount": (0, None),
    "reporting_delay_days": (0, None),
    "years_experience": (0, 80),
    "catastrophe_risk_score": (0, 1),
    "region_theft_risk_score": (0, 1),
    "weather_risk_score": (0, 1),
    "accident_risk_score": (0, 1),
    "deductible_aud": (0, None),
    "coverage_limit_aud": (0, None),
    "market_value_aud": (0, None),
    "safety_rating": (1, 5),
    "vehicle_age": (0, 100),
}

# Columns known at submission, as stored in the Gold feature table.
GOLD_FEATURE_COLUMNS = (
    "claim_id", "product_id", "product_type", "product_category", "product_risk_tier", "broker_id",
    "years_experience", "broker_tier", "branch_id", "broker_region_code", "claim_type_id",
    "claim_type_code", "claim_category", "incident_region_code", "catastrophe_risk_score",
    "region_theft_risk_score", "weather_risk_score", "accident_risk_score",
    "natural_hazard_risk_score", "overall_risk_band", "coverage_code", "coverage_tier",
    "coverage_category", "deductible_aud", "coverage_limit_aud", "optional_flag", "vehicle_code",
    "vehicle_class", "model_year", "market_value_aud", "safety_rating", "repair_cost_band",
    "theft_risk_band", "vehicle_risk_category", "incident_date", "submitted_at", "claim_amount",
    "high_risk_claim", "_run_id", "_ingested_at", "_effective_at",
)
# ---------------------------------------------------------------------------------------


class DatasetInvalid(ValueError):
    """The feature dataset breaks its contract; ``issues`` lists the kinds of problems."""

    def __init__(self, issues: Sequence[str]):
        self.issues = list(issues)
        super().__init__("feature dataset validation failed: " + "; ".join(self.issues))


def one_hot_names(levels: Mapping[str, Sequence[str]] = LEVELS) -> list[str]:
    return [f"{column}__{level}" for column, values in levels.items() for level in values]


def feature_names() -> list[str]:
    return [*NUMERIC, *one_hot_names()]


def assert_no_leakage(columns: Sequence[str]) -> None:
    leaked = sorted(set(columns) & set(LEAKAGE))
    if leaked:
        raise DatasetInvalid(["feature contract contains post-submission leakage fields: " + ",".join(leaked)])


def feature_projection(enriched: DataFrame) -> DataFrame:
    """Submission-time columns, label and lineage, plus the vehicle's age."""
    assert_no_leakage(GOLD_FEATURE_COLUMNS)
    return enriched.select(*GOLD_FEATURE_COLUMNS).withColumn("vehicle_age", vehicle_age("submitted_at", "model_year"))


def feature_schema(frame: DataFrame) -> DataFrame:
    """(feature_name, feature_type) rows of the feature table, in order."""
    rows = [(ID, "String"), (EVENT_TIME, "String"), (LABEL, "Integral"), *[(n, "Fractional") for n in feature_names()]]
    return frame.sparkSession.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(rows)], "position int, feature_name string, feature_type string")


# --- vectors ---------------------------------------------------------------------------


def one_hot(column: str | Column, levels: Sequence[str]) -> list[Column]:
    """0/1 doubles per level; anything outside the named levels counts as the last one."""
    value = F.upper(F.col(column) if isinstance(column, str) else column)
    named = F.coalesce(value.isin(*levels[:-1]), F.lit(False))
    hits = [named & (value == level) for level in levels[:-1]] + [~named]
    return [F.coalesce(hit, F.lit(False)).cast("double") for hit in hits]


def _is_number(frame: DataFrame, name: str) -> bool:
    return isinstance(frame.schema[name].dataType, NumericType)


def as_number(frame: DataFrame, name: str) -> Column:
    """Double, NULL when the value is missing or unreadable; typed columns are only widened."""
    if _is_number(frame, name):
        return F.col(name).cast("double")
    return cleaned(F.col(name).cast("string")).try_cast("double")


def number(frame: DataFrame, name: str) -> Column:
    """Double; blank or missing is 0."""
    return F.coalesce(as_number(frame, name), F.lit(0.0))


def _as_day(frame: DataFrame, name: str) -> Column:
    """Calendar day of a date, timestamp or text column."""
    kind = frame.schema[name].dataType
    return F.to_date(name) if isinstance(kind, DatetimeType) else text_date(F.col(name).cast("string"))


def _delay(frame: DataFrame) -> Column:
    computed = F.datediff(_as_day(frame, "submitted_at"), _as_day(frame, "incident_date")).cast("double")
    if "reporting_delay_days" not in frame.columns:
        return computed
    given = as_number(frame, "reporting_delay_days")
    if _is_number(frame, "reporting_delay_days"):
        return F.coalesce(given, computed)
    return F.when(present("reporting_delay_days"), given).otherwise(computed)


def vectorize(frame: DataFrame, keep: Sequence[str] = (ID, LABEL)) -> DataFrame:
    """The 54 model inputs as double columns, in contract order; one projection, no shuffle."""
    numeric = [(_delay(frame) if n == "reporting_delay_days" else number(frame, n)).alias(n) for n in NUMERIC]
    flags = [
        hit.alias(f"{c}__{level}") for c, levels in LEVELS.items() for hit, level in zip(one_hot(c, levels), levels)
    ]
    # The numeric inputs reuse source names, so kept columns come first and must not clash.
    return frame.select(*[F.col(c) for c in keep], *numeric, *flags)


def legacy_claim_features(claims: DataFrame) -> DataFrame:
    """The four smoke features: amount, approved (missing is 0), days to submit, is approved."""
    return claims.select(
        F.col("claim_id"),
        F.col("claim_amount").cast("double").alias("claim_amount"),
        zero_if_missing(F.col("approved_amount").cast("decimal(18,2)")).cast("double").alias("approved_amount"),
        F.datediff(F.to_date("submitted_at"), F.to_date("incident_date")).cast("double").alias("days_to_submit"),
        (F.upper("claim_status") == "APPROVED").cast("double").alias("is_approved"),
    )


# --- validation ------------------------------------------------------------------------


def with_row_issues(frame: DataFrame) -> DataFrame:
    """Add ``issues``: identity, label, each numeric and categorical feature, time order.

    Every value is read once into a column of its own and then only compared, which keeps the
    generated code small enough to be compiled.
    """
    known = "as_of_date" in frame.columns
    submitted = _as_day(frame, "submitted_at")
    as_of = F.coalesce(_as_day(frame, "as_of_date"), submitted) if known else submitted
    unreadable = F.lit(False)
    if known and not isinstance(frame.schema["as_of_date"].dataType, DatetimeType):
        unreadable = present("as_of_date") & _as_day(frame, "as_of_date").isNull()
    label = as_number(frame, LABEL)
    read = frame.withColumns({
        **{f"_n_{n}": _delay(frame) if n == "reporting_delay_days" else as_number(frame, n) for n in NUMERIC},
        "_label": label, "_submitted": submitted, "_as_of": as_of, "_bad_as_of": unreadable,
    })

    def outside(name: str) -> Column:
        value = F.col(f"_n_{name}")
        if name == "optional_flag":
            bad = ~value.isin(0.0, 1.0)
        else:
            low, high = RANGES[name]
            # NaN is larger than any number, so an open range still needs a finite upper end.
            bad = ~value.between(low, MAX_DOUBLE if high is None else high)
        return value.isNull() | bad

    blank = lambda c: ~present(F.col(c).cast("string"))
    checks = [
        (blank(ID), f"{ID} is null"),
        (F.col("_label").isNull() | ~F.col("_label").isin(0.0, 1.0), f"{LABEL} must be 0 or 1"),
        *[(outside(n), f"{n} is null, invalid, or outside its allowed range") for n in NUMERIC],
        *[(blank(c), f"{c} is null") for c in LEVELS],
        (F.col("_submitted").isNull(), "submitted_at is null or invalid"),
        (F.col("_bad_as_of"), "as_of_date is null or invalid"),
        (F.col("_as_of") > F.col("_submitted"), "as_of_date is after claim submission"),
    ]
    return read.withColumn("issues", names_where(checks)).drop(*[f"_n_{n}" for n in NUMERIC], "_label", "_submitted", "_as_of", "_bad_as_of")


def issue_counts(frame: DataFrame) -> DataFrame:
    """Kinds of row problems with the number of rows showing each."""
    listed = with_row_issues(frame).select(F.explode_outer("issues").alias("issue")).filter(F.col("issue").isNotNull())
    return listed.groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))


def dataset_version(frame: DataFrame, columns: Sequence[str], prefix: str = VERSION_PREFIX) -> DataFrame:
    """Content version that does not depend on row order or partitioning.

    Rows are hashed one by one and the hashes are added up in four exact lanes, so
    nothing is sorted or gathered; row count and lane sums are hashed once more.
    """
    text = [F.coalesce(cleaned(F.col(c).cast("string")), F.lit("")) for c in columns]
    digest = frame.select(row_hash(text).alias("h"))
    lane = lambda i: F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = digest.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(lane(i)), F.lit(0)).alias(f"s{i}") for i in range(4)])
    combined = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")]), 256)
    return sums.select(
        F.col("n").alias("row_count"), F.concat(F.lit(prefix + "-"), F.substring(combined, 1, 16)).alias("dataset_version")
    )


VERSION_COLUMNS = (ID, LABEL, "submitted_at", "as_of_date", "feature_version",
                   *[n for n in NUMERIC if n != "reporting_delay_days"], *LEVELS)


def validate_feature_dataset(frame: DataFrame) -> dict[str, object]:
    """Contract report of a feature dataset; raises :class:`DatasetInvalid` with all problems.

    Only kinds of problems and counts reach the driver, never rows.
    """
    assert_no_leakage(feature_names())
    label = as_number(frame, LABEL)
    as_of = _as_day(frame, "as_of_date" if "as_of_date" in frame.columns else "submitted_at")
    stats = frame.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"),
        F.min(as_of).alias("first"), F.max(as_of).alias("last"),
    ).first()
    keys = frame.groupBy(F.col(ID).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(present("k")).agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated")
    ).first()
    issues = [f"{row.issue} ({row.rows} rows)" for row in issue_counts(frame).orderBy("issue").collect()]
    if not stats.n:
        issues.append("dataset is empty")
    if keys.repeated:
        issues.append(f"duplicate {ID} values: {keys.repeated} keys")
    if stats.n and not (stats.pos and stats.neg):
        issues.append("label distribution must contain both classes")
    if issues:
        raise DatasetInvalid(issues)
    version = dataset_version(frame, [c for c in VERSION_COLUMNS if c in frame.columns]).first()
    return {
        "status": "PASSED", "row_count": stats.n, "unique_claim_count": keys.keys, "duplicate_claim_count": 0,
        "class_distribution": {"0": stats.neg, "1": stats.pos}, "dataset_version": version.dataset_version,
        "as_of_date_min": str(stats.first), "as_of_date_max": str(stats.last), "feature_count": len(feature_names()),
        "leakage_fields_in_feature_contract": [],
    }


# --- records and manifests ---------------------------------------------------------------


def sidecar_manifest(labelled: DataFrame, version: str, split: str = "split") -> DataFrame:
    """Identity, time, versions, split and label of every row of the matrices."""
    has = labelled.columns
    as_of = F.col("submitted_at").cast("string")
    if "as_of_date" in has:
        as_of = F.coalesce(F.nullif(F.col("as_of_date").cast("string"), F.lit("")), as_of)
    feature_version = F.coalesce(F.nullif(F.col("feature_version"), F.lit("")), F.lit("v1")) if "feature_version" in has else F.lit("v1")
    return labelled.select(
        F.col(ID), F.col("submitted_at").cast("string").alias(EVENT_TIME), F.substring(as_of, 1, 10).alias("as_of_date"),
        feature_version.alias("feature_version"), F.lit(version).alias("dataset_version"),
        F.col(split).alias("source_split"), F.col(LABEL),
    )


def manifest_with_lineage(manifest: DataFrame, content: str | Column) -> DataFrame:
    """Give an older manifest a dataset version derived from its content hash; others unchanged."""
    if "dataset_version" in manifest.columns:
        return manifest
    digest = F.lit(content) if isinstance(content, str) else content
    return manifest.withColumn("dataset_version", F.concat(F.lit(LEGACY_VERSION_PREFIX), digest))


def to_feature_records(
    vectors: DataFrame, manifest: DataFrame, names: Sequence[str] | None = None, *, written_at: Column | None = None,
) -> DataFrame:
    """Offline feature records: id, event time, label, features, write metadata.

    ``problem`` is NULL for a usable record and otherwise says why it must not be stored.
    """
    names = list(names or feature_names())
    side = manifest.select(
        F.col(ID), iso_event_time(F.coalesce(F.nullif(F.col(EVENT_TIME), F.lit("")), F.col("as_of_date"))).alias(EVENT_TIME),
        F.col(LABEL).cast("int").alias("_expected"), F.lit(True).alias("_listed"),
    )
    finite = F.lit(True)
    for n in names:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    joined = vectors.join(side, ID, "full_outer")
    problem = (
        F.when(F.col("_listed").isNull(), "not in manifest")
        .when(F.col(LABEL).isNull(), "no matrix row")
        .when(~F.col(LABEL).cast("int").eqNullSafe(F.col("_expected")), "matrix/manifest label mismatch")
        .when(~finite, "non-finite feature")
        .when(F.col(EVENT_TIME).isNull(), "event time is empty")
    )
    now = F.current_timestamp() if written_at is None else written_at
    return joined.select(
        ID, EVENT_TIME, F.col(LABEL).cast("int").alias(LABEL), *names, now.alias("api_invocation_time"),
        now.alias("write_time"), F.lit(False).alias("is_deleted"), problem.alias("problem"),
    )


def latest_feature_record(
    records: DataFrame, keys: Sequence[str] = (ID, EVENT_TIME), invoked: str = "api_invocation_time",
    written: str = "write_time", deleted: str = "is_deleted",
) -> DataFrame:
    """Newest stored version per record. Deleted versions are left out before ranking, so
    deleting the newest one exposes the version before it."""
    return latest_per_key(records.filter(~F.col(deleted)), keys, [invoked, written])

