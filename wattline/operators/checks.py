"""Dataset summary and suitability checks, from one scan and the stored session counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.contract import (
    EXPECTED_RANGES,
    MAX_OUT_OF_RANGE_SHARE,
    MIN_ROWS_FOR_MODELING,
    MIN_ROWS_PER_SESSION,
    MIN_SESSIONS,
    contract,
)
from wattline.functions.coerce import numeric
from wattline.operators.columns import numeric_columns
from wattline.operators.selection import whole_median
from wattline.session import spool


def _ranged(df: DataFrame) -> list[str]:
    return [c for c in EXPECTED_RANGES if c in df.columns]


def _facts(df: DataFrame, source: str, middle: bool = False) -> DataFrame:
    """One row of counts. Sessions are counted first and rolled up, so one scan serves all.

    ``middle`` adds the median session size, for which the sessions' counts are stored.
    """
    spec = contract(source)
    has_target, has_session = spec.target_column in df.columns, spec.session_column in df.columns
    y = numeric(df, spec.target_column) if has_target else F.lit(None).cast("double")
    group = F.coalesce(F.col(spec.session_column).cast("string"), F.lit("nan")) if has_session else F.lit("")
    partial = [
        F.count("*").alias("n"),
        F.count(y).alias("y_n"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
    ]
    total = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("y_n"), F.lit(0)).alias("target_valid_rows"),
        F.min("y_min").alias("target_min"),
        F.max("y_max").alias("target_max"),
        F.count("*").alias("groups"),
        F.coalesce(F.min("n"), F.lit(0)).alias("least"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
    ]
    for i, c in enumerate(_ranged(df)):
        x, (low, high) = numeric(df, c), EXPECTED_RANGES[c]
        partial += [F.count(x).alias(f"v{i}"), F.count_if((x < low) | (x > high)).alias(f"o{i}")]
        total += [F.sum(f"v{i}").alias(f"v{i}"), F.sum(f"o{i}").alias(f"o{i}")]
    per = df.groupBy(group.alias("g")).agg(*partial)
    if middle:
        per = spool(per.drop("g"), "sessions")
        total.append(F.lit(whole_median(per, "n")).cast("double").alias("middle"))
    return per.agg(*total)


def _ready(groups: Column, least: Column) -> Column:
    return (groups >= MIN_SESSIONS) & (least >= MIN_ROWS_PER_SESSION)


def dataset_summary(df: DataFrame, source: str) -> DataFrame:
    """One-row summary of a normalised dataset."""
    spec = contract(source)
    numbers = numeric_columns(df)
    has_target, has_session = spec.target_column in df.columns, spec.session_column in df.columns
    missing = [c for c in spec.recommended_columns if c not in df.columns]
    zero = F.lit(0).cast("bigint")
    session = (lambda c: F.col(c)) if has_session else (lambda c: zero)
    rate = 1.0 - F.try_divide(F.col("target_valid_rows"), F.col("n_rows"))
    return _facts(df, source, has_session).select(
        F.lit(spec.name).alias("source"),
        F.lit(spec.data_kind).alias("data_kind"),
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(numbers)).cast("bigint").alias("n_numeric_columns"),
        F.lit(len(df.columns) - len(numbers)).cast("bigint").alias("n_categorical_columns"),
        F.lit(has_target).alias("has_target"),
        "target_valid_rows",
        (rate if has_target else F.lit(None).cast("double")).alias("target_missing_rate"),
        "target_min",
        "target_max",
        F.lit(spec.timestamp_column in df.columns).alias("has_timestamp"),
        F.lit(has_session).alias("has_session_id"),
        session("groups").alias("unique_sessions"),
        session("least").alias("min_rows_per_session"),
        (F.col("middle") if has_session else F.lit(None).cast("double")).alias("median_rows_per_session"),
        session("most").alias("max_rows_per_session"),
        (_ready(F.col("groups"), F.col("least")) & F.lit(has_session)).alias("grouped_validation_ready"),
        F.lit(len(spec.recommended_columns) - len(missing)).cast("bigint").alias("recommended_columns_present"),
        F.lit(",".join(missing)).alias("recommended_columns_missing"),
    )


def _row(code: str, severity: str, feature: Column, value: Column, limit: Column, text: Column, when: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            feature.cast("string").alias("feature"),
            value.cast("double").alias("value"),
            limit.cast("double").alias("threshold"),
            text.alias("message"),
        ),
    )


def suitability_checks(df: DataFrame, source: str) -> DataFrame:
    """All dataset warnings: (code, severity, feature, value, threshold, message)."""
    spec = contract(source)
    none, always = F.lit(None), F.lit(True)
    has_session = F.lit(spec.session_column in df.columns)
    rows = []
    absent = [c for c in spec.required_columns if c not in df.columns]
    if absent:
        text = f"Required column(s) missing: {', '.join(absent)}."
        rows.append(
            _row("missing_required_columns", "error", F.lit(",".join(absent)), F.lit(len(absent)), none, F.lit(text), always)
        )
    for c in spec.recommended_columns:
        if c not in df.columns:
            text = f"Recommended column '{c}' is absent; diagnostics may be weaker."
            rows.append(_row("missing_recommended_column", "warning", F.lit(c), none, none, F.lit(text), always))
    n = F.col("n_rows")
    rows.append(
        _row(
            "small_dataset", "warning", none, n, F.lit(MIN_ROWS_FOR_MODELING),
            F.format_string("Only %d rows; results are unstable.", n), n < MIN_ROWS_FOR_MODELING,
        )
    )
    if spec.data_kind == "synthetic":
        text = "Generated data is fine for tests, not for accuracy claims."
        rows.append(_row("synthetic_data_mode", "warning", none, none, none, F.lit(text), always))
    ready = _ready(F.col("groups"), F.col("least")) & has_session
    rows.append(
        _row(
            "grouped_validation_not_ready", "warning", F.lit(spec.session_column),
            F.when(has_session, F.col("groups")).otherwise(0), F.lit(MIN_SESSIONS),
            F.lit(f"Needs {MIN_SESSIONS} sessions of {MIN_ROWS_PER_SESSION} rows or more."), ~ready,
        )
    )
    for i, c in enumerate(_ranged(df)):
        valid, share = F.col(f"v{i}"), F.try_divide(F.col(f"o{i}"), F.col(f"v{i}"))
        low, high = EXPECTED_RANGES[c]
        rows.append(
            _row(
                "no_valid_unit_values", "warning", F.lit(c), F.lit(0), none,
                F.lit(f"Column '{c}' has no valid number."), F.coalesce(valid, F.lit(0)) == 0,
            )
        )
        rows.append(
            _row(
                "unit_range_check", "warning", F.lit(c), share, F.lit(MAX_OUT_OF_RANGE_SHARE),
                F.format_string(f"Column '{c}': %.1f%% outside [{low}, {high}].", share * 100),
                share > MAX_OUT_OF_RANGE_SHARE,
            )
        )
    found = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return _facts(df, source).select(F.explode(found).alias("c")).select("c.*")


def severity_rollup(checks: DataFrame) -> DataFrame:
    """Number of errors and warnings, and the overall status."""
    return checks.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    ).withColumn(
        "status", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("ok")
    )
