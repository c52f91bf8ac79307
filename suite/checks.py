"""Suitability checks, drift checks and the set operations behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.views import FEATURES, PARTS_SQL, cutoff_parts, readings, tel, telemetry
from wattline.functions.scalars import WORKLOAD_BASE, lookup
from wattline.operators import checks, drift
from wattline.operators.columns import column_difference
from wattline.operators.wide import column_stats
from wattline.sources.bmc_csv import concat_frames

_TEXT = ["session_id", "workload_type"]


def _codes(df, code):
    return df.where(F.col("code") == code).select(
        "code", "severity", "feature", F.round("value", 6).alias("value"), "threshold"
    )


@query(
    "chk_01_missing_required",
    """SELECT 'missing_required_columns' AS code, 'error' AS severity, 'power_watts' AS feature, 1.0::DOUBLE AS value, CAST(NULL AS DOUBLE) AS threshold
    FROM (SELECT count(*) AS n FROM lineitem)""",
)
def missing_required(spark, sf_dir):
    return _codes(checks.suitability_checks(telemetry(spark, sf_dir).drop("power_watts"), "nrel_eagle"), "missing_required_columns")


@query(
    "chk_02_missing_recommended",
    """SELECT 'missing_recommended_column' AS code, 'warning' AS severity, unnest(['temperature_c', 'workload_type']) AS feature,
    CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS threshold FROM (SELECT count(*) AS n FROM lineitem)""",
)
def missing_recommended(spark, sf_dir):
    df = telemetry(spark, sf_dir).drop("temperature_c", "workload_type")
    return _codes(checks.suitability_checks(df, "nrel_eagle"), "missing_recommended_column")


@query(
    "chk_03_small_dataset",
    tel(
        """ SELECT 'small_dataset' AS code, 'warning' AS severity, CAST(NULL AS VARCHAR) AS feature, CAST(count(*) AS DOUBLE) AS value, 500.0::DOUBLE AS threshold
        FROM telemetry WHERE power_watts > 216 HAVING count(*) < 500"""
    ),
)
def small_dataset(spark, sf_dir):
    df = telemetry(spark, sf_dir).where("power_watts > 216")
    return _codes(checks.suitability_checks(df, "nrel_eagle"), "small_dataset")


@query(
    "chk_05_grouped_not_ready",
    tel(
        """ , sizes AS (SELECT k1, count(*) AS n FROM telemetry GROUP BY 1)
        SELECT 'grouped_validation_not_ready' AS code, 'warning' AS severity, 'session_id' AS feature, CAST(count(*) AS DOUBLE) AS value, 3.0::DOUBLE AS threshold
        FROM sizes HAVING NOT (count(*) >= 3 AND min(n) >= 20)"""
    ),
)
def grouped_not_ready(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn("session_id", F.col("k1").cast("string"))
    return _codes(checks.suitability_checks(df, "nrel_eagle"), "grouped_validation_not_ready")


_RANGES = {
    "gpu_utilization_pct": (0, 100), "memory_utilization_pct": (0, 100), "temperature_c": (-20, 120), "ambient_c": (-20, 60),
    "graphics_clock_mhz": (0, 10000), "memory_clock_mhz": (0, 12000), "power_watts": (0, 2000),
}


@query(
    "chk_06_unit_range",
    tel(
        """ , bad AS (SELECT * REPLACE (CASE WHEN k1 % 3 = 0 THEN 150 ELSE gpu_utilization_pct END AS gpu_utilization_pct,
          CASE WHEN k1 % 50 = 0 THEN -5 ELSE memory_utilization_pct END AS memory_utilization_pct, temperature_c * 3 AS temperature_c,
          power_watts - 80 AS power_watts) FROM telemetry), shares AS ("""
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, avg(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1.0 ELSE 0.0 END) AS share FROM bad"
            for c, (lo, hi) in _RANGES.items()
        )
        + """) SELECT 'unit_range_check' AS code, 'warning' AS severity, feature, round(share, 6) AS value, 0.05::DOUBLE AS threshold FROM shares WHERE share > 0.05"""
    ),
)
def unit_range(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumns(
        {
            "gpu_utilization_pct": F.when(F.col("k1") % 3 == 0, F.lit(150.0)).otherwise(F.col("gpu_utilization_pct")),
            "memory_utilization_pct": F.when(F.col("k1") % 50 == 0, F.lit(-5.0)).otherwise(F.col("memory_utilization_pct")),
            "temperature_c": F.col("temperature_c") * 3,
            "power_watts": F.col("power_watts") - 80,
        }
    )
    return _codes(checks.suitability_checks(df, "nrel_eagle"), "unit_range_check")


@query(
    "chk_07_no_valid_values",
    """SELECT 'no_valid_unit_values' AS code, 'warning' AS severity, 'ambient_c' AS feature, 0.0::DOUBLE AS value, CAST(NULL AS DOUBLE) AS threshold
    FROM (SELECT count(*) AS n FROM lineitem)""",
)
def no_valid_values(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn("ambient_c", F.lit("n/a"))
    return _codes(checks.suitability_checks(df, "nrel_eagle"), "no_valid_unit_values")


_EXPECTED = [("gpu_utilization_pct", "numeric"), ("temperature_c", "numeric"), ("mt", "categorical"), ("rack", "categorical")]


def _odd_input(spark, sf_dir):
    return readings(spark, sf_dir).select(F.col("dirty").alias("gpu_utilization_pct"), "mt", "dv", F.col("vl").alias("extra_value"))


def _named(df, check):
    return df.where(F.col("check") == check).select("feature", "feature_type", "check", F.col("input_value"), "severity")


@query(
    "chk_08_missing_feature",
    """SELECT unnest(['temperature_c', 'rack']) AS feature, unnest(['numeric', 'categorical']) AS feature_type, 'missing_feature' AS "check",
    CAST(NULL AS DOUBLE) AS input_value, 'warning' AS severity FROM (SELECT count(*) AS n FROM events)""",
)
def missing_feature(spark, sf_dir):
    return _named(drift.schema_checks(_odd_input(spark, sf_dir), _EXPECTED), "missing_feature")


@query(
    "chk_09_non_numeric",
    """SELECT 'gpu_utilization_pct' AS feature, 'numeric' AS feature_type, 'non_numeric_values' AS "check",
    CAST(count(*) AS DOUBLE) AS input_value, 'warning' AS severity FROM events WHERE event_id % 17 = 0""",
)
def non_numeric(spark, sf_dir):
    return _named(drift.schema_checks(_odd_input(spark, sf_dir), _EXPECTED), "non_numeric_values")


@query(
    "chk_10_extra_feature",
    """SELECT unnest(['dv', 'extra_value']) AS feature, 'extra' AS feature_type, 'extra_feature' AS "check",
    CAST(NULL AS DOUBLE) AS input_value, 'info' AS severity FROM (SELECT count(*) AS n FROM events)""",
)
def extra_feature(spark, sf_dir):
    return _named(drift.schema_checks(_odd_input(spark, sf_dir), _EXPECTED), "extra_feature")


def _report(spark, sf_dir, **limits):
    reference, later = cutoff_parts(spark, sf_dir)
    profile = drift.reference_profile(reference, list(FEATURES), _TEXT)
    return drift.drift_report(profile, later, categories=drift.value_counts(reference, _TEXT), **limits)


def _checked(df, *names):
    return df.where(F.col("check").isin(*names)).select(
        "feature", "feature_type", "check", F.round("reference_value", 6).alias("reference_value"),
        F.round("input_value", 6).alias("input_value"), "threshold", "severity",
    )


def _state(condition):
    return f"CASE WHEN {condition} THEN 'warning' ELSE 'ok' END"


_SMALL_SQL = """SELECT '__dataset__' AS feature, 'dataset' AS feature_type, 'small_input_sample' AS "check",
    CAST((SELECT count(*) FROM reference) AS DOUBLE) AS reference_value, CAST(count(*) AS DOUBLE) AS input_value,
    1000000.0::DOUBLE AS threshold, 'warning' AS severity FROM input HAVING count(*) < 1000000"""


@query("chk_11_small_input", tel(f", {PARTS_SQL} {_SMALL_SQL}"))
def small_input(spark, sf_dir):
    return _checked(_report(spark, sf_dir, min_rows=1_000_000), "small_input_sample")


def _missing_sql(columns, kind):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, '{kind}' AS feature_type, 'missing_rate_delta' AS "check", round(r, 6) AS reference_value, round(i, 6) AS input_value,
        0.2::DOUBLE AS threshold, {_state('i - r > 0.2')} AS severity
        FROM (SELECT (SELECT 1 - count({c}) / count(*) FROM reference) AS r, (SELECT 1 - count({c}) / count(*) FROM input) AS i)"""
        for c in columns
    )


_HOLED = """ , holed AS (SELECT * REPLACE (CASE WHEN second("timestamp") >= 0 AND day("timestamp") <= 12 THEN NULL ELSE ambient_c END AS ambient_c,
    CASE WHEN day("timestamp") <= 12 THEN NULL ELSE workload_type END AS workload_type) FROM input_all)"""
_PARTS_HOLED = PARTS_SQL.replace("input AS (", "input_all AS (") + _HOLED + ", input AS (SELECT * FROM holed)"


def _holed_report(spark, sf_dir):
    reference, later = cutoff_parts(spark, sf_dir)
    early = F.day("timestamp") <= 12
    holed = later.withColumns(
        {
            "ambient_c": F.when(~early, F.col("ambient_c")),
            "workload_type": F.when(~early, F.col("workload_type")),
            "memory_clock_mhz": F.lit(None).cast("double"),
        }
    )
    profile = drift.reference_profile(reference, list(FEATURES), _TEXT)
    return drift.drift_report(profile, holed)


@query("chk_12_missing_numeric", tel(f", {_PARTS_HOLED} {_missing_sql([c for c in FEATURES if c != 'memory_clock_mhz'], 'numeric')}"))
def missing_numeric(spark, sf_dir):
    df = _checked(_holed_report(spark, sf_dir), "missing_rate_delta")
    return df.where("feature_type = 'numeric' and feature <> 'memory_clock_mhz'")


@query(
    "chk_13_no_valid_numeric",
    tel(
        f""", {PARTS_SQL} SELECT 'memory_clock_mhz' AS feature, 'numeric' AS feature_type, 'no_valid_numeric_values' AS "check",
        CAST(count(memory_clock_mhz) AS DOUBLE) AS reference_value, 0.0::DOUBLE AS input_value, 1.0::DOUBLE AS threshold, 'warning' AS severity FROM reference"""
    ),
)
def no_valid_numeric(spark, sf_dir):
    return _checked(_holed_report(spark, sf_dir), "no_valid_numeric_values")


_SHIFT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, 'numeric' AS feature_type, 'mean_shift_std' AS "check", round(rm, 6) AS reference_value, round(im, 6) AS input_value,
    2.0::DOUBLE AS threshold, {_state('abs(im - rm) / greatest(rs, 1e-9) > 2.0')} AS severity
    FROM (SELECT (SELECT avg({c}) FROM reference) AS rm, (SELECT stddev_pop({c}) FROM reference) AS rs, (SELECT avg({c}) FROM input) AS im)"""
    for c in FEATURES
)


@query("chk_14_mean_shift", tel(f", {PARTS_SQL} {_SHIFT_SQL}"))
def mean_shift(spark, sf_dir):
    return _checked(_report(spark, sf_dir), "mean_shift_std")


_RANGE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, 'numeric' AS feature_type, 'outside_reference_range_share' AS "check", CAST(NULL AS DOUBLE) AS reference_value,
    round(avg(CASE WHEN {c} < lo OR {c} > hi THEN 1.0 ELSE 0.0 END), 6) AS input_value, 0.2::DOUBLE AS threshold,
    {_state(f'avg(CASE WHEN {c} < lo OR {c} > hi THEN 1.0 ELSE 0.0 END) > 0.2')} AS severity
    FROM input, (SELECT min({c}) AS lo, max({c}) AS hi FROM reference)"""
    for c in FEATURES
)


@query("chk_15_outside_range", tel(f", {PARTS_SQL} {_RANGE_SQL}"))
def outside_range(spark, sf_dir):
    return _checked(_report(spark, sf_dir), "outside_reference_range_share")


@query("chk_16_missing_categorical", tel(f", {_PARTS_HOLED} {_missing_sql(_TEXT, 'categorical')}"))
def missing_categorical(spark, sf_dir):
    return _checked(_holed_report(spark, sf_dir), "missing_rate_delta").where("feature_type = 'categorical'")


_UNSEEN_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, 'categorical' AS feature_type, 'unseen_category_share' AS "check",
    CAST((SELECT count(DISTINCT {c}) FROM reference) AS DOUBLE) AS reference_value,
    round(avg(CASE WHEN {c} IN (SELECT {c} FROM reference) THEN 0.0 ELSE 1.0 END), 6) AS input_value, 0.2::DOUBLE AS threshold,
    {_state(f'avg(CASE WHEN {c} IN (SELECT {c} FROM reference) THEN 0.0 ELSE 1.0 END) > 0.2')} AS severity FROM input"""
    for c in _TEXT
)


@query("chk_17_unseen_category", tel(f", {PARTS_SQL} {_UNSEEN_SQL}"))
def unseen_category(spark, sf_dir):
    return _checked(_report(spark, sf_dir), "unseen_category_share")


@query(
    "chk_17_many_categories",
    """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, o_orderdate < TIMESTAMP '1996-06-01' AS early FROM orders),
    known AS (SELECT DISTINCT customer FROM o WHERE early)
    SELECT 'customer' AS feature, (SELECT count(*) FROM known) > 100 AS truncated, CAST((SELECT count(*) FROM known) AS DOUBLE) AS reference_value,
    round(avg(CASE WHEN customer IN (SELECT customer FROM known) THEN 0.0 ELSE 1.0 END), 6) AS input_value FROM o WHERE NOT early""",
)
def many_categories(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    early = F.col("o_orderdate") < F.lit("1996-06-01").cast("timestamp_ntz")
    old, new = (orders.where(c).select(F.col("o_custkey").cast("string").alias("customer")) for c in (early, ~early))
    profile = drift.reference_profile(old, [], ["customer"])
    report = drift.drift_report(profile, new, categories=drift.value_counts(old, ["customer"]))
    found = report.where("check = 'unseen_category_share'").join(profile.select("feature", F.col("categories_truncated").alias("truncated")), "feature")
    return found.select("feature", "truncated", "reference_value", F.round("input_value", 6).alias("input_value"))


_EXTRA_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, 'extra' AS feature_type, 'extra_feature' AS "check", CAST(NULL AS DOUBLE) AS reference_value,
    CAST(NULL AS DOUBLE) AS input_value, CAST(NULL AS DOUBLE) AS threshold, 'info' AS severity FROM (SELECT count(*) AS n FROM input)"""
    for c in ("timestamp", "power_watts")
)
_DRIFT_SQL = " UNION ALL ".join(
    [_missing_sql(FEATURES, "numeric"), _missing_sql(_TEXT, "categorical"), _SHIFT_SQL, _RANGE_SQL, _UNSEEN_SQL, _EXTRA_SQL]
)


@query("chk_18_drift_report", tel(f", {PARTS_SQL} {_DRIFT_SQL}"))
def drift_report(spark, sf_dir):
    df = _report(spark, sf_dir)
    return _checked(df, *[
        "missing_rate_delta", "mean_shift_std", "outside_reference_range_share", "unseen_category_share", "extra_feature",
        "small_input_sample", "missing_feature", "non_numeric_values", "no_valid_numeric_values",
    ])


@query(
    "rpt_03_monitoring_summary",
    tel(
        f""", {PARTS_SQL}, r AS ({_DRIFT_SQL}) SELECT CASE WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS status,
        (SELECT count(*) FROM reference) AS reference_rows, count(*) FILTER (severity = 'warning') AS warning_count,
        coalesce(string_agg(feature || ': ' || "check", '; ' ORDER BY feature || ': ' || "check") FILTER (severity = 'warning'), '') AS warnings FROM r"""
    ),
)
def monitoring_summary(spark, sf_dir):
    reference, later = cutoff_parts(spark, sf_dir)
    profile = drift.reference_profile(reference, list(FEATURES), _TEXT)
    return drift.monitoring_summary(drift.drift_report(profile, later), profile)


@query(
    "jon_01_profile_join",
    tel(
        f""", {PARTS_SQL} """
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, count(*) AS input_rows, count({c}) AS input_count, round(avg({c}), 6) AS input_mean,
            (SELECT round(avg({c}), 6) FROM reference) AS reference_mean, (SELECT count({c}) FROM reference) AS reference_count FROM input"""
            for c in ("gpu_utilization_pct", "temperature_c")
        )
    ),
)
def profile_join(spark, sf_dir):
    reference, later = cutoff_parts(spark, sf_dir)
    profile = drift.reference_profile(reference, ["gpu_utilization_pct", "temperature_c", "ambient_c"], ["workload_type"])
    joined = drift.join_profile(drift.input_statistics(later, ["gpu_utilization_pct", "temperature_c"]), profile)
    return joined.select(
        "feature", "input_rows", "input_count", F.round("input_mean", 6).alias("input_mean"),
        F.round("mean", 6).alias("reference_mean"), F.col("count").alias("reference_count"),
    )


@query(
    "jon_02_unseen_values",
    tel(f", {PARTS_SQL} SELECT 'workload_type' AS feature, workload_type AS value, count(*) AS n FROM input WHERE workload_type NOT IN (SELECT workload_type FROM reference) GROUP BY 2"),
)
def unseen_values(spark, sf_dir):
    reference, later = cutoff_parts(spark, sf_dir)
    return drift.unseen_values(later, drift.reference_profile(reference, [], ["workload_type"]))


@query(
    "jon_03_column_difference",
    """SELECT 'temperature_c' AS feature, 'missing' AS side, CAST(NULL AS BIGINT) AS filled UNION ALL SELECT 'rack', 'missing', NULL
    UNION ALL SELECT 'dv', 'extra', count(user_id) FROM events UNION ALL SELECT 'extra_value', 'extra', count(value) FROM events""",
)
def column_sets(spark, sf_dir):
    # The difference of the names, with how many values each column that is there holds.
    df = _odd_input(spark, sf_dir)
    sides = column_difference(spark, [n for n, _ in _EXPECTED], df.columns)
    filled = column_stats(df, df.columns, lambda _, x: {"filled": F.count(x)}, lambda d, c: d[c].cast("string"))
    return sides.join(filled, "feature", "left")


@query(
    "jon_05_base_lookup",
    """SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 8 WHEN 2 THEN 42 WHEN 3 THEN 78 WHEN 4 THEN 62 WHEN 5 THEN 54 WHEN 6 THEN 84 END::DOUBLE AS gpu_base,
    CASE l_linenumber WHEN 1 THEN 15 WHEN 2 THEN 77 WHEN 3 THEN 43 WHEN 4 THEN 63 WHEN 5 THEN 57 WHEN 6 THEN 71 END::DOUBLE AS mem_base, count(*) AS "rows"
    FROM lineitem GROUP BY 1, 2, 3""",
)
def base_lookup(spark, sf_dir):
    labels = F.array(*[F.lit(k) for k in WORKLOAD_BASE])
    kind = F.get(labels, (F.col("l_linenumber") - 1).cast("int"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("kind", kind)
    gpu = lookup(F.col("kind"), {k: v[0] for k, v in WORKLOAD_BASE.items()})
    mem = lookup(F.col("kind"), {k: v[1] for k, v in WORKLOAD_BASE.items()})
    return li.groupBy("l_linenumber", gpu.alias("gpu_base"), mem.alias("mem_base")).agg(F.count("*").alias("rows"))


@query(
    "jon_06_union_by_name",
    tel(
        """ SELECT workload_type, count(*) AS "rows", count(CASE WHEN k1 % 2 = 0 THEN ambient_c END) AS with_ambient,
        count(CASE WHEN k1 % 2 = 1 THEN temperature_c END) AS with_temperature FROM telemetry GROUP BY 1"""
    ),
)
def union_by_name(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    even = t.where("k1 % 2 = 0").select("workload_type", "ambient_c")
    odd = t.where("k1 % 2 = 1").select("temperature_c", "workload_type")
    return concat_frames([even, odd]).groupBy("workload_type").agg(
        F.count("*").alias("rows"), F.count("ambient_c").alias("with_ambient"), F.count("temperature_c").alias("with_temperature")
    )
