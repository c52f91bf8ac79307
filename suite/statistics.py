"""Aggregates, reports and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.transforms import SCORE_SQL
from suite.views import FEATURES, KEYS, LEAKY_SQL, leaky, tel, telemetry
from wattline.functions import scalars
from wattline.operators import audit, checks, drift, metrics, quality


def scored(spark, sf_dir, model="workload_type"):
    """Telemetry scored by the analytic model; ``model`` names the column that plays the model's part."""
    return telemetry(spark, sf_dir).withColumn("prediction", scalars.analytic_power_of_row()).withColumn("model", F.col(model))


SCORED_SQL = f""", scored AS (SELECT *, {SCORE_SQL} AS prediction, workload_type AS model FROM telemetry)"""


def _r(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "agg_04_dataset_summary",
    tel(
        """ , sizes AS (SELECT session_id, count(*) AS n FROM telemetry GROUP BY 1)
        SELECT 'mit_supercloud' AS source, 'public_real_trace' AS data_kind, (SELECT count(*) FROM telemetry) AS n_rows,
        CAST(12 AS BIGINT) AS n_columns, CAST(9 AS BIGINT) AS n_numeric_columns, CAST(3 AS BIGINT) AS n_categorical_columns, true AS has_target,
        (SELECT count(*) FROM telemetry WHERE k1 % 13 <> 0) AS target_valid_rows,
        (SELECT round(avg(CASE WHEN k1 % 13 = 0 THEN 1 ELSE 0 END), 6) FROM telemetry) AS target_missing_rate,
        (SELECT round(min(power_watts), 6) FROM telemetry WHERE k1 % 13 <> 0) AS target_min,
        (SELECT round(max(power_watts), 6) FROM telemetry WHERE k1 % 13 <> 0) AS target_max,
        true AS has_timestamp, true AS has_session_id, count(*) AS unique_sessions, min(n) AS min_rows_per_session,
        median(n) AS median_rows_per_session, max(n) AS max_rows_per_session, count(*) >= 3 AND min(n) >= 20 AS grouped_validation_ready,
        CAST(8 AS BIGINT) AS recommended_columns_present, '' AS recommended_columns_missing FROM sizes"""
    ),
)
def dataset_summary(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn("power_watts", F.when(F.col("k1") % 13 != 0, F.col("power_watts")))
    return _r(checks.dataset_summary(df, "mit_supercloud"), ["target_missing_rate", "target_min", "target_max"])


@query(
    "agg_05_session_sizes",
    tel(
        """ , sizes AS (SELECT coalesce(CASE WHEN k1 % 4 <> 0 THEN session_id END, 'nan') AS s, count(*) AS n FROM telemetry GROUP BY 1)
        SELECT count(*) AS unique_sessions, min(n) AS min_rows_per_session, median(n) AS median_rows_per_session, max(n) AS max_rows_per_session FROM sizes"""
    ),
)
def session_sizes(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn("session_id", F.when(F.col("k1") % 4 != 0, F.col("session_id")))
    return quality.session_sizes(df)


@query(
    "agg_06_target_coverage",
    tel(
        """ SELECT count(y) AS target_valid_rows, round(avg(CASE WHEN y IS NULL THEN 1 ELSE 0 END), 6) AS target_missing_rate,
        round(min(y), 6) AS target_min, round(max(y), 6) AS target_max FROM (SELECT CASE WHEN k1 % 6 <> 0 THEN power_watts END AS y FROM telemetry)"""
    ),
)
def target_coverage(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn("power_watts", F.when(F.col("k1") % 6 != 0, F.col("power_watts")))
    return _r(quality.target_coverage(df), ["target_missing_rate", "target_min", "target_max"])


@query(
    "agg_07_target_quality",
    tel(
        """ SELECT count(power_watts) AS "count", CAST(count(*) - count(power_watts) AS BIGINT) AS missing_targets,
        round(min(power_watts), 6) AS "min", round(max(power_watts), 6) AS "max", round(avg(power_watts), 6) AS mean, round(median(power_watts), 6) AS median,
        round(quantile_cont(power_watts, 0.95), 6) AS p95, round(quantile_cont(power_watts, 0.99), 6) AS p99,
        round(quantile_cont(power_watts, 0.99) / greatest(median(power_watts), 1e-9), 6) AS outlier_ratio_p99_over_p50,
        max(power_watts) > 2000 OR quantile_cont(power_watts, 0.99) / greatest(median(power_watts), 1e-9) > 25 AS invalid_grouped_metric_risk
        FROM telemetry"""
    ),
)
def target_quality(spark, sf_dir):
    return _r(
        quality.target_quality(telemetry(spark, sf_dir)),
        ["min", "max", "mean", "median", "p95", "p99", "outlier_ratio_p99_over_p50"],
    )


_AUDITED = ["k1", "k2", *FEATURES, "target_copy", "constant", "board_power_like"]


@query(
    "agg_08_leakage_audit",
    tel(
        f""", {LEAKY_SQL} """
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, {'CAST(NULL AS DOUBLE)' if c == 'constant' else f'round(abs(corr("{c}", power_watts)), 6)'} AS abs_corr_with_target,
            {'true' if 'power' in c else 'false'} AS name_leakage_risk,
            {'min("constant") < 0' if c == 'constant' else f'abs(corr("{c}", power_watts)) > 0.995'} AS corr_leakage_risk FROM leaky"""
            for c in _AUDITED
        )
    ),
)
def leakage_audit(spark, sf_dir):
    return _r(audit.audit(leaky(spark, sf_dir)), ["abs_corr_with_target"])


@query(
    "agg_09_audit_totals",
    tel(
        f""", {LEAKY_SQL} SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_features_numeric, CAST(1 AS BIGINT) AS n_name_leakage_flags,
        CAST(CASE WHEN abs(corr(target_copy, power_watts)) > 0.995 THEN 1 ELSE 0 END AS BIGINT)
        + CAST(CASE WHEN abs(corr(graphics_clock_mhz, power_watts)) > 0.995 THEN 2 ELSE 0 END AS BIGINT) AS n_corr_leakage_flags FROM leaky"""
    ),
)
def audit_totals(spark, sf_dir):
    return audit.audit_totals(leaky(spark, sf_dir))


METRICS_SQL = """SELECT model, round(avg(abs(power_watts - prediction)), 6) AS mae, round(sqrt(avg((power_watts - prediction) ** 2)), 6) AS rmse,
    round(1 - sum((power_watts - prediction) ** 2) / (count(*) * var_pop(power_watts)), 6) AS r2 FROM scored GROUP BY model"""


@query("agg_10_regression_metrics", tel(f"{SCORED_SQL} {METRICS_SQL}"))
def regression_metrics(spark, sf_dir):
    return _r(metrics.regression_metrics(scored(spark, sf_dir)), ["mae", "rmse", "r2"])


@query(
    "agg_11_residuals",
    tel(
        f"""{SCORED_SQL} SELECT model, round(avg(power_watts - prediction), 6) AS residual_bias, round(stddev_pop(power_watts - prediction), 6) AS residual_std,
        round(quantile_cont(abs(power_watts - prediction), 0.95), 6) AS residual_p95_abs FROM scored GROUP BY 1"""
    ),
)
def residuals(spark, sf_dir):
    return _r(metrics.residual_diagnostics(scored(spark, sf_dir)), ["residual_bias", "residual_std", "residual_p95_abs"])


_PROFILE_COLUMNS = [*FEATURES]


@query(
    "agg_12_numeric_profile",
    tel(
        " , holes AS (SELECT * REPLACE (CASE WHEN k1 % 8 <> 0 THEN ambient_c END AS ambient_c) FROM telemetry) "
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, CAST({i} AS BIGINT) AS ordinal, count(*) AS row_count, count({c}) AS "count",
            round(1 - count({c}) / count(*), 6) AS missing_rate, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,
            round(min({c}), 6) AS "min", round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.5), 6) AS p50,
            round(quantile_cont({c}, 0.95), 6) AS p95, round(max({c}), 6) AS "max" FROM holes"""
            for i, c in enumerate(_PROFILE_COLUMNS)
        )
    ),
)
def numeric_profile(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn("ambient_c", F.when(F.col("k1") % 8 != 0, F.col("ambient_c")))
    p = drift.reference_profile(df, _PROFILE_COLUMNS, [])
    numbers = ["missing_rate", "mean", "std", "min", "p05", "p50", "p95", "max"]
    return p.select(
        "feature", F.col("ordinal").cast("bigint").alias("ordinal"), "row_count", "count", *[F.round(c, 6).alias(c) for c in numbers]
    )


@query(
    "agg_13_categorical_profile",
    tel(
        """ , cells AS (SELECT 'session_id' AS feature, session_id AS value FROM telemetry
          UNION ALL SELECT 'workload_type', CASE WHEN k1 % 8 <> 0 THEN workload_type END FROM telemetry
          UNION ALL SELECT 'order_id', CAST(k1 AS VARCHAR) FROM telemetry),
        counts AS (SELECT feature, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rn FROM counts),
        kept AS (SELECT feature, string_agg(value, ',' ORDER BY rn) AS categories FROM ranked WHERE rn <= 100 GROUP BY 1),
        tops AS (SELECT feature, string_agg(value || '=' || CAST(n AS VARCHAR), ',' ORDER BY rn) AS top_values FROM ranked WHERE rn <= 20 GROUP BY 1)
        SELECT c.feature, CAST(sum(n) AS BIGINT) AS "count", round(1 - sum(n) / (SELECT count(*) FROM telemetry), 6) AS missing_rate,
        count(*) AS unique_count, count(*) > 100 AS categories_truncated, any_value(categories) AS categories, any_value(top_values) AS top_values
        FROM counts c JOIN kept USING (feature) JOIN tops USING (feature) GROUP BY 1"""
    ),
)
def categorical_profile(spark, sf_dir):
    df = telemetry(spark, sf_dir).select(
        "session_id", F.when(F.col("k1") % 8 != 0, F.col("workload_type")).alias("workload_type"),
        F.col("k1").cast("string").alias("order_id"),
    )
    p = drift.categorical_profile(df, ["session_id", "workload_type", "order_id"])
    top = F.transform("top_values", lambda t: F.concat(t["value"], F.lit("="), t["count"].cast("string")))
    return p.select(
        "feature", "count", F.round("missing_rate", 6).alias("missing_rate"), "unique_count", "categories_truncated",
        F.array_join("categories", ",").alias("categories"), F.array_join(top, ",").alias("top_values"),
    )


def _results(spark, sf_dir):
    """Result rows per (fold, model): each session third plays a fold, each workload a model."""
    rows = scored(spark, sf_dir).withColumn("fold", F.col("k1") % 3 + 1)
    return metrics.regression_metrics(rows, ["fold", "model"])


RESULTS_SQL = """, results AS (SELECT k1 % 3 + 1 AS fold, model, avg(abs(power_watts - prediction)) AS mae, sqrt(avg((power_watts - prediction) ** 2)) AS rmse,
    1 - sum((power_watts - prediction) ** 2) / (count(*) * var_pop(power_watts)) AS r2 FROM scored GROUP BY 1, 2)"""


@query(
    "agg_14_cv_summary",
    tel(f"{SCORED_SQL}{RESULTS_SQL} SELECT model, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(r2), 6) AS r2 FROM results GROUP BY 1"),
)
def cv_summary(spark, sf_dir):
    return _r(metrics.cv_summary(_results(spark, sf_dir)), ["mae", "rmse", "r2"])


@query(
    "agg_15_best_per_group",
    tel(
        f"""{SCORED_SQL}{RESULTS_SQL} SELECT fold, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2
        FROM results QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rmse, model) = 1"""
    ),
)
def best_per_group(spark, sf_dir):
    return _r(metrics.best_per_group(_results(spark, sf_dir), "fold", ["model"]), ["mae", "rmse", "r2"])


@query(
    "agg_16_residual_histogram",
    tel(
        f"""{SCORED_SQL}, e AS (SELECT power_watts - prediction AS e FROM scored), s AS (SELECT min(e) AS lo, (max(e) - min(e)) / 40 AS w FROM e),
        c AS (SELECT CAST(least(floor((e - lo) / w), 39) AS BIGINT) AS bin, count(*) AS n FROM e, s GROUP BY 1)
        SELECT b AS bin, round(lo + b * w, 6) AS low, round(lo + (b + 1) * w, 6) AS high, coalesce(n, 0) AS "rows"
        FROM range(40) r(b) CROSS JOIN s LEFT JOIN c ON c.bin = b"""
    ),
)
def residual_histogram(spark, sf_dir):
    return _r(metrics.residual_histogram(scored(spark, sf_dir)), ["low", "high"])


@query(
    "agg_17_prediction_density",
    tel(
        f"""{SCORED_SQL} SELECT 'predicted_vs_actual' AS "view", CAST(floor(power_watts / 10.0) AS BIGINT) AS x_bin, CAST(floor(prediction / 10.0) AS BIGINT) AS y_bin, count(*) AS "rows" FROM scored GROUP BY 2, 3
        UNION ALL SELECT 'residual_vs_predicted', CAST(floor(prediction / 10.0) AS BIGINT), CAST(floor((power_watts - prediction) / 10.0) AS BIGINT), count(*) FROM scored GROUP BY 2, 3"""
    ),
)
def prediction_density(spark, sf_dir):
    return metrics.prediction_density(scored(spark, sf_dir))


@query(
    "agg_17_axis_range",
    tel(f"{SCORED_SQL} SELECT round(least(min(power_watts), min(prediction)), 6) AS axis_min, round(greatest(max(power_watts), max(prediction)), 6) AS axis_max FROM scored"),
)
def axis_range(spark, sf_dir):
    return _r(metrics.axis_range(scored(spark, sf_dir)), ["axis_min", "axis_max"])


@query(
    "agg_18_severity_rollup",
    tel(
        """ , o AS (SELECT avg(CASE WHEN k1 % 3 = 0 THEN 1.0 ELSE CASE WHEN gpu_utilization_pct > 100 THEN 1.0 ELSE 0.0 END END) AS share, count(*) AS n FROM telemetry),
        w AS (SELECT (CASE WHEN share > 0.05 THEN 1 ELSE 0 END) + (CASE WHEN n < 500 THEN 1 ELSE 0 END) + 2 AS warnings FROM o)
        SELECT CAST(0 AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings, 'warning' AS status FROM w"""
    ),
)
def severity(spark, sf_dir):
    # Two fixed warnings: generated-data mode and a recommended column that is gone.
    df = telemetry(spark, sf_dir).drop("memory_clock_mhz").withColumn(
        "gpu_utilization_pct", F.when(F.col("k1") % 3 == 0, F.lit(150.0)).otherwise(F.col("gpu_utilization_pct"))
    )
    return checks.severity_rollup(checks.suitability_checks(df, "synthetic"))


@query(
    "top_01_worst_targets",
    tel(
        """ SELECT session_id, "timestamp", round(power_watts, 6) AS power_watts, round(abs(power_watts), 6) AS _abs_target, k1, k2
        FROM telemetry ORDER BY abs(power_watts) DESC, k1, k2, "timestamp" LIMIT 20"""
    ),
)
def worst_targets(spark, sf_dir):
    return _r(quality.worst_target_rows(telemetry(spark, sf_dir), ["k1", "k2", "timestamp"]), ["power_watts", "_abs_target"])


@query(
    "top_02_worst_predictions",
    tel(
        f"""{SCORED_SQL} SELECT session_id, "timestamp", round(power_watts, 6) AS actual_power_watts, round(prediction, 6) AS pred_power_watts,
        round(abs(power_watts - prediction), 6) AS abs_error, k1, k2 FROM scored ORDER BY abs(power_watts - prediction) DESC, k1, k2 LIMIT 20"""
    ),
)
def worst_predictions(spark, sf_dir):
    df = quality.worst_predictions(scored(spark, sf_dir), list(KEYS))
    out = df.select("session_id", "timestamp", "actual_power_watts", "pred_power_watts", "abs_error", "k1", "k2")
    return _r(out, ["actual_power_watts", "pred_power_watts", "abs_error"])


@query(
    "top_03_leaderboard",
    tel(
        f"""{SCORED_SQL}, m AS ({METRICS_SQL}) SELECT model, mae, rmse, r2, row_number() OVER (ORDER BY rmse, model) AS rank FROM m"""
    ),
)
def leaderboard(spark, sf_dir):
    df = metrics.leaderboard(metrics.regression_metrics(scored(spark, sf_dir)))
    return _r(df, ["mae", "rmse", "r2"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("top_04_best_model", tel(f"{SCORED_SQL}, m AS ({METRICS_SQL}) SELECT model FROM m ORDER BY rmse, model LIMIT 1"))
def best_model(spark, sf_dir):
    return metrics.best_model(metrics.regression_metrics(scored(spark, sf_dir)))


@query(
    "top_05_importance",
    tel(
        """ SELECT session_id AS feature, round(abs(regr_slope(power_watts, gpu_utilization_pct)), 6) AS importance
        FROM telemetry GROUP BY 1 ORDER BY abs(regr_slope(power_watts, gpu_utilization_pct)) DESC, 1 LIMIT 15"""
    ),
)
def importance(spark, sf_dir):
    # The utilisation slope of each session stands in for one feature's importance.
    slopes = telemetry(spark, sf_dir).groupBy(F.col("session_id").alias("feature")).agg(
        F.abs(F.regr_slope("power_watts", "gpu_utilization_pct")).alias("importance")
    )
    return _r(metrics.top_importance(slopes), ["importance"])


@query(
    "top_06_ordered_results",
    tel(
        f"""{SCORED_SQL}{RESULTS_SQL} SELECT fold, model, round(rmse, 6) AS rmse, row_number() OVER (ORDER BY fold, rmse, model) AS position FROM results"""
    ),
)
def ordered_results(spark, sf_dir):
    from pyspark.sql import Window

    df = metrics.ordered_results(_results(spark, sf_dir), "fold", ["model"])
    # Result tables have one row per fold and model; the position makes the order visible.
    w = Window.orderBy("fold", "rmse", "model")
    return df.select("fold", "model", F.round("rmse", 6).alias("rmse"), F.row_number().over(w).cast("bigint").alias("position"))


@query(
    "rpt_02_metric_pairs",
    tel(
        f"""{SCORED_SQL}, m AS ({METRICS_SQL}) SELECT model || '_mae' AS key, mae AS value FROM m UNION ALL SELECT model || '_rmse', rmse FROM m
        UNION ALL SELECT model || '_r2', r2 FROM m"""
    ),
)
def metric_pairs(spark, sf_dir):
    return _r(metrics.metric_pairs(metrics.regression_metrics(scored(spark, sf_dir))), ["value"])
