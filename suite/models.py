"""Models, experiments, registry, scoring and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.splits import _FOLDS
from suite.statistics import METRICS_SQL, RESULTS_SQL, SCORED_SQL, _r, _results, scored
from suite.transforms import _ORDER, SCORE_SQL
from suite.views import FEATURES, KEYS, table, tel, telemetry
from wattline.functions.scalars import analytic_power_of_row
from wattline.operators import metrics, quality
from wattline.plans import experiments, importance, models, reports, run
from wattline.plans.attribution import base_value, ensemble_trees, mean_attribution, row_attributions
from wattline.plans.preprocessing import fit_preprocessor
from wattline.plans.registry import PowerModel, list_versions, model_metadata, save_bundle, version_index
from wattline.plans.scoring import prediction_rows, score
from wattline.session import spool_path
from wattline.sources.records import empty_requests, request_rows

NO_IDS = ("timestamp", "session_id", *KEYS)
SMALL = {
    "random_forest": {"n_estimators": 5, "max_depth": 6},
    "gradient_boosting": {"n_estimators": 5},
    "subsampled_boosting": {"n_estimators": 5},
}


@query(
    "ml_01_impute_scale",
    tel(
        """ , h AS (SELECT k1, k2, "timestamp", CASE WHEN k1 % 4 <> 0 THEN gpu_utilization_pct END AS u, ambient_c AS a FROM telemetry),
        f AS (SELECT *, coalesce(u, (SELECT median(u) FROM h)) AS uf FROM h),
        s AS (SELECT avg(uf) AS um, stddev_pop(uf) AS us, avg(a) AS am, stddev_pop(a) AS "as" FROM f)
        SELECT k1, k2, round((uf - um) / us, 6) AS u, round((a - am) / s."as", 6) AS a FROM f, s"""
    ),
)
def impute_scale(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn("gpu_utilization_pct", F.when(F.col("k1") % 4 != 0, F.col("gpu_utilization_pct")))
    pre = fit_preprocessor(df, ["gpu_utilization_pct", "ambient_c"], [])
    out = pre.transform(df)
    return out.select("k1", "k2", F.round("num__gpu_utilization_pct", 6).alias("u"), F.round("num__ambient_c", 6).alias("a"))


@query(
    "ml_01_one_hot",
    tel(
        """ , w AS (SELECT CASE WHEN k1 % 3 = 0 THEN NULL ELSE workload_type END AS w FROM telemetry),
        top AS (SELECT w FROM w WHERE w IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, w LIMIT 1),
        filled AS (SELECT coalesce(w, (SELECT w FROM top)) AS w FROM w)
        SELECT 'cat__workload_type_' || w AS slot, count(*) AS "rows" FROM filled GROUP BY 1"""
    ),
)
def one_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = telemetry(spark, sf_dir).withColumn("workload_type", F.when(F.col("k1") % 3 != 0, F.col("workload_type")))
    pre = fit_preprocessor(df, [], ["workload_type"])
    long = pre.transform(df).select(F.posexplode(vector_to_array("features")).alias("i", "hot"))
    names = spark.createDataFrame(list(enumerate(pre.slots)), "i int, slot string")
    counts = long.groupBy("i").agg(F.sum("hot").cast("bigint").alias("rows"))
    return counts.join(F.broadcast(names), "i").select("slot", "rows")


def _fit(spark, sf_dir, name, features, params=None):
    df = telemetry(spark, sf_dir)
    pre, model = models.fit_rows(df, name, features, params=params)
    return df, pre, model


@query(
    "ml_02_linear_one_feature",
    tel(" SELECT round(regr_slope(power_watts, gpu_utilization_pct), 6) AS slope, round(regr_intercept(power_watts, gpu_utilization_pct), 5) AS intercept FROM telemetry"),
)
def linear_one(spark, sf_dir):
    _, pre, model = _fit(spark, sf_dir, "linear_regression", ["gpu_utilization_pct"])
    slope = float(model.coefficients[0]) / pre.scales["gpu_utilization_pct"]
    intercept = model.intercept - slope * pre.means["gpu_utilization_pct"]
    return spark.createDataFrame([(round(slope, 6), round(intercept, 5))], "slope double, intercept double")


@query(
    "ml_02_linear_two_features",
    tel(
        """ , m AS (SELECT var_pop(gpu_utilization_pct) AS xx, var_pop(memory_utilization_pct) AS zz, covar_pop(gpu_utilization_pct, memory_utilization_pct) AS xz,
          covar_pop(gpu_utilization_pct, power_watts) AS xy, covar_pop(memory_utilization_pct, power_watts) AS zy,
          avg(gpu_utilization_pct) AS x, avg(memory_utilization_pct) AS z, avg(power_watts) AS y FROM telemetry),
        b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz, x, z, y FROM m)
        SELECT k1, k2, round(y + bx * (gpu_utilization_pct - x) + bz * (memory_utilization_pct - z), 4) AS prediction FROM telemetry, b"""
    ),
)
def linear_two(spark, sf_dir):
    df, pre, model = _fit(spark, sf_dir, "linear_regression", ["gpu_utilization_pct", "memory_utilization_pct"])
    return model.transform(pre.transform(df)).select("k1", "k2", F.round("prediction", 4).alias("prediction"))


def _tree_metrics(spark, sf_dir, name):
    df, pre, model = _fit(spark, sf_dir, name, list(FEATURES))
    rows = model.transform(pre.transform(df)).withColumn("model", F.lit(name))
    return _r(metrics.regression_metrics(rows), ["mae", "rmse", "r2"])


@query("ml_03_random_forest")
def random_forest(spark, sf_dir):
    return _tree_metrics(spark, sf_dir, "random_forest")


@query(
    "ml_01_one_hot_many",
    """SELECT l_orderkey AS k1, CAST(dense_rank() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS DOUBLE) AS slot,
    (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS slots, count(*) AS "rows" FROM lineitem GROUP BY 1""",
)
def one_hot_many(spark, sf_dir):
    # One slot per order: over 10,000 from sf0.01 on.
    df = telemetry(spark, sf_dir).select("k1", F.col("k1").cast("string").alias("order"))
    pre = fit_preprocessor(df, [], ["order"])
    out = pre.transform(df).groupBy("k1", F.col("ix__order").alias("slot")).agg(F.count("*").alias("rows"))
    return out.withColumn("slots", F.lit(pre.width).cast("bigint"))


@query("ml_04_gradient_boosting")
def gradient_boosting(spark, sf_dir):
    return _tree_metrics(spark, sf_dir, "gradient_boosting")


@query("ml_05_subsampled_boosting")
def subsampled_boosting(spark, sf_dir):
    return _tree_metrics(spark, sf_dir, "subsampled_boosting")


# On the workload label alone every model's best answer is the label's mean, which
# one tree on all rows, boosted trees and least squares on dummies all reach exactly.
_LABEL_ONLY = ("timestamp", "session_id", *KEYS, *FEATURES)
_LABEL_PARAMS = {
    "random_forest": {"n_estimators": 1, "max_depth": 6, "bootstrap": False},
    "gradient_boosting": {"n_estimators": 3, "max_depth": 6},
}
_GROUP_MEANS = " SELECT workload_type, count(*) AS \"rows\", round(avg(power_watts), 5) AS prediction FROM telemetry GROUP BY 1"


def _label_predictions(spark, sf_dir, name):
    df = telemetry(spark, sf_dir)
    pipeline, _, _ = models.fit_full_pipeline(df, name, _LABEL_PARAMS[name], exclude=_LABEL_ONLY)
    out = pipeline.transform(df)
    return out.groupBy("workload_type").agg(
        F.count("*").alias("rows"), F.round(F.avg("prediction"), 5).alias("prediction")
    )


@query("ml_03_forest_label_means", tel(_GROUP_MEANS))
def forest_label_means(spark, sf_dir):
    return _label_predictions(spark, sf_dir, "random_forest")


@query("ml_04_boosting_label_means", tel(_GROUP_MEANS))
def boosting_label_means(spark, sf_dir):
    return _label_predictions(spark, sf_dir, "gradient_boosting")


def _label_metrics_sql(columns, names):
    """Held-out metrics of the label mean of the training rows, for each name."""
    listed = " UNION ALL ".join(f"SELECT {n}" for n in names)
    return tel(
        f""" , t AS (SELECT workload_type, power_watts AS y, row_number() OVER (ORDER BY {_ORDER}) <= floor(0.8 * count(*) OVER ()) AS tr FROM telemetry),
        m AS (SELECT workload_type, avg(y) AS p FROM t WHERE tr GROUP BY 1), s AS (SELECT y, p FROM t JOIN m USING (workload_type) WHERE NOT tr),
        r AS (SELECT round(avg(abs(y - p)), 5) AS mae, round(sqrt(avg((y - p) ** 2)), 5) AS rmse,
          round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 5) AS r2, round(quantile_cont(abs(y - p), 0.95), 5) AS residual_p95_abs FROM s)
        SELECT n.*, {columns} FROM r, ({listed}) n"""
    )


@query("ml_06_three_models", _label_metrics_sql("mae, rmse, r2", [f"'{m}' AS model" for m in models.DEFAULT_MODELS]))
def three_models(spark, sf_dir):
    done = models.train_and_evaluate(
        telemetry(spark, sf_dir), models.DEFAULT_MODELS, _LABEL_PARAMS, None, _LABEL_ONLY, "time", 0.2, 42, KEYS
    )
    return _r(done.metrics.drop("rank"), ["mae", "rmse", "r2"], 5)


def _train(spark, sf_dir, names=models.DEFAULT_MODELS, strategy="time"):
    return models.train_and_evaluate(
        telemetry(spark, sf_dir), names, None, None, NO_IDS, strategy, 0.2, 42, KEYS
    )


@query("ml_06_train_and_evaluate")
def train_and_evaluate(spark, sf_dir):
    return _r(_train(spark, sf_dir).metrics, ["mae", "rmse", "r2"])


_HELD = f""", ranked AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) <= floor(0.8 * count(*) OVER ()) AS is_train FROM telemetry)"""


@query(
    "ml_06_linear_held_out",
    tel(
        f"""{_HELD}, b AS (SELECT regr_slope(power_watts, gpu_utilization_pct) AS s, regr_intercept(power_watts, gpu_utilization_pct) AS i FROM ranked WHERE is_train),
        p AS (SELECT power_watts, i + s * gpu_utilization_pct AS prediction FROM ranked, b WHERE NOT is_train)
        SELECT 'linear_regression' AS model, round(avg(abs(power_watts - prediction)), 5) AS mae, round(sqrt(avg((power_watts - prediction) ** 2)), 5) AS rmse,
        round(1 - sum((power_watts - prediction) ** 2) / (count(*) * var_pop(power_watts)), 5) AS r2, count(*) AS "rows" FROM p"""
    ),
)
def linear_held_out(spark, sf_dir):
    done = models.train_and_evaluate(
        telemetry(spark, sf_dir), ["linear_regression"], None, ["gpu_utilization_pct"], NO_IDS, "time", 0.2, 42, KEYS
    )
    n = done.predictions.count()
    return _r(done.metrics.select("model", "mae", "rmse", "r2"), ["mae", "rmse", "r2"], 5).withColumn("rows", F.lit(n).cast("bigint"))


@query(
    "ml_07_full_refit",
    tel(" SELECT count(*) AS \"rows\", round(sum(power_watts), 2) AS predicted_total FROM telemetry"),
)
def full_refit(spark, sf_dir):
    # Least squares with an intercept reproduces the total of the target exactly.
    df = telemetry(spark, sf_dir)
    pipeline, _, _ = models.fit_full_pipeline(df, "linear_regression", exclude=NO_IDS)
    return pipeline.transform(df).agg(F.count("*").alias("rows"), F.round(F.sum("prediction"), 2).alias("predicted_total"))


@query("ml_08_model_importance")
def model_importance(spark, sf_dir):
    return _r(models.importances(_train(spark, sf_dir)), ["importance"])


@query(
    "ml_08_linear_importance",
    tel(
        f"""{_HELD} SELECT 'linear_regression' AS model, 'num__gpu_utilization_pct' AS feature,
        round(abs(regr_slope(power_watts, gpu_utilization_pct)) * stddev_pop(gpu_utilization_pct), 5) AS importance FROM ranked WHERE is_train"""
    ),
)
def linear_importance(spark, sf_dir):
    done = models.train_and_evaluate(
        telemetry(spark, sf_dir), ["linear_regression"], None, ["gpu_utilization_pct"], NO_IDS, "time", 0.2, 42, KEYS
    )
    return _r(models.importances(done), ["importance"], 5)


@query(
    "ml_09_permutation_importance",
    tel(
        f""" , idx AS (SELECT *, row_number() OVER (ORDER BY k1, k2, "timestamp", {_ORDER.split('k2, ', 1)[1]}) - 1 AS i FROM telemetry),
        many AS (SELECT idx.*, r, substr(md5('42:' || CAST(r AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 15) AS h FROM idx, range(8) t(r)),
        blocked AS (SELECT *, CAST('0x' || h AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM telemetry) / 50000.0) AS BIGINT)) AS block FROM many),
        nxt AS (SELECT *, coalesce(lead(gpu_utilization_pct) OVER w, first_value(gpu_utilization_pct) OVER w) AS u2,
          coalesce(lead(temperature_c) OVER w, first_value(temperature_c) OVER w) AS t2 FROM blocked WINDOW w AS (PARTITION BY r, block ORDER BY h, i)),
        base AS (SELECT sqrt(avg((power_watts - ({SCORE_SQL})) ** 2)) AS rmse FROM telemetry),
        per AS (SELECT 'gpu_utilization_pct' AS feature, r, sqrt(avg((power_watts - ({SCORE_SQL.replace('gpu_utilization_pct', 'u2')})) ** 2)) AS rmse FROM nxt GROUP BY r
          UNION ALL SELECT 'temperature_c', r, sqrt(avg((power_watts - ({SCORE_SQL.replace('temperature_c', 't2')})) ** 2)) FROM nxt GROUP BY r)
        SELECT feature, round(avg(per.rmse - base.rmse), 6) AS importance FROM per, base GROUP BY 1"""
    ),
)
def permutation(spark, sf_dir):
    scorer = importance.column_scorer(analytic_power_of_row())
    found = importance.permutation_importance(
        telemetry(spark, sf_dir), scorer, ["gpu_utilization_pct", "temperature_c"], [*KEYS, "timestamp"]
    )
    return _r(found, ["importance"])


@query("ml_10_mean_attribution")
def attribution(spark, sf_dir):
    df, pre, model = _fit(spark, sf_dir, "random_forest", list(FEATURES), {"n_estimators": 5, "max_depth": 5})
    out = mean_attribution(model, pre.transform(df), pre.slots, "random_forest", KEYS)
    return _r(out, ["mean_abs_attribution"])


@query(
    "ml_10_attribution_additivity",
    tel(" SELECT count(*) AS \"rows\", count(*) AS additive FROM telemetry"),
)
def additivity(spark, sf_dir):
    # Attributions plus the base value add up to the prediction on every row.
    df, pre, model = _fit(spark, sf_dir, "gradient_boosting", list(FEATURES), {"n_estimators": 3})
    trees = ensemble_trees(model)
    rows = row_attributions(model, model.transform(pre.transform(df)), ["prediction"], trees)
    total = F.aggregate("attribution", F.lit(base_value(trees)), lambda a, b: a + b)
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.abs(total - F.col("prediction")) < 1e-6).alias("additive"))


@query(
    "ml_10_one_split",
    tel(
        """ , t AS (SELECT CAST(k1 % 2 AS DOUBLE) AS odd, power_watts AS y FROM telemetry), m AS (SELECT avg(y) AS every FROM t),
        p AS (SELECT odd, count(*) AS n, avg(y) AS y FROM t GROUP BY 1)
        SELECT 'num__odd' AS feature, round(sum(n * abs(y - every)) / sum(n), 6) AS mean_abs_attribution, 'one_split' AS model, CAST(sum(n) AS BIGINT) AS sample_rows FROM p, m
        UNION ALL SELECT 'num__flat', 0.0, 'one_split', count(*) FROM t"""
    ),
)
def one_split(spark, sf_dir):
    # A tree of one split gives a row the distance of its side's mean from the mean of all.
    df = telemetry(spark, sf_dir).select("power_watts", (F.col("k1") % 2).cast("double").alias("odd"), F.lit(1.0).alias("flat"))
    pre = fit_preprocessor(df, ["odd", "flat"], [])
    model = models.make_regressor("random_forest", 2, {"n_estimators": 1, "max_depth": 1, "bootstrap": False}).fit(pre.transform(df))
    return _r(mean_attribution(model, pre.transform(df), pre.slots, "one_split"), ["mean_abs_attribution"])


@query("exp_01_feature_ablation")
def ablation(spark, sf_dir):
    found, _, _ = experiments.feature_ablation(
        telemetry(spark, sf_dir), ["linear_regression", "gradient_boosting"], SMALL, "time", keys=KEYS, exclude=NO_IDS
    )
    return _r(found, ["mae", "rmse", "r2", "residual_bias", "residual_std", "residual_p95_abs"])


_SWEEP = {
    "random_forest": {"n_estimators": [3, 5], "max_depth": [4, 6], "min_samples_leaf": [1, 2]},
    "gradient_boosting": {"n_estimators": [2, 3], "learning_rate": [0.03, 0.05], "max_depth": [2, 3]},
}


def _two_features(spark, sf_dir):
    return telemetry(spark, sf_dir).select(*KEYS, "timestamp", "session_id", "gpu_utilization_pct", "ambient_c", "power_watts")


_ORDER2 = '"timestamp", k1, k2, session_id, gpu_utilization_pct, ambient_c, power_watts'
_METRIC2 = """round(avg(abs(y - p)), 5) AS mae, round(sqrt(avg((y - p) ** 2)), 5) AS rmse,
    round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 5) AS r2"""


@query(
    "exp_01_ablation_linear",
    tel(
        f""" , t AS (SELECT gpu_utilization_pct AS x, ambient_c AS z, power_watts AS y, row_number() OVER (ORDER BY {_ORDER2}) <= floor(0.8 * count(*) OVER ()) AS tr FROM telemetry),
        m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM t WHERE tr),
        duo AS (SELECT y, my + (xy * zz - zy * xz) / (xx * zz - xz * xz) * (x - mx) + (zy * xx - xy * xz) / (xx * zz - xz * xz) * (z - mz) AS p FROM t, m WHERE NOT tr),
        gpu AS (SELECT y, my + xy / xx * (x - mx) AS p FROM t, m WHERE NOT tr), sys AS (SELECT y, my + zy / zz * (z - mz) AS p FROM t, m WHERE NOT tr),
        a AS (SELECT 'all_features' AS feature_set, CAST(2 AS BIGINT) AS feature_count, y, p FROM duo UNION ALL SELECT 'gpu_plus_thermal', 2, y, p FROM duo
          UNION ALL SELECT 'gpu_only', 1, y, p FROM gpu UNION ALL SELECT 'system_only', 1, y, p FROM sys)
        SELECT feature_set, 'linear_regression' AS model, {_METRIC2}, round(avg(y - p), 5) AS residual_bias, round(stddev_pop(y - p), 5) AS residual_std,
        round(quantile_cont(abs(y - p), 0.95), 5) AS residual_p95_abs, feature_count FROM a GROUP BY 1, feature_count"""
    ),
)
def ablation_linear(spark, sf_dir):
    found, _, _ = experiments.feature_ablation(
        _two_features(spark, sf_dir), ["linear_regression"], None, "time", keys=KEYS, exclude=NO_IDS
    )
    return _r(found, ["mae", "rmse", "r2", "residual_bias", "residual_std", "residual_p95_abs"], 5)


_LINE = """f AS (SELECT part, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM rows_ WHERE NOT te GROUP BY 1),
    q AS (SELECT r.part, y, i + s * x AS p FROM rows_ r JOIN f USING (part) WHERE te)"""


@query(
    "exp_03_splits_linear",
    tel(
        f""" , t AS (SELECT gpu_utilization_pct AS x, power_watts AS y, session_id,
          row_number() OVER (ORDER BY "timestamp", k1, k2, session_id, gpu_utilization_pct, power_watts) > floor(0.8 * count(*) OVER ()) AS by_time,
          row_number() OVER (ORDER BY substr(md5('42:' || CAST(k1 AS VARCHAR) || ':' || CAST(k2 AS VARCHAR)), 1, 15), k1, k2, "timestamp", session_id, gpu_utilization_pct, power_watts) <= ceil(0.2 * count(*) OVER ()) AS by_hash
          FROM telemetry),
        g AS (SELECT session_id, row_number() OVER (ORDER BY substr(md5('42:' || session_id), 1, 15), session_id) <= ceil(0.2 * count(*) OVER ()) AS held FROM (SELECT DISTINCT session_id FROM telemetry)),
        rows_ AS (SELECT 'time' AS part, x, y, by_time AS te FROM t UNION ALL SELECT 'random', x, y, by_hash FROM t UNION ALL SELECT 'grouped', x, y, held FROM t JOIN g USING (session_id)),
        {_LINE} SELECT part AS split_strategy, 'linear_regression' AS model, {_METRIC2} FROM q GROUP BY 1"""
    ),
)
def splits_linear(spark, sf_dir):
    df = _two_features(spark, sf_dir).drop("ambient_c")
    found, _ = experiments.split_comparison(df, ["linear_regression"], keys=KEYS, exclude=NO_IDS)
    return _r(found, ["mae", "rmse", "r2"], 5)


@query(
    "exp_04_cv_linear",
    tel(
        f"""{_FOLDS}, k AS (SELECT unnest([1, 2, 3]) AS part), rows_ AS (SELECT part, gpu_utilization_pct AS x, power_watts AS y, fold = part AS te FROM telemetry JOIN folds USING (session_id), k),
        {_LINE} SELECT CAST(part AS BIGINT) AS fold, 'linear_regression' AS model, {_METRIC2} FROM q GROUP BY 1"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def cv_linear(spark, sf_dir):
    df = _two_features(spark, sf_dir).drop("ambient_c")
    found, _ = experiments.grouped_blocked_cv(df, ["linear_regression"], exclude=NO_IDS)
    return _r(found, ["mae", "rmse", "r2"], 5)


@query("exp_02_sweep")
def sweep(spark, sf_dir):
    found, _ = experiments.hyperparameter_sweep(telemetry(spark, sf_dir), _SWEEP, "time", keys=KEYS, exclude=NO_IDS)
    return _r(found, ["mae", "rmse", "r2", "residual_p95_abs"])


_LABEL_SWEEP = {
    "random_forest": {"bootstrap": [False], "n_estimators": [1], "max_depth": [5, 6], "min_samples_leaf": [1, 2]},
    "gradient_boosting": {"n_estimators": [1, 2], "learning_rate": [0.03, 0.05], "max_depth": [5]},
}


@query(
    "exp_02_sweep_label_means",
    _label_metrics_sql(
        "mae, rmse, r2, residual_p95_abs",
        [
            *[f"'random_forest' AS model, 'bootstrap=False, max_depth={d}, min_samples_leaf={k}, n_estimators=1' AS params" for d in (5, 6) for k in (1, 2)],
            *[f"'gradient_boosting', 'learning_rate={r}, max_depth=5, n_estimators={n}'" for r in (0.03, 0.05) for n in (1, 2)],
        ],
    ),
)
def sweep_label_means(spark, sf_dir):
    found, _ = experiments.hyperparameter_sweep(telemetry(spark, sf_dir), _LABEL_SWEEP, "time", keys=KEYS, exclude=_LABEL_ONLY)
    return _r(found, ["mae", "rmse", "r2", "residual_p95_abs"], 5)


@query("exp_03_split_comparison")
def split_comparison(spark, sf_dir):
    found, _ = experiments.split_comparison(
        telemetry(spark, sf_dir), ["linear_regression", "random_forest"], SMALL, keys=KEYS, exclude=NO_IDS
    )
    return _r(found, ["mae", "rmse", "r2"])


@query("exp_04_grouped_cv")
def grouped_cv(spark, sf_dir):
    found, _ = experiments.grouped_blocked_cv(telemetry(spark, sf_dir), params=SMALL, exclude=NO_IDS)
    return _r(found, ["mae", "rmse", "r2"])


_FAST = run.RunOptions(
    models=("linear_regression", "random_forest"), params=SMALL, keys=KEYS, exclude=NO_IDS, permutation=False, validation=True
)


@query("exp_06_end_to_end")
def end_to_end(spark, sf_dir):
    tables, _ = run.run_experiment(telemetry(spark, sf_dir), "mit_supercloud", _FAST)
    card = tables["scorecard"]
    return _r(card, ["primary_mae", "primary_rmse", "primary_r2", "random_rmse", "time_rmse"])


def _bundle(spark, sf_dir):
    df = telemetry(spark, sf_dir)
    registry = spool_path(spark, "registry")
    pipeline, numbers, texts = models.fit_full_pipeline(df, "linear_regression", exclude=NO_IDS)
    metadata = model_metadata(spark, "linear_regression", numbers, texts, {"rmse": 1.0}, "time", "mit_supercloud", "20250101T000000Z")
    save_bundle(spark, pipeline, metadata, registry)
    return df, registry


@query(
    "reg_01_bundle_round_trip",
    tel(" SELECT count(*) AS \"rows\", round(sum(power_watts), 2) AS predicted_total FROM telemetry"),
)
def bundle_round_trip(spark, sf_dir):
    df, registry = _bundle(spark, sf_dir)
    model = PowerModel.from_registry(spark, registry, "linear_regression")
    return model.predict(df).agg(F.count("*").alias("rows"), F.round(F.sum("prediction"), 2).alias("predicted_total"))


@query(
    "reg_02_version_index",
    """SELECT model, version, version = max(version) OVER (PARTITION BY model) AS is_latest
    FROM (SELECT DISTINCT l_returnflag AS model, strftime(l_shipdate, '%Y%m%dT%H%M%SZ') AS version FROM lineitem)""",
)
def versions(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss'Z'").alias("version")
    )
    return version_index(entries)


@query(
    "reg_03_resolve_latest",
    "SELECT 'linear_regression' AS model, '20250101T000000Z' AS version, count(*) > 0 AS is_latest FROM lineitem",
)
def resolve_latest(spark, sf_dir):
    _, registry = _bundle(spark, sf_dir)
    return list_versions(spark, registry)


@query(
    "scr_01_batch_predict",
    tel(
        """ , b AS (SELECT regr_slope(power_watts, gpu_utilization_pct) AS s, regr_intercept(power_watts, gpu_utilization_pct) AS i FROM telemetry)
        SELECT workload_type, count(*) AS "rows", round(avg(i + s * coalesce(CASE WHEN k1 % 5 <> 0 THEN gpu_utilization_pct END, (SELECT median(gpu_utilization_pct) FROM telemetry))), 4) AS mean_prediction
        FROM telemetry, b GROUP BY 1"""
    ),
)
def batch_predict(spark, sf_dir):
    df = telemetry(spark, sf_dir)
    registry = spool_path(spark, "registry")
    keep = [c for c in df.columns if c not in ("gpu_utilization_pct", "power_watts")]
    pipeline, numbers, texts = models.fit_full_pipeline(df, "linear_regression", exclude=keep)
    save_bundle(spark, pipeline, model_metadata(spark, "linear_regression", numbers, texts, {}, "time", "mit_supercloud", "v1"), registry)
    inputs = df.select("workload_type", F.when(F.col("k1") % 5 != 0, F.col("gpu_utilization_pct")).cast("string").alias("gpu_utilization_pct"))
    out = PowerModel.from_registry(spark, registry, "linear_regression").predict(inputs, keep=["workload_type"])
    return out.groupBy("workload_type").agg(F.count("*").alias("rows"), F.round(F.avg("prediction"), 4).alias("mean_prediction"))


@query(
    "scr_02_prediction_rows",
    tel(
        f""" SELECT row_number() OVER (ORDER BY k1, k2, "timestamp", session_id, power_watts, {SCORE_SQL}) - 1 AS "index", round({SCORE_SQL}, 6) AS predicted_power_watts FROM telemetry"""
    ),
)
def scored_rows(spark, sf_dir):
    rows = score(telemetry(spark, sf_dir), analytic_power_of_row())
    out = prediction_rows(rows, [*KEYS, "timestamp", "session_id", "power_watts"])
    return _r(out, ["predicted_power_watts"])


@query(
    "scr_03_request_schema",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, value AS gpu_utilization_pct, event_type AS workload_type,
    CAST(NULL AS DOUBLE) AS temperature_c FROM events""",
)
def request_schema(spark, sf_dir):
    record = F.struct(
        F.col("value").alias("gpu_utilization_pct"), F.col("event_type").alias("workload_type"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    payload = F.to_json(F.struct(F.array(record).alias("records")))
    rows = request_rows(table(spark, sf_dir, "events").select("event_id", payload.alias("value")))
    return rows.select("event_id", F.col("extras")["k"].alias("k"), "gpu_utilization_pct", "workload_type", "temperature_c")


@query("scr_03_invalid_requests", "SELECT event_type, count(*) AS \"rows\" FROM events WHERE event_id % 3 <> 1 GROUP BY 1")
def invalid_requests(spark, sf_dir):
    payload = F.when(F.col("event_id") % 3 == 0, '{"records": []}').when(F.col("event_id") % 3 == 1, '{"records": [{}]}').otherwise("{}")
    return empty_requests(table(spark, sf_dir, "events").withColumn("value", payload)).groupBy("event_type").agg(F.count("*").alias("rows"))


@query(
    "rpt_01_scorecard",
    tel(
        f"""{SCORED_SQL}{RESULTS_SQL}, m AS ({METRICS_SQL}), cv AS (SELECT model, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2 FROM results GROUP BY 1),
        p AS (SELECT * FROM cv ORDER BY rmse, model LIMIT 1),
        sb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rmse, model) AS i FROM results) WHERE i = 1),
        one AS (SELECT * FROM results ORDER BY rmse, model LIMIT 1), r AS (SELECT * FROM sb WHERE fold = 1), t AS (SELECT * FROM sb WHERE fold = 2),
        q AS (SELECT max(power_watts) > 2000 OR quantile_cont(power_watts, 0.99) / greatest(median(power_watts), 1e-9) > 25 AS risk FROM telemetry)
        SELECT (SELECT model FROM m ORDER BY rmse, model LIMIT 1) AS best_model, p.model AS primary_model, round(p.mae, 6) AS primary_mae,
        round(p.rmse, 6) AS primary_rmse, round(p.r2, 6) AS primary_r2,
        round(r.mae, 6) AS random_mae, round(r.rmse, 6) AS random_rmse, round(r.r2, 6) AS random_r2,
        round(t.mae, 6) AS time_mae, round(t.rmse, 6) AS time_rmse, round(t.r2, 6) AS time_r2,
        CASE one.fold WHEN 1 THEN 'random' WHEN 2 THEN 'time' ELSE 'grouped' END AS ablation_set, one.model AS ablation_model, round(one.rmse, 6) AS ablation_rmse,
        one.model AS sweep_model, 'fold=' || one.fold AS sweep_params, round(one.rmse, 6) AS sweep_rmse,
        risk AS target_risk, risk OR p.r2 < -1 OR p.rmse > 5000 AS grouped_metrics_suspect FROM p, r, t, one, q"""
    ),
)
def scorecard(spark, sf_dir):
    results = _results(spark, sf_dir)
    best = metrics.best_per_group(results, "fold", ["model"]).withColumn(
        "split_strategy", F.when(F.col("fold") == 1, "random").when(F.col("fold") == 2, "time").otherwise("grouped")
    )
    card = reports.run_scorecard(
        metrics.regression_metrics(scored(spark, sf_dir)), metrics.cv_summary(results), best,
        quality.target_quality(telemetry(spark, sf_dir)),
        best.withColumn("feature_set", F.col("split_strategy")),
        metrics.best_per_group(results, "model", ["fold"]).withColumn("params", F.concat(F.lit("fold="), F.col("fold").cast("string"))),
    )
    card = card.drop("name_leakage_flags", "corr_leakage_flags")  # the audit has keys of its own
    return _r(card, [f.name for f in card.schema.fields if f.dataType.simpleString() == "double"])
