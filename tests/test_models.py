"""Preprocessing, fits, importances, attribution, experiments, registry and streams."""

import hashlib
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from suite.streams import _finish
from suite.views import FEATURES, KEYS
from wattline.functions.scalars import analytic_power_of_row
from wattline.operators.drift import reference_profile
from wattline.plans import experiments, importance, models, run
from wattline.plans.attribution import Trees, attributions, base_value, ensemble_trees, mean_attribution, row_attributions
from wattline.plans.preprocessing import fit_preprocessor
from wattline.plans.registry import PowerModel, list_versions, model_metadata, new_version, resolve_bundle, save_bundle
from wattline.sources import sinks
from wattline.streaming import jobs

NO_IDS = ("timestamp", "session_id", *KEYS)
TINY = {"random_forest": {"n_estimators": 2, "max_depth": 3}, "gradient_boosting": {"n_estimators": 2}}


def test_preprocessor(spark):
    df = spark.createDataFrame(
        [(1.0, None, "b", 9.0), (None, None, "a", 9.0), (4.0, None, None, 9.0), (3.0, None, "it's", 9.0)],
        "x double, none double, w string, flat double",
    )
    pre = fit_preprocessor(df, ["x", "none", "flat"], ["w"])
    assert pre.dropped == ["none"] and pre.fills["x"] == 3.0 and pre.fills["w"] == "a"
    assert pre.slots == ["num__x", "num__flat", "cat__w_a", "cat__w_b", "cat__w_it's"]
    new = spark.createDataFrame([(3.0, 9.0, "never seen"), (None, None, None)], "x double, flat double, w string")
    rows = [r[0] for r in pre.transform(new).select(vector_to_array("features")).collect()]
    z = (3.0 - 2.75) / np.std([1, 3, 4, 3])
    assert rows[0] == pytest.approx([z, 0, 0, 0, 0]) and rows[1] == pytest.approx([z, 0, 1, 0, 0])
    with pytest.raises(ValueError, match="Too many categories"):
        fit_preprocessor(df, ["x"], ["w"], max_categories=2)
    with pytest.raises(ValueError, match="No usable"):
        fit_preprocessor(df, ["none"], [])


def test_linear_model_is_least_squares(telemetry):
    done = models.train_and_evaluate(telemetry, ["linear_regression"], None, list(FEATURES[:2]), NO_IDS, "random", 0.2, 7, KEYS)
    pdf = models.split(telemetry, "random", 0.2, 7, KEYS).toPandas()
    x = np.c_[np.ones(len(pdf)), pdf[list(FEATURES[:2])]]
    tr = ~pdf["is_test"].to_numpy()
    beta, *_ = np.linalg.lstsq(x[tr], pdf["power_watts"][tr], rcond=None)
    e = pdf["power_watts"][~tr] - x[~tr] @ beta
    row = done.metrics.first()
    assert row["rmse"] == pytest.approx(np.sqrt((e**2).mean()), rel=1e-6)
    assert row["rank"] == 1 and done.split_used == "random"


def test_regressor_arguments():
    with pytest.raises(ValueError, match="No regressor"):
        models.make_regressor("mlp", 3)
    with pytest.raises(ValueError, match="Unknown parameter"):
        models.make_regressor("random_forest", 3, {"leaves": 4})
    forest = models.make_regressor("random_forest", 3)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (220, 14, 2)
    boost = models.make_regressor("subsampled_boosting", 3)
    assert (boost.getMaxIter(), boost.getSubsamplingRate(), boost.getFeatureSubsetStrategy()) == (300, 0.9, "0.9")
    narrow, wide = (models.make_regressor("linear_regression", n) for n in (3, 5000))
    assert (narrow.getSolver(), wide.getSolver()) == ("normal", "l-bfgs")


def test_training_vectors_of_many_rows_get_bounded_parts(spark, monkeypatch):
    # 40,000 rows of one file part: cached they would be read by one task
    rows = spark.range(0, 40_000, 1, 1).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as power_watts")
    monkeypatch.setattr(models, "ROW_BYTES", 100_000)
    _, counted, vectors = models.training_vectors(rows, ["x"], [])
    sizes = [n for n in vectors.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()]
    vectors.unpersist()
    assert counted is None and sum(sizes) == 40_000
    assert len(sizes) == -(-40_000 * 100_008 // models.SORT_PARTITION_BYTES) and max(sizes) < 2_000


def test_both_linear_solvers_predict_the_same(telemetry):
    pre = fit_preprocessor(telemetry, list(FEATURES), ["workload_type"])
    vectors = pre.transform(telemetry)
    one = models.make_regressor("linear_regression", len(pre.slots)).fit(vectors)
    two = models.make_regressor("linear_regression", len(pre.slots), models.STEPWISE).fit(vectors)
    both = one.transform(vectors).withColumnRenamed("prediction", "p")
    assert two.transform(both).selectExpr("max(abs(prediction - p)) as gap").first()["gap"] < 1e-3


def test_linear_model_of_many_slots(spark):
    # 5,000 categories: the prediction of each is its mean.
    rows = spark.range(10_000).selectExpr("cast(id % 5000 as string) as label", "cast(id % 5000 + id div 5000 as double) as power_watts")
    pipeline, _, texts = models.fit_full_pipeline(rows, "linear_regression")
    found = pipeline.transform(rows).selectExpr("max(abs(prediction - cast(label as double) - 0.5)) as gap").first()["gap"]
    assert texts == ["label"] and found < 1e-3


def test_train_errors(telemetry):
    with pytest.raises(ValueError, match="to learn"):
        models.train_and_evaluate(telemetry.drop("power_watts"))
    with pytest.raises(ValueError, match="None of the selected"):
        models.train_and_evaluate(telemetry, selected=["nothing"])
    with pytest.raises(ValueError, match="No regressor"):
        models.fit_full_pipeline(telemetry, "other")


def test_permutation_keeps_every_value(spark, telemetry):
    indexed = telemetry.withColumn("__idx", F.monotonically_increasing_id())
    n = telemetry.count()
    out = importance.permuted(indexed, ["ambient_c"], n, 2, 1, block_rows=500)
    pdf = out.select("repeat", "ambient_c", F.col("__next.ambient_c").alias("other")).toPandas()
    for _, part in pdf.groupby("repeat"):
        assert len(part) == n
        assert sorted(part["ambient_c"]) == sorted(part["other"])
        assert (part["ambient_c"] != part["other"]).mean() > 0.5


def test_permuted_rows_take_the_next_values_by_hash(spark):
    n, blocks = 1000, 4
    indexed = spark.range(n).selectExpr("id as `__idx`", "id * 10 as value")
    out = importance.permuted(indexed, ["value"], n, 2, 7, block_rows=250)
    # rows are sorted by one number before the window sorts them by block, hash and position
    sorts = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]
    assert sorted(line.count(" ASC ") for line in sorts) == [1, 3]
    expected = set()
    for r in range(2):
        hashes = [(int(hashlib.md5(f"7:{r}:{i}".encode()).hexdigest()[:15], 16), i) for i in range(n)]
        for b in range(blocks):
            order = [i for h, i in sorted(hashes) if h % blocks == b]
            expected |= {(r, i, after * 10) for i, after in zip(order, order[1:] + order[:1])}
    rows = out.select("repeat", "__idx", F.col("__next.value").alias("other")).collect()
    assert len(rows) == 2 * n and {tuple(x) for x in rows} == expected


def test_permutation_importance_ranks_features(telemetry):
    scorer = importance.column_scorer(F.col("gpu_utilization_pct") * 1.3 + F.col("ambient_c") * 0 + 60)
    found = importance.permutation_importance(telemetry, scorer, ["ambient_c", "gpu_utilization_pct"], [*KEYS], 3)
    rows = {r["feature"]: r["importance"] for r in found.collect()}
    assert rows["gpu_utilization_pct"] > 10 and rows["ambient_c"] == pytest.approx(0)


def _brute_force(trees, x):
    """Shapley values by enumerating subsets of all features."""
    m = x.shape[1]

    def value(row, known, node):
        left, right = int(trees.left[node]), int(trees.right[node])
        if left < 0:
            return trees.value[node]
        f = int(trees.feature[node])
        if f in known:
            goes = row[f] in trees.categories[node] if node in trees.categories else row[f] <= trees.threshold[node]
            return value(row, known, left if goes else right)
        return sum(trees.cover[c] / trees.cover[node] * value(row, known, c) for c in (left, right))

    out = np.zeros(x.shape)
    for r, row in enumerate(x):
        for root, weight in zip(trees.roots.tolist(), trees.weights):
            for i in range(m):
                others = [j for j in range(m) if j != i]
                for size in range(m):
                    for subset in combinations(others, size):
                        k = factorial(size) * factorial(m - size - 1) / factorial(m)
                        out[r, i] += weight * k * (value(row, {*subset, i}, root) - value(row, set(subset), root))
    return out


def _random_trees(rnd, features, n, depth):
    rows = []

    def grow(cover, level):
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, rnd.normal(), cover])
        if level < depth and cover >= 2 and rnd.random() < 0.9:
            split = rnd.integers(1, cover)
            rows[at][:4] = [int(rnd.integers(features)), float(rnd.normal()), grow(split, level + 1), grow(cover - split, level + 1)]
        return at

    roots = [grow(1000, 0) for _ in range(n)]
    feature, threshold, left, right, value, cover = map(np.array, zip(*rows))
    listed = {i: np.array([0.0, 2.0]) for i in range(0, len(rows), 7) if left[i] >= 0}
    return Trees(feature, threshold, left, right, value, cover.astype(float), np.array(roots), rnd.random(n), listed)


@pytest.mark.parametrize("features, depth, table", [(1, 3, 9), (4, 5, 9), (6, 7, 2)])
def test_attributions_match_brute_force(monkeypatch, features, depth, table):
    # Features come back on a path, some nodes list categories, some paths are longer than a table.
    monkeypatch.setattr("wattline.plans.attribution.TABLE_BITS", table)
    monkeypatch.setattr("wattline.plans.attribution.ROWS", 3)
    rnd = np.random.default_rng(features)
    trees = _random_trees(rnd, features, 3, depth)
    x = np.vstack([rnd.normal(size=(6, features)), rnd.integers(0, 3, (2, features))])
    found = attributions(trees, x)
    assert found == pytest.approx(_brute_force(trees, x))
    assert attributions(trees, x[:0]).shape == (0, features)


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting"])
def test_attributions_add_up(telemetry, name):
    pre = fit_preprocessor(telemetry, ["gpu_utilization_pct", "ambient_c"], ["workload_type"])
    vectors = pre.transform(telemetry)
    model = models.make_regressor(name, len(pre.slots), TINY[name]).fit(vectors)
    base = base_value(ensemble_trees(model))
    rows = row_attributions(model, model.transform(vectors), ["prediction"]).toPandas()
    total = np.stack(rows["attribution"].to_numpy()).sum(axis=1) + base
    assert total == pytest.approx(rows["prediction"].to_numpy())
    table = mean_attribution(model, vectors, pre.slots, name, KEYS, max_rows=50)
    assert table.first()["feature"] == "num__gpu_utilization_pct" and table.first()["sample_rows"] == 50
    linear = models.make_regressor("linear_regression", 3).fit(vectors)
    with pytest.raises(TypeError):
        ensemble_trees(linear)


def test_grid():
    grid = experiments.expand_grid(experiments.DEFAULT_SWEEP)
    assert len(grid) == 16 and len({repr(g) for g in grid}) == 16


def test_experiments(spark, telemetry):
    kw = dict(keys=KEYS, exclude=NO_IDS)
    table, best, empty = experiments.feature_ablation(telemetry, ["linear_regression"], **kw)
    rows = {r["feature_set"]: r for r in table.collect()}
    assert rows["all_features"]["feature_count"] == 7 and empty == []
    assert rows["all_features"]["rmse"] <= rows["system_only"]["rmse"]
    space = {"random_forest": {"n_estimators": [1, 2], "max_depth": [2]}}
    swept, winner = experiments.hyperparameter_sweep(telemetry, space, "time", **kw)
    assert swept.count() == 2 and winner.count() == 1
    splits, best = experiments.split_comparison(telemetry, ["linear_regression"], **kw)
    assert {r["split_strategy"] for r in splits.collect()} == {"random", "time", "grouped"} and best.count() == 3
    folds, summary = experiments.grouped_blocked_cv(telemetry, ["linear_regression"], exclude=NO_IDS)
    assert [r["fold"] for r in folds.collect()] == [1, 2, 3] and summary.count() == 1
    one = telemetry.withColumn("session_id", F.lit("only"))
    assert experiments.grouped_blocked_cv(one)[0].count() == 0
    both = experiments.over_sources({"a": telemetry, "b": telemetry.limit(10)}, lambda d: {"n": d.groupBy().count()})
    assert {r["source"]: r["count"] for r in both["n"].collect()} == {"a": telemetry.count(), "b": 10}


def test_end_to_end_and_registry(spark, telemetry, tmp_path):
    df = telemetry.drop("k1", "k2")
    options = run.RunOptions(
        models=("linear_regression", "random_forest"), params=TINY, exclude=("timestamp", "session_id"), attribution=True, sweep=True,
        sweep_space={"random_forest": {"n_estimators": [1, 2], "max_depth": [2]}},
    )
    tables, done = run.run_experiment(df, "mit_supercloud", options)
    card = tables["scorecard"].first()
    assert card["best_model"] == "linear_regression" and card["sweep_model"] == "random_forest"
    assert card["sweep_rmse"] > 0 and card["ablation_set"] is None and card["target_risk"] is False
    assert card["name_leakage_flags"] == 0 and card["corr_leakage_flags"] is not None
    assert {"metrics", "data_audit", "reference_profile", "random_forest_attribution", "linear_regression_permutation_importance"} <= set(tables)
    paths = sinks.write_tables({k: tables[k] for k in ("metrics", "target_summary", "data_audit")}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(paths["metrics"]).count() == 2
    registry = str(tmp_path / "registry")
    folder = run.save_best_model(df, done, registry, "mit_supercloud", options)
    model = PowerModel.from_registry(spark, registry, "linear_regression")
    assert model.folder == folder and model.metadata.metrics["rmse"] > 0
    assert model.metadata.feature_order == [*FEATURES, "workload_type"]
    partial = spark.createDataFrame([("55.0", "AF", 1)], "gpu_utilization_pct string, workload_type string, extra int")
    rows = model.predict_rows(partial, ["gpu_utilization_pct"]).collect()
    assert rows[0]["index"] == 0 and np.isfinite(rows[0]["predicted_power_watts"])
    assert model.predict_one(spark, {"gpu_utilization_pct": 55.0, "workload_type": "AF"}) == pytest.approx(rows[0]["predicted_power_watts"])
    assert model.profile(spark).count() == 7
    with pytest.raises(ValueError, match="no records"):
        model.predict_rows(partial.limit(0), ["gpu_utilization_pct"])
    with pytest.raises(ValueError, match="not part of the run"):
        run.save_best_model(df, done, registry, "mit_supercloud", options, model="other")


def test_registry_versions(spark, telemetry, tmp_path):
    pipeline, numbers, texts = models.fit_full_pipeline(telemetry, "linear_regression", exclude=NO_IDS)
    registry = str(tmp_path)
    for v in ("20250101T000000Z", "20250301T000000Z", "20250201T000000Z"):
        save_bundle(spark, pipeline, model_metadata(spark, "m", numbers, texts, {}, "time", "x", v), registry)
    assert resolve_bundle(spark, registry, "m").endswith("20250301T000000Z")
    assert resolve_bundle(spark, registry, "m", "20250101T000000Z").endswith("20250101T000000Z")
    assert list_versions(spark, registry).count() == 3
    for part in (tmp_path / "_index").glob("*.parquet"):
        part.write_bytes(b"broken")
    assert list_versions(spark, registry).count() == 3
    (tmp_path / "_index").rename(tmp_path / "_moved")
    assert resolve_bundle(spark, registry, "m").endswith("20250301T000000Z")
    with pytest.raises(FileNotFoundError):
        resolve_bundle(spark, registry, "unknown")
    with pytest.raises(FileNotFoundError):
        PowerModel.from_dir(spark, str(tmp_path / "nothing"))
    assert len(new_version()) == 16


def test_scoring_survives_a_failing_log(spark, telemetry, tmp_path):
    fields = [*FEATURES, "workload_type"]
    payload = F.to_json(F.struct(F.array(F.struct(*fields)).alias("records")))
    telemetry.limit(50).select(payload.alias("value")).write.text(str(tmp_path / "in"))
    (tmp_path / "log").write_text("a file where the log folder should be")
    q = jobs.score_stream(
        spark.readStream.text(str(tmp_path / "in")), lambda d: d.withColumn("prediction", analytic_power_of_row()), fields, fields,
        str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "cp"), "m", "v", once=True,
    )
    _finish(q)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_a_batch_is_scored_once_and_answers_name_their_request(spark, telemetry, tmp_path):
    fields = [*FEATURES, "workload_type"]
    payload = F.to_json(F.struct(F.array(F.struct(*fields), F.struct(*fields)).alias("records")))
    telemetry.limit(20).select(payload.alias("value")).write.text(str(tmp_path / "in"))
    (tmp_path / "in" / "zz.txt").write_text("no request\n")
    calls = spark.sparkContext.accumulator(0)

    def scorer(d):
        def one(x):
            calls.add(1)
            return x * 2

        return d.withColumn("prediction", F.udf(one, "double")("gpu_utilization_pct"))

    q = jobs.score_stream(
        spark.readStream.text(str(tmp_path / "in")), scorer, fields, fields,
        str(tmp_path / "out"), str(tmp_path / "log"), str(tmp_path / "cp"), "m", "v", once=True,
    )
    _finish(q)
    assert calls.value == 40 and spark.read.json(str(tmp_path / "log")).count() == 40
    asked = spark.read.text(str(tmp_path / "in")).withColumn("request_key", F.sha2("value", 256))
    answers = spark.read.parquet(str(tmp_path / "out")).join(asked, "request_key")
    wrong = answers.where(F.get_json_object("value", "$.records[0].gpu_utilization_pct").cast("double") * 2 != F.col("predicted_power_watts"))
    assert answers.count() == 40 and wrong.isEmpty()
    assert spark.read.parquet(str(tmp_path / "out-rejects")).first()["value"] == "no request"


def test_drift_stream_reports_per_batch(spark, telemetry, tmp_path):
    profile = reference_profile(telemetry, ["gpu_utilization_pct"], [])
    telemetry.select("gpu_utilization_pct").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("gpu_utilization_pct double").parquet(str(tmp_path / "in"))
    _finish(jobs.drift_stream(stream, profile, str(tmp_path / "out"), str(tmp_path / "cp"), once=True))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("severity = 'ok'").count() == 3 and "batch_id" in out.columns
