"""Fits on distinct inputs against fits on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from suite.views import FEATURES as INPUTS
from suite.views import KEYS
from wattline.functions.coerce import HASH_EXTENT, hash60
from wattline.operators import ordering
from wattline.plans import counted, experiments, models, run
from wattline.plans.preprocessing import FEATURES, fit_preprocessor

NUMBERS, TEXTS = ["gpu_utilization_pct", "memory_utilization_pct"], ["workload_type"]
NO_IDS = ("timestamp", "session_id", *KEYS)
FITS = {
    "linear_regression": {},
    "gradient_boosting": {"n_estimators": 3, "max_depth": 3, "min_samples_leaf": 40},
    "random_forest": {"n_estimators": 1, "max_depth": 4, "bootstrap": False, "min_samples_leaf": 40},
}


@pytest.fixture(scope="module")
def coarse(spark, telemetry):
    """Few distinct inputs, some of them null; 16 values a number, so that every fit sees the same thresholds."""
    step = lambda c: F.when(F.col("k1") % 11 != 0, F.floor(F.col(c) / 13) * 13.0)
    rows = telemetry.withColumns({c: F.least(step(c), F.lit(130.0)) for c in NUMBERS})
    return rows.withColumn("workload_type", F.when(F.col("k1") % 7 != 0, F.col("workload_type"))).cache()


def test_weighted_preprocessing_is_that_of_all_rows(coarse):
    table = counted.count_inputs(coarse, [*NUMBERS, *TEXTS])
    assert table.table.count() < table.total / 4 and table.total == coarse.count()
    one, all_ = fit_preprocessor(table.table, NUMBERS, TEXTS, weight=counted.COUNT), fit_preprocessor(coarse, NUMBERS, TEXTS)
    assert one.fills == all_.fills and one.slots == all_.slots
    assert one.means == pytest.approx(all_.means) and one.scales == pytest.approx(all_.scales)


@pytest.mark.parametrize("name", list(FITS))
def test_counted_fit_is_the_fit_on_all_rows(coarse, name):
    table = counted.count_inputs(coarse, [*NUMBERS, *TEXTS])
    pre, model = models.fit_rows(coarse, name, NUMBERS, TEXTS, FITS[name])
    rows = pre.transform(coarse).select(FEATURES, "power_watts")
    plain = models.make_regressor(name, pre.width, FITS[name]).fit(rows)
    both = plain.transform(model.transform(rows).withColumnRenamed("prediction", "p"))
    # labels of every value are collinear: least squares ends by steps there
    limit = 1e-4 if name == "linear_regression" else 1e-6
    assert table is not None and both.selectExpr("max(abs(prediction - p)) as gap").first()["gap"] < limit


def test_a_forest_draws_every_row(spark, coarse):
    table = counted.count_inputs(coarse, TEXTS)
    n = table.total
    found = [(sums.toPandas(), totals) for sums, totals in counted.bootstraps(table, 10, 5)]
    assert [len(t) for _, t in found] == [8, 2]
    draws = np.array([t for _, totals in found for t in totals.values()])
    assert len(set(draws)) > 5 and (abs(draws - n) < 5 * np.sqrt(n)).all()
    # one input alone: the sum of n draws of mean 1 spreads like the square root of n, not like n
    sizes = {r["workload_type"]: r[counted.COUNT] for r in table.table.collect()}
    for sums, totals in found:
        for _, row in sums.iterrows():
            size = sizes[row["workload_type"]]
            assert all(abs(row[f"__w{t}"] - size) < 6 * np.sqrt(size) + 1 for t in totals)


def test_forest_of_counted_trees(coarse, tmp_path):
    params = {"n_estimators": 9, "max_depth": 3}
    pre, model = models.fit_rows(coarse, "random_forest", NUMBERS, TEXTS, params)
    rows = pre.transform(coarse)
    assert model.getNumTrees == 9 and model.totalNumNodes > 9 and model.featureImportances.toArray().sum() == pytest.approx(1)
    mean = sum(t.transform(rows.select(FEATURES).limit(1)).first()["prediction"] for t in model.trees) / 9
    assert model.transform(rows.limit(1)).first()["prediction"] == pytest.approx(mean)
    model.write().save(str(tmp_path / "forest"))
    again = type(model).load(str(tmp_path / "forest"))
    assert again.getNumTrees == 9
    plain = models.make_regressor("random_forest", pre.width, params).fit(rows)
    errors = [m.transform(rows).selectExpr("sqrt(avg(power(power_watts - prediction, 2))) as e").first()["e"] for m in (model, plain)]
    assert errors[0] == pytest.approx(errors[1], rel=0.02)


def test_no_vectors_of_rows_are_made_for_few_inputs(coarse, monkeypatch):
    data = models.prepare(coarse, exclude=(*NO_IDS, "graphics_clock_mhz", "memory_clock_mhz", "temperature_c", "ambient_c"), keys=KEYS)
    assert data.counted is not None
    fitted = models.fit_models(data, {"a": ("random_forest", {"n_estimators": 2, "max_depth": 2}), "b": ("gradient_boosting", {"n_estimators": 2})})
    long = models.predict_long(data, fitted)
    monkeypatch.setattr(models, "predict_wide", lambda *a: None)
    rows = models.predict_long(data, fitted)
    key = [*KEYS, "timestamp", "power_watts", "model"]
    one, two = (d.groupBy(*key).agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 6).alias("p")) for d in (long, rows))
    assert set(long.columns) == set(rows.columns) and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_many_distinct_inputs_are_fitted_by_row(telemetry):
    assert counted.count_inputs(telemetry, ["k1", "k2"]) is None
    assert not counted.means_suffice("subsampled_boosting", {"subsample": 0.9})
    assert not counted.means_suffice("linear_regression", {"regParam": 0.1})


@pytest.mark.parametrize("strategy", ["random", "time", "grouped"])
def test_a_split_is_drawn_once(telemetry, strategy):
    data = models.prepare(telemetry, None, NUMBERS, NO_IDS, strategy, keys=KEYS, carry=())
    plan = data.raw_test._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "l_shipdate" not in plan
    assert set(data.raw_test.columns) == {*NUMBERS, "power_watts", "is_test", "split_used"}
    whole = models.prepare(telemetry, None, NUMBERS, NO_IDS, strategy, keys=KEYS)
    assert set(whole.raw_test.columns) == {*telemetry.columns, "is_test", "split_used"}
    columns = [*NUMBERS, "power_watts"]
    assert data.raw_test.select(columns).exceptAll(whole.raw_test.select(columns)).isEmpty()
    for d in (data, whole):
        d.release()


def test_a_run_fits_its_own_split_once(telemetry, monkeypatch):
    drawn = []
    whole = models.split

    def noted(df, strategy, *rest):
        drawn.append(strategy)
        return whole(df, strategy, *rest)

    monkeypatch.setattr(models, "split", noted)
    options = run.RunOptions(models=("linear_regression",), keys=KEYS, exclude=NO_IDS, permutation=False, validation=True)
    tables, done = run.run_experiment(telemetry, "mit_supercloud", options)
    assert sorted(drawn) == ["grouped", "random", "time"]
    one = tables["split_comparison"].where("split_strategy = 'time'").select("model", "mae", "rmse", "r2").collect()
    assert one == done.metrics.select("model", "mae", "rmse", "r2").collect()
    apart, _ = experiments.split_comparison(telemetry, ["linear_regression"], keys=KEYS, exclude=NO_IDS)
    key = lambda r: r["split_strategy"]
    for a, b in zip(sorted(apart.collect(), key=key), sorted(tables["split_comparison"].collect(), key=key), strict=True):
        assert a["split_strategy"] == b["split_strategy"] and a["rmse"] == pytest.approx(b["rmse"])


def test_split_and_folds_store_what_is_read(telemetry, monkeypatch):
    stored = {}
    whole = experiments.spool
    monkeypatch.setattr(experiments, "spool", lambda df, label="table": stored.setdefault(label, df.columns) and whole(df, label))
    experiments.grouped_blocked_cv(telemetry, ["linear_regression"], exclude=NO_IDS)
    assert set(stored["folded"]) == {*INPUTS, *TEXTS, "power_watts", "fold"}
    data = models.prepare(telemetry, None, NUMBERS, NO_IDS, "time", keys=KEYS)
    paths = [f.removeprefix("file:") for f in data.raw_test.inputFiles()]
    rows = telemetry.sparkSession.read.parquet(*paths)
    assert rows.where("not is_test and (k1 is not null or session_id is not null)").isEmpty()
    assert rows.where("is_test and (k1 is null or session_id is null)").isEmpty()
    data.release()


def test_a_known_extent_hashes_a_row_once(telemetry):
    hashed = telemetry.withColumn("__h", hash60(1, F.col("k1"), F.col("k2")))
    slot = ordering.Slot("key", 1 << 55, (1 << 58) + 1, 0, 10)
    kind = hashed.schema["__h"].dataType
    once = hashed.where(ordering._within(F.col("__h"), slot, kind, HASH_EXTENT))
    plain = hashed.where(F.col("__h").between(slot.low, slot.high))
    condition = lambda df: df.select("power_watts")._jdf.queryExecution().optimizedPlan().toString().count("md5(")
    assert condition(once) == 1 < condition(plain)
    assert once.count() == plain.count() > 0 and once.exceptAll(plain).isEmpty()
    edges = telemetry.sparkSession.createDataFrame([(v,) for v in (slot.low - 1, slot.low, slot.high, slot.high + 1, *HASH_EXTENT)], "v bigint")
    assert edges.where(ordering._within(F.col("v"), slot, kind, HASH_EXTENT)).count() == 2
