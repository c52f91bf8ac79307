"""Queries fit the package's own numbers of trees; boosting on drawn rows goes over distinct inputs."""

import pytest
from pyspark.sql import functions as F

from suite import models as queries
from wattline.plans import counted, models
from wattline.plans.preprocessing import FEATURES

NUMBERS, TEXTS = ["gpu_utilization_pct", "memory_utilization_pct"], ["workload_type"]
NAMES = {
    "random_forest": ["random_forest"],
    "gradient_boosting": ["gradient_boosting"],
    "subsampled_boosting": ["subsampled_boosting"],
    "train_and_evaluate": list(models.DEFAULT_MODELS),
    "model_importance": list(models.DEFAULT_MODELS),
}


class Fitted(Exception):
    pass


@pytest.fixture(scope="module")
def coarse(spark, telemetry):
    """Few distinct inputs, some of them null."""
    step = lambda c: F.when(F.col("k1") % 11 != 0, F.floor(F.col(c) / 13) * 13.0)
    rows = telemetry.withColumns({c: F.least(step(c), F.lit(130.0)) for c in NUMBERS})
    return rows.withColumn("workload_type", F.when(F.col("k1") % 7 != 0, F.col("workload_type"))).cache()


@pytest.mark.parametrize("query", list(NAMES))
def test_queries_fit_the_default_models(spark, sf_dir, monkeypatch, query):
    def noted(pre, table, vectors, fits, *rest):
        raise Fitted({name: {**models.DEFAULT_PARAMS[name], **(params or {})} for name, params in fits.values()})

    monkeypatch.setattr(models, "fit_all", noted)
    with pytest.raises(Fitted) as found:
        getattr(queries, query)(spark, sf_dir)
    assert found.value.args[0] == {name: models.DEFAULT_PARAMS[name] for name in NAMES[query]}


def test_boosting_on_nearly_all_rows_is_boosting_on_all_rows(coarse):
    # a share this near to 1 leaves no row out: each round's tree is that of all rows
    params = {"n_estimators": 10, "max_depth": 3, "min_samples_leaf": 40, "subsample": 1 - 1e-15, "colsample_bytree": 1.0}
    pre, model = models.fit_rows(coarse, "subsampled_boosting", NUMBERS, TEXTS, params)
    rows = pre.transform(coarse).select(FEATURES, "power_watts")
    plain = models.make_regressor("subsampled_boosting", pre.width, params | {"subsample": 1.0}).fit(rows)
    both = plain.transform(model.transform(rows).withColumnRenamed("prediction", "p"))
    assert model.getNumTrees == 10 and model.treeWeights == plain.treeWeights
    assert both.selectExpr("max(abs(prediction - p)) as gap").first()["gap"] < 1e-6


def test_each_round_draws_its_share_of_the_rows(coarse):
    table = counted.count_inputs(coarse, [*NUMBERS, *TEXTS])
    n, drawn = table.total, []
    whole = {tuple(r[c] for c in table.columns): r[counted.COUNT] for r in table.table.collect()}
    for sums, totals in counted.bootstraps(table, 10, 5, 0.9):
        for r in sums.collect():
            assert all(0 <= r[f"__w{t}"] <= whole[tuple(r[c] for c in table.columns)] for t in totals)
        assert sums.count() == len(whole)
        drawn += totals.values()
    assert len(drawn) == 10 and len(set(drawn)) > 3 and all(abs(d - 0.9 * n) < 6 * (0.09 * n) ** 0.5 for d in drawn)


def test_boosting_on_drawn_rows_fits_as_well_as_by_row(coarse):
    params = {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.2}
    pre, counts, vectors = models.training_vectors(coarse, NUMBERS, TEXTS)
    rows = vectors.unpersist()
    plain = models.make_regressor("subsampled_boosting", pre.width, params).fit(rows)
    model = models.fit_all(pre, counts, rows, {"a": ("subsampled_boosting", params)})["a"]
    errors = [m.transform(rows).selectExpr("sqrt(avg(power(power_watts - prediction, 2))) as e").first()["e"] for m in (model, plain)]
    assert model.getNumTrees == 12 and errors[0] == pytest.approx(errors[1], rel=0.02)
