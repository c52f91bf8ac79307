"""One-hot slots from a stored table against the listed form and a plain loop."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wattline.operators.drift import value_counts
from wattline.operators import lookup
from wattline.plans import categories, models, preprocessing
from wattline.plans.preprocessing import fit_preprocessor

ROWS = [
    (1.0, "b", "x y", 1.0), (2.0, "a", None, 3.0), (4.0, None, "it's", 2.0), (None, "b", "é", 9.0),
    (3.0, "z", "x y", 4.0), (8.0, "b", "\\", 7.5), (5.0, "c", "x y", 6.0),
]
SCHEMA = "x double, w string, v string, power_watts double"


def _arrays(pre, df):
    rows = pre.transform(df).select("power_watts", vector_to_array("features")).collect()
    return np.array([r[1] for r in sorted(rows, key=lambda r: r[0])])


@pytest.mark.parametrize("broadcast_values", [100_000, 0])
def test_table_form_equals_listed_form(spark, monkeypatch, broadcast_values):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    listed = fit_preprocessor(df, ["x"], ["w", "v"])
    monkeypatch.setattr(preprocessing, "LISTED", 3)
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", broadcast_values)
    table = fit_preprocessor(df, ["x"], ["w", "v"])
    assert table.slots is None and table.width == listed.width == len(listed.slots)
    assert table.fills == listed.fills and table.categorical == listed.categorical
    names = {r["slot"]: r["name"] for r in table.slot_names(spark).collect()}
    assert [names[i] for i in range(table.width)] == listed.slots
    assert _arrays(table, df) == pytest.approx(_arrays(listed, df))
    new = spark.createDataFrame([(None, "never", "é", 1.0), (2.0, None, None, 2.0)], SCHEMA)
    assert _arrays(table, new) == pytest.approx(_arrays(listed, new))
    none = new.limit(0)
    assert table.transform(none).count() == 0


def test_hot_values_are_few_and_not_shuffled_together(spark):
    # One value holds a third of the rows, every other one a row or two.
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") / 2).cast("int").cast("string"))).alias("w"), "id"
    )
    found = categories.number_categories(value_counts(df, ["w"]), ["w"], hot_share=10)
    side = spark.read.parquet(found.path)
    assert [r["value"] for r in side.where("hot").collect()] == ["hot"]
    assert found.fills == {"w": "hot"} and found.sizes == [side.count()]
    table = side.select(F.col("value").alias("key"), F.col("ix").alias("found"), "hot")
    out = lookup.look_up(df, table, found.sizes[0], F.col("w"), "ix", broadcast_keys=0)
    want = {v: i for i, v in enumerate(sorted({r["w"] for r in df.collect()}))}
    rows = out.collect()
    assert len(rows) == 6000 and all(r["ix"] == want[r["w"]] for r in rows)
    # A hot row is dealt by itself, so its tasks stay level.
    key = F.when(F.col("w") != "hot", F.col("w"))
    deal = F.when(F.col("w") != "hot", F.lit(-1)).otherwise(lookup.dealt(df))
    loads = [r["count"] for r in df.repartition(8, key, deal).groupBy(F.spark_partition_id()).count().collect()]
    assert max(loads) < 2 * 6000 / 8


def test_numbers_follow_value_order_per_column_and_ties_take_the_smaller_fill(spark):
    df = spark.createDataFrame([("b", "z"), ("a", None), ("b", "z"), ("a", None)], "p string, q string")
    found = categories.number_categories(value_counts(df, ["p", "q"]), ["q", "p"])
    assert found.columns == ["q", "p"] and found.sizes == [1, 2] and found.fills == {"p": "a", "q": "z"}
    rows = {(r["feature"], r["value"]): r["ix"] for r in spark.read.parquet(found.path).collect()}
    assert rows == {("p", "a"): 0, ("p", "b"): 1, ("q", "z"): 0}


def test_empty_text_is_a_value_of_its_own(spark):
    df = spark.createDataFrame([("", 1.0), ("a", 2.0), ("", 3.0), (None, 4.0)], "w string, power_watts double")
    pre = fit_preprocessor(df, [], ["w"])
    assert pre.fills == {"w": ""} and _arrays(pre, df).tolist() == [[1, 0], [0, 1], [1, 0], [1, 0]]


def test_saved_pipeline_carries_its_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(preprocessing, "LISTED", 3)
    df = spark.createDataFrame(ROWS, SCHEMA)
    pre = fit_preprocessor(df, ["x"], ["w", "v"])
    model = models.make_regressor("linear_regression", pre.width).fit(pre.transform(df).select("features", "power_watts"))
    PipelineModel([*pre.pipeline.stages, model]).write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert again.stages[-2].getOrDefault("table").startswith(str(tmp_path))
    got = [r[0] for r in again.transform(df).orderBy("power_watts").select("prediction").collect()]
    want = [r[0] for r in model.transform(pre.transform(df)).orderBy("power_watts").select("prediction").collect()]
    assert got == pytest.approx(want)


def test_table_form_works_on_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(preprocessing, "LISTED", 3)
    df = spark.createDataFrame(ROWS, SCHEMA)
    pre = fit_preprocessor(df, ["x"], ["w", "v"])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = pre.transform(stream).select("power_watts", vector_to_array("features").alias("f"))
    query = out.writeStream.format("memory").queryName("vectors").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = np.array([r["f"] for r in spark.table("vectors").orderBy("power_watts").collect()])
    assert got == pytest.approx(_arrays(pre, df))


def test_too_wide_a_vector_is_an_error():
    with pytest.raises(ValueError, match="at most"):
        categories.CategoryVectors(table="t", numbers=[], columns=["a", "b"], sizes=[2**30, 2**30], outputCol="features")


def test_models_train_on_a_wide_column(spark, monkeypatch):
    monkeypatch.setattr(preprocessing, "LISTED", 20)
    df = spark.range(400).select(
        F.concat(F.lit("s"), F.col("id") % 40).alias("who"), (F.col("id") % 7).cast("double").alias("x"),
        ((F.col("id") % 40) * 2.0 + (F.col("id") % 7)).alias("power_watts"),
    )
    done = models.train_and_evaluate(df, ["linear_regression"], None, None, (), "random", 0.2, 3, ["who", "x"])
    assert done.metrics.first()["rmse"] < 1e-6
    table = {r["feature"]: r["importance"] for r in models.importances(done).collect()}
    assert len(table) == done.pre.width == 41 and "cat__who_s39" in table
