"""Lookups with hot keys, medians of counts, range sizing and unlisted metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import lookup, selection
from wattline.operators.checks import dataset_summary
from wattline.operators.ordering import row_index
from wattline.operators.quality import session_sizes
from wattline.session import size_known, sort_partitions
from wattline.sources import long_csv


@pytest.mark.parametrize("broadcast_keys", [100, 0])
def test_look_up_keeps_rows_copies_nulls_and_odd_names(spark, broadcast_keys):
    rows = [("a", 1), ("a", 1), (None, 2), ("gone", 3), ("b", 4), ("", 5)]
    df = spark.createDataFrame(rows, "k string, `x.y``z` int").repartition(3)
    side = spark.createDataFrame([("a", 10, True), ("b", 20, False), ("", 30, False)], "key string, found int, hot boolean")
    out = lookup.look_up(df, side, 3, F.col("k"), "got", broadcast_keys)
    assert out.columns == ["k", "x.y`z", "got"]
    want = {"a": 10, "b": 20, "": 30}
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((*r, want.get(r[0]))) for r in rows)
    assert lookup.look_up(df.limit(0), side, 3, F.col("k"), "got", broadcast_keys).count() == 0


def test_hot_and_null_keys_are_spread(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("v"), "id")).alias("k"))
    counts = df.dropna().groupBy("k").count()
    side = counts.select(F.col("k").alias("key"), F.xxhash64("k").alias("found"), lookup.is_hot(F.col("count"), F.lit(9000)).alias("hot"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup.look_up(df, side, 10**6, F.col("k"), "got")
        # The found value is summed, as else the join would be left out.
        loads = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("got")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(loads) == 9000 and max(loads) < 1.3 * 9000 / len(loads) and len(loads) == 4
    assert out.where(~F.col("got").eqNullSafe(F.xxhash64("k")) & F.col("k").isNotNull()).count() == 0


def test_median_session_size_matches_numpy_and_keeps_no_map(spark):
    sizes = [1, 1, 2, 3, 50, 400, 7, 7]
    rows = [(f"s{i}", 1.0) for i, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "session_id string, power_watts double")
    row = session_sizes(df).first()
    assert row["median_rows_per_session"] == np.median(sizes) and row["unique_sessions"] == len(sizes)
    assert dataset_summary(df, "mit_supercloud").first()["median_rows_per_session"] == np.median(sizes)
    plan = session_sizes(df)._jdf.queryExecution().toString()
    assert "percentile" not in plan
    empty = session_sizes(df.limit(0)).first()
    assert empty["median_rows_per_session"] is None and empty["unique_sessions"] == 0


@pytest.mark.parametrize("bound", [2, 100_000])
def test_whole_quantiles_by_rank(spark, bound):
    values = np.random.default_rng(5).integers(0, 40, 999)
    long = spark.createDataFrame([("n", int(v)) for v in values], "series string, v bigint")
    assert selection.quantiles(long, (0.5,), bound)["n"][0.5] == np.median(values)
    assert selection.whole_median(long.limit(0), "v") is None


def test_a_joined_table_is_sized_by_its_files(spark):
    left = spark.range(1_000_000).withColumn("k", F.col("id") % 1000)
    right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    joined = left.join(right, "k")
    assert size_known(left) and not size_known(joined)
    assert not size_known(left.withColumn("e", F.explode(F.array("id"))))
    assert sort_partitions(joined) > 100  # the product of both sides
    out = row_index(joined, ["twice", "id"], "at")
    assert len(out.inputFiles()) <= 16
    wrong = out.where(F.col("at") != F.expr("(id % 1000) * 1000 + id div 1000"))
    assert out.count() == 1_000_000 and wrong.count() == 0


def test_unlisted_metrics_are_counted_before_they_become_columns(spark):
    readings = spark.range(60).select(
        F.lit("t").alias("ts"), (F.col("id") % 2).alias("dv"), F.concat(F.lit("m"), F.col("id") % 6).alias("mt"), F.col("id").cast("double").alias("vl")
    )
    with pytest.raises(ValueError, match="Over 5 metric names"):
        long_csv.metric_names(readings, 5)
    assert long_csv.metric_names(readings, 6) == [f"m{i}" for i in range(6)]
    wide = {r["dv"]: r for r in long_csv.pivot_readings(readings).collect()}
    maps = {r["dv"]: r["metrics"] for r in long_csv.metric_maps(readings).collect()}
    for dv, row in wide.items():
        assert maps[dv] == {m: row[m] for m in long_csv.metric_names(readings) if row[m] is not None}
