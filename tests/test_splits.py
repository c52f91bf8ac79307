"""Split sizes, disjointness, fallbacks and greedy folds."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import lookup, splits
from wattline.operators.splits import attach_folds, grouped_folds, split


@pytest.mark.parametrize("test_size", [0.2, 0.25, 0.333])
def test_sizes(telemetry, test_size):
    n = telemetry.count()
    by = {s: split(telemetry, s, test_size, 7, ["k1", "k2"]).where("is_test").count() for s in ("random", "time")}
    assert by["random"] == math.ceil(test_size * n)
    assert by["time"] == n - int((1.0 - test_size) * n)


def test_time_split_is_ordered_and_nulls_are_latest(spark):
    base = pd.Timestamp("2025-01-01")
    rows = [(None if i % 10 == 0 else (base + pd.Timedelta(seconds=i)).to_pydatetime(), float(i)) for i in range(100)]
    df = split(spark.createDataFrame(rows, "timestamp timestamp_ntz, x double"), "time", 0.2)
    train, test = df.where("not is_test"), df.where("is_test")
    assert test.where("timestamp is null").count() == 10
    assert train.agg(F.max("timestamp")).first()[0] < test.agg(F.min("timestamp")).first()[0]


def test_grouped_split_holds_out_whole_sessions(telemetry):
    df = split(telemetry, "grouped", 0.25, 7)
    per = df.groupBy("session_id").agg(F.countDistinct("is_test").alias("sides"), F.max("is_test").alias("t")).collect()
    assert all(r["sides"] == 1 for r in per)
    assert sum(r["t"] for r in per) == math.ceil(0.25 * len(per))


def test_split_does_not_depend_on_partitioning(telemetry):
    def held(df):
        out = split(df, "random", 0.2, 7, ["k1", "k2"]).where("is_test")
        return sorted((r["k1"], r["k2"], r["power_watts"]) for r in out.collect())

    assert held(telemetry) == held(telemetry.repartition(7))


def test_fallback_and_guard(telemetry):
    bare = telemetry.drop("timestamp", "session_id")
    for s in ("time", "grouped"):
        assert split(bare, s, 0.2).select("split_used").distinct().first()[0] == "random"
    with pytest.raises(ValueError, match="No split"):
        split(telemetry, "magic")


def test_split_rows_are_not_shuffled(telemetry):
    for s in splits.STRATEGIES:
        plan = split(telemetry, s, 0.2, 7, ["k1", "k2"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, s


def test_fold_runs_equal_the_plain_greedy():
    r = random.Random(1)
    for _ in range(300):
        k = r.choice([2, 3, 4, 5])
        sizes = sorted((r.choice([1, 2, 3, 5, 50, 1000]) for _ in range(r.randint(k, 80))), reverse=True)
        loads, want = [0] * k, []
        for s in sizes:
            f = min(range(k), key=lambda i: (loads[i], i))
            loads[f] += s
            want.append(f)
        got = []
        for _, a, b, cycle in splits._fold_runs(list(Counter(sizes).items()), k):
            got += [cycle[(i - a) % len(cycle)] for i in range(a, b + 1)]
        assert got == want


def test_grouped_folds_with_a_hot_session(spark):
    hot = spark.range(4000).select(F.lit("hot").alias("session_id"))
    rest = spark.range(6000).select(F.concat(F.lit("s"), F.col("id") % 50).alias("session_id"))
    df = hot.unionByName(rest)
    folds = grouped_folds(df, 3)
    assert folds.count() == 51
    loads = {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.sum("rows").alias("n")).collect()}
    assert loads[1] == 4000 and loads[2] == loads[3] == 3000
    assert attach_folds(df, folds).count() == 10_000


def test_salted_fold_join_gives_the_same_rows(spark, telemetry, monkeypatch):
    folds = grouped_folds(telemetry, 3)
    plain = attach_folds(telemetry, folds).groupBy("fold").count().collect()
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", 2)
    salted = attach_folds(telemetry, folds)
    assert sorted(salted.groupBy("fold").count().collect()) == sorted(plain)


def test_folds_need_three_sessions(spark):
    df = spark.createDataFrame([("a",), ("b",)], "session_id string")
    assert grouped_folds(df) is None
    assert grouped_folds(df.drop("session_id")) is None
