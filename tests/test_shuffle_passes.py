"""Repeats of a permutation importance in passes whose shuffle files don't pile up."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from suite.views import KEYS
from wattline.plans import importance
from wattline.session import shuffles_dropped

FEATURES = ["ambient_c", "gpu_utilization_pct"]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(spark):
    """Numbers of the shuffles that have files."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.name.split("_")[1] for d in disk.localDirsString() for f in Path(d).rglob("shuffle_*.data")}


def _found(telemetry):
    scorer = importance.column_scorer(F.col("gpu_utilization_pct") * 1.3 + F.col("ambient_c") * 0.5 + 60)
    rows = importance.permutation_importance(telemetry, scorer, FEATURES, [*KEYS, "timestamp"], 5)
    return {r["feature"]: r["importance"] for r in rows.collect()}


def test_passes_give_the_importance_of_one_pass(telemetry, monkeypatch):
    whole, n, seen = _found(telemetry), telemetry.count(), []
    plain = importance.permuted

    def noted(indexed, features, n, repeats, seed, block_rows, first):
        seen.append((first, repeats))
        return plain(indexed, features, n, repeats, seed, block_rows, first)

    monkeypatch.setattr(importance, "permuted", noted)
    monkeypatch.setattr(importance, "PASS_ROWS", 2 * n + 1)
    assert _found(telemetry) == pytest.approx(whole)
    monkeypatch.setattr(importance, "PASS_ROWS", 1)
    assert _found(telemetry) == pytest.approx(whole)
    assert seen == [(0, 2), (2, 2), (4, 1), *[(i, 1) for i in range(5)]]


def test_shuffle_files_of_the_passes_are_deleted(spark, telemetry):
    telemetry.count()
    before = _stored(spark)
    found = _found(telemetry.withColumn("other", F.col("ambient_c") * 2))
    until = time.time() + 20
    # the aggregate and the sort of the result's few lines run outside
    while len(left := _stored(spark) - before) > 2 and time.time() < until:
        time.sleep(0.5)
    assert len(found) == 2 and len(left) <= 2


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(CLEANUP, None)
    with pytest.raises(KeyError), shuffles_dropped(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise KeyError
    assert spark.conf.get(CLEANUP, None) == before
