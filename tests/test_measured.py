"""Clamped readings, activity blocks, regimes, base loads and calibration on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattline.operators import measured


def _trace(spark):
    days = [1, 1, 2, 9, 17, 18, 30]
    rows = [("a", datetime(2024, 1, d, 5), float(10 * i), "x") for i, d in enumerate(days)]
    rows += [("b", datetime(2024, 1, 3), 500.0, None), ("b", None, 1.0, None), (None, datetime(2024, 1, 3), None, "x")]
    return spark.createDataFrame(rows, "session_id string, timestamp timestamp_ntz, power_watts double, workload_type string")


def test_clamped_readings(spark):
    got = {r["session_id"]: tuple(r[2:]) for r in measured.clamped_readings(_trace(spark)).collect()}
    assert got == {"a": (7, 2, 0, 18 + 18 + 20 + 30 + 40 + 50 + 60), "b": (2, 1, 1, 438), None: (0, 0, 0, None)}
    with pytest.raises(ValueError, match="physical limit"):
        measured.clamped_readings(_trace(spark).select("session_id"))


def test_activity_blocks(spark):
    out = measured.activity_blocks(_trace(spark))
    assert out.count() == 10 and out.columns[-1] == "block"
    got = [r["block"] for r in out.where("session_id = 'a'").orderBy("power_watts").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 2]  # the gaps are 7, 8 and 12 days long
    assert {(r["power_watts"], r["block"]) for r in out.where("session_id = 'b' or session_id is null").collect()} == {(500.0, 0), (1.0, None), (None, None)}
    assert measured.activity_blocks(_trace(spark).limit(0)).collect() == []


def test_daily_regimes(spark):
    got = measured.daily_regimes(_trace(spark), days=10).orderBy("session_id", "day").collect()
    assert [(r["session_id"], r["day"].day, r["rows"], r["mean"], r["rolling"], r["regime"]) for r in got] == [
        ("a", 1, 2, 5.0, None, "start"), ("a", 2, 1, 20.0, 5.0, "up"), ("a", 9, 1, 30.0, 10.0, "up"), ("a", 17, 1, 40.0, 30.0, "up"),
        ("a", 18, 1, 50.0, 35.0, "up"), ("a", 30, 1, 60.0, None, "start"), ("b", 3, 1, 500.0, None, "start"),
    ]
    level = measured.daily_regimes(_trace(spark), days=10, step=12).where("regime = 'level'")
    assert [r["day"].day for r in level.collect()] == [17]


def test_base_loads_and_calibration(spark):
    out = measured.with_base_loads(_trace(spark), {"base": "power_watts"})
    assert {(r["workload_type"], r["base"]) for r in out.collect()} == {("x", 30.0), (None, 250.5)} and out.count() == 10
    inputs = ("gpu_utilization_pct", "memory_utilization_pct", "graphics_clock_mhz", "memory_clock_mhz", "temperature_c")
    rows = _trace(spark).withColumns({c: F.lit(v) for c, v in zip(inputs, (0.0, 0.0, 900.0, 3200.0, 20.0))})
    got = measured.with_calibrated_power(rows)  # the closed form gives 25 everywhere
    assert {(r["workload_type"], r["power_bias"], r["calibrated_power"]) for r in got.collect()} == {("x", 5.0, 30.0), (None, 225.5, 250.5)}
