"""Missing and endless numbers, odd order keys, times as numbers, request order and rejects."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wattline.functions import coerce
from wattline.operators import columns, selection, splits
from wattline.operators.ordering import flag_first
from wattline.plans.models import make_regressor, train_and_evaluate
from wattline.plans.preprocessing import fit_preprocessor
from wattline.plans.scoring import prediction_rows
from wattline.sources.catalog import read_telemetry
from wattline.sources.files import read_trace_csv
from wattline.sources.records import request_rows
from wattline.streaming import jobs

ENDLESS = [math.nan, math.inf, -math.inf, 1e308, -1e308, 0.0, 1.5, None]


def _finish(q):
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive


def test_preprocessing_imputes_nan_and_infinity(spark):
    rows = [(1.0, "a"), (2.0, "b"), (3.0, "b"), (math.nan, "a"), (math.inf, None), (None, "b")]
    df = spark.createDataFrame(rows, "x double, w string")
    pre = fit_preprocessor(df, ["x"], ["w"])
    values = [r["features"][0] for r in pre.transform(df).collect()]
    assert pre.fills["x"] == 2.0 and all(math.isfinite(v) for v in values)
    assert values[3] == values[4] == values[5] == values[1]


def test_fit_skips_rows_without_a_finite_target(spark):
    rows = [(float(i), math.nan if i % 9 == 0 else 2.0 * i + 1, "s") for i in range(80)]
    df = spark.createDataFrame(rows, "x double, power_watts double, session_id string")
    run = train_and_evaluate(df, ["linear_regression"], exclude=("timestamp", "session_id"))
    assert run.metrics.first()["rmse"] < 1e-6


@pytest.mark.parametrize("bound", [1, 5])
def test_order_by_doubles_of_every_kind(spark, bound):
    values = ENDLESS * 6 + [float(i) for i in range(20)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    want = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] is not None and math.isnan(values[i]), 0 if values[i] is None or math.isnan(values[i]) else values[i], i))
    for k in (1, 7, 25, 40, len(values) - 2):
        flagged = flag_first(df, ["x"], k, "first", row_bound=bound)
        assert {r["i"] for r in flagged.where("first").collect()} == set(want[:k])


@pytest.mark.parametrize("kind, values", [("decimal(10,2)", ["3.25", "-1.10", "0.00", "3.24"]), ("decimal(38,6)", ["123456789012345678901234.5", "-5", "123456789012345678901234.4", "0.000001"]), ("binary", ["b", "a", "", "ab"])])
def test_order_by_decimal_and_binary(spark, kind, values):
    made = [v.encode() if kind == "binary" else Decimal(v) for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(made)], f"i int, x {kind}")
    want = sorted(range(len(made)), key=lambda i: made[i])
    for k in (1, 2, 3):
        flagged = flag_first(df, ["x"], k, "first", row_bound=1)
        assert {r["i"] for r in flagged.where("first").collect()} == set(want[:k])


def test_quantiles_of_endless_range(spark):
    df = spark.createDataFrame([(v,) for v in (1e308, -1e308, 0.0, 1.0, -1.0)], "x double")
    long = selection.long_form(df, ["x"])
    assert selection.quantiles(long, [0.5, 0.75], row_bound=1)["x"] == {0.5: 0.0, 0.75: 1.0}


def test_times_as_numbers_and_offsets(spark):
    texts = ["1650000000", "1650000000.25", "2022-04-15 05:20:00", "2022-10-30T02:30:00+02:00", "2022-10-30T02:30:00+01:00", "x", "-60", "1e30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(coerce.to_time(F.col("t")).cast("string").alias("t"))
    want = ["2022-04-15 05:20:00", "2022-04-15 05:20:00.25", "2022-04-15 05:20:00", "2022-10-30 00:30:00", "2022-10-30 01:30:00", None, "1969-12-31 23:59:00", None]
    assert [r["t"] for r in df.collect()] == want
    numbers = spark.createDataFrame([(1650000000,)], "t long")
    assert numbers.select(coerce.as_time(numbers, "t").cast("string")).first()[0] == want[0]


def test_time_split_without_a_time_is_an_error(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "timestamp timestamp_ntz, x double")
    with pytest.raises(ValueError, match="time split"):
        splits.time_split(df, 0.5)


def test_rows_with_an_extra_empty_field_go(spark, tmp_path):
    (tmp_path / "t.csv").write_text('# note\na,b\n1,2\n3,4,\n5\n6,"x,y"\n7,"x,y",\n')
    got = read_trace_csv(spark, ["a", "b"], [str(tmp_path / "t.csv")])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [("1", "2"), ("5", None), ("6", "x,y")]


def test_all_trace_files_are_read(spark, tmp_path):
    for i in range(12):
        lines = "\n".join(f"2024-01-01 00:0{m}:00,{100 + 7 * i + 3 * m + (m * m) % 5},{20 + (m * 7 + i) % 11}" for m in range(8))
        (tmp_path / f"run{i:02d}.csv").write_text("_time,power_gpu0,temp_gpu0\n" + lines + "\n")
    assert read_telemetry(spark, "bmcdata_public", str(tmp_path)).select("session_id").distinct().count() == 12
    assert read_telemetry(spark, "bmcdata_public", str(tmp_path), max_files=5).select("session_id").distinct().count() == 5


def test_request_positions_and_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [
        '{"records": [{"gpu_utilization_pct": 30, "workload_type": "b"}, {"gpu_utilization_pct": 10, "workload_type": "a"}]}',
        '{"records": []}', "not json", '{"records": [{"gpu_utilization_pct": 20, "workload_type": "c"}]}',
    ]
    (tmp_path / "in" / "r.txt").write_text("\n".join(lines))
    scorer = lambda df: df.withColumn("prediction", F.col("gpu_utilization_pct") * 2)
    fields = ["gpu_utilization_pct", "workload_type"]
    paths = [str(tmp_path / p) for p in ("out", "log", "checkpoint")]
    _finish(jobs.score_stream(spark.readStream.text(str(tmp_path / "in")), scorer, fields, fields, *paths, "m", "v", once=True))
    got = {(r["workload_type"], r["row_index"], r["predicted_power_watts"]) for r in spark.read.parquet(paths[0]).collect()}
    assert got == {("b", 0, 60.0), ("a", 1, 20.0), ("c", 0, 40.0)}
    rejected = spark.read.parquet(paths[0] + "-rejects")
    assert {r["value"] for r in rejected.collect()} == {'{"records": []}', "not json"}
    assert spark.read.json(paths[1]).count() == 3
    scored = scorer(request_rows(spark.createDataFrame([(lines[0],)], "value string")))
    assert [(r["index"], r["predicted_power_watts"]) for r in prediction_rows(scored).orderBy("index").collect()] == [(0, 60.0), (1, 20.0)]


def test_intake_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "2026/06/05 20:00:0{}.000, 0, NVIDIA A100, GPU-abc, 72, 55, 1410, 1215, 64, 215.5"
    (tmp_path / "in" / "a.txt").write_text("\n".join([line.format(i) for i in range(3)] + ["broken, line"]))
    _finish(jobs.intake_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "live", once=True))
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "out-rejects")).collect()] == ["broken, line"]
    back = read_telemetry(spark, "local_nvidia_smi", str(tmp_path / "out"))
    assert back.count() == 3 and dict(back.dtypes)["timestamp"] == "timestamp_ntz"
    assert {r["session_id"] for r in back.collect()} == {"live_gpu_0"}


def test_capped_wide_csv_takes_first_rows_of_an_order(spark, tmp_path):
    rows = "\n".join(f"2024-01-01 00:00:{i:02d},{50 + i},10,5,100.0" for i in range(30, 0, -1))
    (tmp_path / "dcgm.csv").write_text("timestamp,utilization_gpu_pct,utilization_memory_pct,temperature_gpu,power_draw_w\n" + rows)
    df = read_telemetry(spark, "mit_supercloud", str(tmp_path), max_rows=4)
    assert sorted(r["gpu_utilization_pct"] for r in df.collect()) == [51.0, 52.0, 53.0, 54.0]


def test_solver_is_an_argument():
    assert make_regressor("linear_regression", 5000, {"solver": "normal"}).getSolver() == "normal"
    assert make_regressor("linear_regression", 3, {"solver": "l-bfgs"}).getSolver() == "l-bfgs"


def test_families(spark):
    got = columns.feature_families(["gpu_utilization_pct", "temperature_c", "cpu_load", "mem_used", "workload_type", "x", "power_watts", "psu_power"])
    assert got["gpu_only"] == ["gpu_utilization_pct", "workload_type"]
    assert got["gpu_plus_thermal"] == ["gpu_utilization_pct", "temperature_c", "workload_type"]
    assert got["system_only"] == ["cpu_load", "mem_used", "temperature_c"]
    assert got["all_features"] == ["gpu_utilization_pct", "temperature_c", "cpu_load", "mem_used", "workload_type", "x"]


def test_plain_numbers_are_parsed_once(spark):
    shown = str(coerce.to_number(F.col("t"))).lower()
    assert "isnan" not in shown.split(" else ")[0]
    texts = ["9" * 300, "9" * 309, "-" + "9" * 400 + ".5", "+5.", "-0.25", "1e308", "1e309", "5 W", "."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(coerce.to_number(F.col("t"))).collect()]
    assert got == [float("9" * 300), None, None, 5.0, -0.25, 1e308, None, None, None]


def test_offsets_are_found_behind_the_clock(spark):
    texts = ["2025-01-02T03:04:05-0130", "2025/1/2 03:04:05.5+01:00", "2025/01/02 03:04:05", "2025-01-02T03:04:05Z", "2025-01-02", "03/04", ":-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(coerce.to_time(F.col("t")).cast("string").alias("t"))
    want = ["2025-01-02 04:34:05", "2025-01-02 02:04:05.5", "2025-01-02 03:04:05", "2025-01-02 03:04:05", "2025-01-02 00:00:00", None, None]
    assert [r["t"] for r in df.collect()] == want
    assert "contains" in str(coerce.to_time(F.col("t"))).lower()
