"""Readers and writers on small files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from wattline.contract import contract, contract_table, source_names
from wattline.functions import coerce
from wattline.sources import bmc_csv, long_csv, sinks
from wattline.sources.catalog import read_telemetry
from wattline.sources.files import headers, read_trace_csv, stem
from wattline.sources.records import read_records
from wattline.sources.smi_text import label_samples, malformed_lines, parse_lines
from wattline.sources.wide_csv import first_present, read_wide_csv

WIDE = """job_id,timestamp,gpu,utilization gpu pct,utilization memory pct,temperature gpu,power draw W,clocks sm MHz,clocks mem MHz
101,2022-01-01 00:00:00,0,50.0,40.0,62.0,180.0,1300.0,5000.0
101,2022-01-01 00:00:01,0,75.0,45.0,65.0,220.0,1350.0,5000.0
102,2022-01-01 00:00:02,1,25.0,20.0,55.0,140.0,1100.0,4500.0
"""


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_contracts(spark):
    assert source_names() == ["bmcdata_public", "local_nvidia_smi", "mit_supercloud", "nrel_eagle", "synthetic"]
    assert contract("local_nvidia_smi").data_kind == "local_measured_trace"
    assert contract_table(spark).count() == 5
    with pytest.raises(ValueError, match="No source"):
        contract("other")


def test_wide_csv_with_row_cap(spark, tmp_path):
    _write(tmp_path / "d" / "dcgm.csv", WIDE)
    df = read_telemetry(spark, "mit_supercloud", str(tmp_path / "d"), max_rows=2)
    rows = df.orderBy("timestamp").collect()
    assert [r["power_watts"] for r in rows] == [180.0, 220.0]
    assert {r["session_id"] for r in rows} == {"101_gpu_0"}
    assert {r["workload_type"] for r in rows} == {"mit_supercloud_gpu_trace"}
    assert {r["source_file"] for r in rows} == {"dcgm.csv"}
    kept = read_wide_csv(spark, str(tmp_path / "d"), "mit_supercloud", 2, cap_order=["timestamp"])
    assert kept.count() == 2


def test_wide_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_telemetry(spark, "mit_supercloud", str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="Expected one of"):
        read_telemetry(spark, "mit_supercloud", str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="needs the path"):
        read_telemetry(spark, "nrel_eagle")
    head = WIDE.splitlines()[0]
    with pytest.raises(ValueError, match="empty"):
        read_wide_csv(spark, _write(tmp_path / "h.csv", head + "\n"), "mit_supercloud")
    with pytest.raises(ValueError, match="power column"):
        read_wide_csv(spark, _write(tmp_path / "p.csv", "gpu,utilization gpu\n0,1\n"), "mit_supercloud")
    with pytest.raises(ValueError, match="lacks key"):
        read_wide_csv(spark, _write(tmp_path / "k.csv", "gpu,power\n0,100\n"), "mit_supercloud")
    with pytest.raises(ValueError, match="no valid positive"):
        read_wide_csv(spark, _write(tmp_path / "z.csv", WIDE.replace("180.0", "0").replace("220.0", "-1").replace("140.0", "x")), "mit_supercloud")


def test_local_reader_replaces_collected_labels(spark, tmp_path):
    _write(
        tmp_path / "gpu_telemetry.csv",
        "timestamp,gpu_id,gpu_utilization_pct,memory_utilization_pct,temperature_c,power_watts,session_id,workload_type\n"
        "2026-06-05 20:00:00,0,70,60,63,210,lab_b_gpu_0,stress_run\n",
    )
    row = read_telemetry(spark, "local_nvidia_smi", str(tmp_path)).first()
    assert row["power_watts"] == 210.0
    assert row["workload_type"] == "local_nvidia_smi_gpu_trace"
    assert row["session_id"] == "gpu_telemetry_gpu_0"
    kept = read_wide_csv(spark, str(tmp_path), "local_nvidia_smi", keep_session_id=True).first()
    assert kept["session_id"] == "lab_b_gpu_0"


def test_first_present_and_names(spark):
    assert first_present(["b", "c"], ("a", "c", "b")) == "c"
    assert first_present(["x"], ("a",)) is None
    assert coerce.clean_name("  Power Draw (W) ") == "power_draw_w"
    assert stem("/a/b/x.tar.csv") == "x.tar" and stem("plain") == "plain"
    with pytest.raises(ValueError, match="collide"):
        coerce.with_clean_names(spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int"))


def test_long_csv(spark, tmp_path):
    text = (
        "ts,dv,mt,vl\n"
        "2025-01-01 00:00:00,n1,gpu0_power_usage_report,100\n2025-01-01 00:00:00,n1,gpu0_power_usage_report,110\n"
        "2025-01-01 00:00:00,n1,gpu0_temp,50\nbad,n1,gpu0_temp,50\n2025-01-01 00:00:01,n2,gpu0_temp,51\n2025-01-01 00:00:01,n2,gpu0_mem_util,oops\n"
    )
    df = read_telemetry(spark, "nrel_eagle", _write(tmp_path / "long.csv", text))
    rows = {r["session_id"]: r for r in df.collect()}
    assert rows["n1"]["power_watts"] == 105.0 and rows["n1"]["temperature_c"] == 50.0
    assert rows["n2"]["power_watts"] is None and rows["n2"]["workload_type"] == "unknown"
    with pytest.raises(ValueError, match="missing"):
        long_csv.scan_long_csv(spark, _write(tmp_path / "x.csv", "ts,dv\n1,2\n"))
    with pytest.raises(ValueError, match="GPU power metric"):
        long_csv.read_long_csv(spark, _write(tmp_path / "y.csv", "ts,dv,mt,vl\n2025-01-01 00:00:00,n,gpu0_temp,1\n"))


def test_trace_csv_rows(spark, tmp_path):
    path = _write(tmp_path / "a.csv", '#c1\n#c2\n_time,a,b\n1,2,3\n# note\n1,2\n1,2,3,4\n"x,y","p,q",3\n')
    assert [h for h, _ in headers(spark, str(tmp_path))] == [["_time", "a", "b"]]
    df = read_trace_csv(spark, ["_time", "a", "b"], [path])
    assert df.count() == 3  # the row with a field too many is gone, the short one is padded
    assert [r["a"] for r in df.select("a").collect()] == ["2", "2", "p,q"]
    assert {r["source_file"] for r in df.collect()} == {"a"}


def _trace(n, offset, extra):
    lines = [f"#export\n_time,device_id,util_gpu0,temp_gpu0,power_gpu0,mem_used_gpu0,mem_total_gpu0,fan_vin{',' + extra if extra else ''}"]
    for i in range(n):
        u = (i * 7 + offset) % 100
        lines.append(
            f"2025-01-01T00:{i // 60:02d}:{i % 60:02d}Z,d,{u},{40000 + 100 * u},{100000 + 1300 * u + (i * i % 17) * 900},{i % 50},80,{12}"
            + (f",{i % 9}" if extra else "")
        )
    return "\n".join(lines) + "\n"


def test_bmc_folder(spark, tmp_path):
    _write(tmp_path / "run_a.csv", _trace(120, 0, ""))
    _write(tmp_path / "run_b.csv", _trace(120, 3, "cpu_load"))
    _write(tmp_path / "notes.txt", "not a trace\n")
    df = read_telemetry(spark, "bmcdata_public", str(tmp_path), max_files=5)
    rows = df.collect()
    assert len(rows) == 240
    assert {r["session_id"] for r in rows} == {"run_a", "run_b"}
    assert "fan_vin" not in df.columns  # a power channel by name
    assert max(r["temperature_c"] for r in rows) < 60  # milli-degrees were repaired
    assert 90 < min(r["power_watts"] for r in rows) < max(r["power_watts"] for r in rows) < 300
    assert all(r["memory_utilization_pct"] == pytest.approx(100 * r["mem_used_gpu0"] / 80) for r in rows)
    assert sum(r["cpu_load"] is not None for r in rows) == 120
    assert read_telemetry(spark, "bmcdata_public", str(tmp_path), max_files=1).select("session_id").distinct().count() == 1
    with pytest.raises(ValueError, match="No CSV"):
        bmc_csv.read_bmc_folder(spark, str(tmp_path / "none"))


def test_bmc_guards_keep_keys_on_tiny_input(spark, tmp_path):
    _write(tmp_path / "t.csv", _trace(10, 0, ""))
    df = read_telemetry(spark, "bmcdata_public", str(tmp_path))
    assert {"power_watts", "timestamp", "session_id"} <= set(df.columns) and df.count() == 10


def test_bmc_target_rules(spark):
    both = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "PSU1_Total_Power double, PSU2_Total_Power double")
    assert [r["power_watts"] for r in bmc_csv.infer_target(both).collect()] == [1.0, 5.0]
    one = both.drop("PSU2_Total_Power")
    assert bmc_csv.infer_target(one).columns == ["power_watts"]
    with pytest.raises(ValueError, match="infer a power target"):
        bmc_csv.infer_target(spark.createDataFrame([(1,)], "x int"))
    assert bmc_csv.unit_divisor("Inlet_Temp", 30_000.0) == 1000.0
    assert bmc_csv.unit_divisor("psu_power", 2_000_000.0) == 1_000_000.0
    assert bmc_csv.unit_divisor("psu_power", 6_000.0) == 1000.0
    assert bmc_csv.unit_divisor("inlet_power", 10_000.0) == 1000.0
    assert bmc_csv.unit_divisor("power", None) == 1.0


LINE = "2026/06/05 20:00:00.000, 0, NVIDIA A100, GPU-abc, 72, [Not Supported], 1410, 1215, 64, 215.5"


def test_monitor_lines(spark):
    lines = spark.createDataFrame([(LINE,), ("  ",), ("a, b",)], "value string")
    row = label_samples(parse_lines(lines, strict=False), "lab_a", "stress_run").collect()
    assert len(row) == 1
    assert row[0]["power_watts"] == 215.5 and row[0]["memory_utilization_pct"] is None
    assert row[0]["session_id"] == "lab_a_gpu_0"
    assert malformed_lines(lines).first()["fields"] == 2
    with pytest.raises(Exception, match="Unexpected monitor line with 2 fields"):
        parse_lines(lines).collect()


def test_monitor_numbers_are_read_by_one_expression(spark):
    lines = spark.createDataFrame([(" a , 1 ,n,u, 1 ,[Not Supported], x ,4e1,,6 ",), ("a,b,",), (None,), ("  ",)], "value string")
    rows = parse_lines(lines, strict=False)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 4  # of one number, not of six
    assert [tuple(r) for r in rows.collect()] == [("a", "1", "n", "u", 1.0, None, None, 40.0, None, 6.0)]
    assert [tuple(r) for r in malformed_lines(lines).collect()] == [("a,b,", 3)]


@pytest.mark.parametrize(
    "document", [{"records": [{"a": 1.0}, {"a": 2.0}]}, [{"a": 1.0}, {"a": 2.0}], {"a": 1.0}],
)
def test_records(spark, tmp_path, document):
    path = _write(tmp_path / "in.json", json.dumps(document, indent=1))
    got = sorted(r["a"] for r in read_records(spark, path).collect())
    assert got == ([1.0] if isinstance(document, dict) and "a" in document else [1.0, 2.0])


def test_records_csv(spark, tmp_path):
    assert read_records(spark, _write(tmp_path / "in.csv", "a,b\n1,x\n")).first()["b"] == "x"


def test_number_and_time_parsing(spark):
    texts = ["1", " 2.5 ", "1e3", "1d", "nan", "inf", "1e999", "", None, "0x10", "-.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(coerce.to_number(F.col("t"))).collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, None, None, None, None, None, -0.5]
    times = ["2025-01-02T03:04:05Z", "2025-01-02 03:04:05+02:00", "2025/01/02 03:04:05.250", "x", "2025-13-01"]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    got = [str(r[0]) for r in df.select(coerce.to_time(F.col("t"))).collect()]
    assert got == ["2025-01-02 03:04:05", "2025-01-02 01:04:05", "2025-01-02 03:04:05.250000", "None", "None"]


def test_epoch_micros_ignores_the_session_zone(spark):
    df = spark.createDataFrame([("2025-03-30 02:30:00.000001",), ("1969-12-31 23:59:59.5",)], "t string").select(
        coerce.epoch_micros(F.col("t").cast("timestamp_ntz")).alias("m")
    )
    want = [1743301800000001, -500000]
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r["m"] for r in df.collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_log_is_appended_and_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, None, 5.0), (1, math.pi, "a", 6.0)], "row_index int, x double, w string, prediction double")
    path = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_log(sinks.log_rows(df, ["x", "w"], "m", "v"), path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert len(lines) == 4
    assert set(lines[0]) == {"logged_at_utc", "model_name", "model_version", "row_index", "predicted_power_watts", "inputs"}
    assert any(x["inputs"] == {"x": 1.0, "w": None} for x in lines)


def test_csv_sink_flattens_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>")
    path = sinks.write_table(df, str(tmp_path), "t", "csv")
    assert spark.read.option("header", True).option("escape", "\\").csv(path).count() == 1
