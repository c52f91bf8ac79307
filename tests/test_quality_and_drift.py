"""Summaries, checks, audits, profiles and drift."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import audit, checks, drift, metrics, quality
from wattline.operators.columns import column_difference, feature_columns, feature_families, family_table, select_features
from wattline.sources import sinks

TEXT = ["session_id", "workload_type"]
NUM = ["gpu_utilization_pct", "temperature_c"]


def test_summary_and_checks_flag_small_generated_data(telemetry):
    small = telemetry.drop("k1", "k2").limit(80)
    row = checks.dataset_summary(small, "synthetic").first()
    assert (row["source"], row["data_kind"], row["n_rows"]) == ("synthetic", "synthetic", 80)
    codes = {r["code"] for r in checks.suitability_checks(small, "synthetic").collect()}
    assert {"synthetic_data_mode", "small_dataset", "grouped_validation_not_ready"} <= codes


def test_checks_on_an_empty_frame(telemetry):
    codes = {r["code"] for r in checks.suitability_checks(telemetry.limit(0), "nrel_eagle").collect()}
    assert {"small_dataset", "grouped_validation_not_ready", "no_valid_unit_values"} <= codes
    assert checks.dataset_summary(telemetry.limit(0), "nrel_eagle").first()["n_rows"] == 0


def test_unit_range_and_missing_columns(telemetry):
    bad = telemetry.drop("timestamp", "power_watts").withColumn("gpu_utilization_pct", F.lit(150.0))
    found = checks.suitability_checks(bad, "mit_supercloud").collect()
    by = {(r["code"], r["feature"]) for r in found}
    assert ("unit_range_check", "gpu_utilization_pct") in by
    assert ("missing_required_columns", "power_watts") in by
    assert ("missing_recommended_column", "timestamp") in by
    rolled = checks.severity_rollup(checks.suitability_checks(bad, "mit_supercloud")).first()
    assert rolled["status"] == "error" and rolled["errors"] == 1
    row = checks.dataset_summary(bad.drop("session_id"), "mit_supercloud").first()
    assert row["unique_sessions"] == 0 and row["median_rows_per_session"] is None and not row["has_target"]


def test_audit_flags_copies_and_survives_constants(spark):
    t = np.linspace(10, 100, 120)
    pdf = pd.DataFrame({"power_watts": t, "power_proxy": t, "safe": np.random.default_rng(0).normal(size=120), "flat": 1.0})
    found = {r["feature"]: r for r in audit.audit(spark.createDataFrame(pdf)).collect()}
    assert found["power_proxy"]["name_leakage_risk"] and found["power_proxy"]["corr_leakage_risk"]
    assert not found["safe"]["corr_leakage_risk"]
    assert found["flat"]["abs_corr_with_target"] is None and not found["flat"]["corr_leakage_risk"]
    few = spark.createDataFrame(pdf.head(8))
    assert {r["abs_corr_with_target"] for r in audit.audit(few).collect()} == {None}
    assert audit.leaking_columns(spark.createDataFrame(pdf.head(11))) == []
    assert audit.leaking_columns(spark.createDataFrame(pdf.head(12))) == ["power_proxy"]
    with pytest.raises(ValueError, match="nothing to audit"):
        audit.audit(few.drop("power_watts"))


def test_many_columns_are_handled_in_groups(spark):
    names = [f"c{i:02d}" for i in range(21)]
    pdf = pd.DataFrame(np.random.default_rng(1).normal(size=(60, 22)), columns=["power_watts", *names])
    df = spark.createDataFrame(pdf)
    got = {r["feature"]: r["corr"] for r in audit.target_correlations(df, names).collect()}
    assert got == pytest.approx({c: pdf[c].corr(pdf["power_watts"]) for c in names})
    profile = {r["feature"]: r["p50"] for r in drift.reference_profile(df, names, []).collect()}
    assert profile == pytest.approx({c: pdf[c].median() for c in names})
    report = drift.drift_report(drift.reference_profile(df, names, []), df)
    assert report.where("severity = 'warning'").count() == 0 and report.where("check = 'mean_shift_std'").count() == 21


def test_flat_and_sparse_columns(spark):
    n = 1000
    pdf = pd.DataFrame({"power_watts": 1.0, "rare": [1.0 if i < 49 else None for i in range(n)], "ok": np.arange(n, dtype=float), "none": [None] * n})
    df = spark.createDataFrame(pdf, "power_watts double, rare double, ok double, none double")
    assert audit.flat_columns(df) == ["rare", "none"]
    assert audit.sparse_columns(df) == ["rare", "none"]


def test_families_and_selection(spark, telemetry):
    families = feature_families(["power_watts", "gpu_utilization_pct", "temp_sensor", "board_power_like", "workload_type", "cpu_load", "timestamp"])
    assert all("power_watts" not in c and "board_power_like" not in c for c in families.values())
    assert families["gpu_only"] == ["gpu_utilization_pct", "workload_type"]
    assert families["system_only"] == ["cpu_load", "temp_sensor"]
    assert family_table(spark, telemetry.columns).count() > 0
    numbers, texts = feature_columns(telemetry)
    assert texts == ["session_id", "workload_type"] and "power_watts" not in numbers
    assert select_features(telemetry, ["ambient_c"], keys=["k1"]).columns == ["ambient_c", "power_watts", "k1"]
    with pytest.raises(ValueError, match="None of the selected"):
        select_features(telemetry, ["nothing"])


def test_column_difference_with_empty_sides(spark):
    assert column_difference(spark, [], ["a"]).collect()[0]["side"] == "extra"
    assert column_difference(spark, ["a"], []).collect()[0]["side"] == "missing"
    assert column_difference(spark, ["a"], ["a"]).count() == 0


def test_target_quality(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)] + [(None,), (50_000.0,)], "power_watts double")
    row = quality.target_quality(df).first()
    assert row["count"] == 101 and row["missing_targets"] == 1 and row["median"] == 51.0
    assert row["invalid_grouped_metric_risk"]
    with pytest.raises(ValueError, match="is a number"):
        quality.target_quality(df.where("power_watts is null"))
    with pytest.raises(ValueError, match="to summarise"):
        quality.target_quality(df, target="other")


def test_profile_matches_pandas_and_round_trips(spark, telemetry, tmp_path):
    profile = drift.reference_profile(telemetry, [*NUM, "not_there"], TEXT)
    sinks.save_profile(profile, str(tmp_path / "run" / "monitoring"))
    loaded = {r["feature"]: r for r in sinks.load_profile(spark, str(tmp_path / "run")).collect()}
    pdf = telemetry.toPandas()
    x = pdf["temperature_c"]
    row = loaded["temperature_c"]
    assert row["mean"] == pytest.approx(x.mean()) and row["std"] == pytest.approx(x.std(ddof=0))
    assert (row["p05"], row["p50"], row["p95"]) == pytest.approx(tuple(x.quantile([0.05, 0.5, 0.95])))
    assert [loaded[c]["ordinal"] for c in [*NUM, "not_there", *TEXT]] == [0, 1, 2, 3, 4]
    counts = pdf["workload_type"].value_counts()
    assert loaded["workload_type"]["unique_count"] == len(counts)
    assert loaded["workload_type"]["top_values"][0]["count"] == counts.iloc[0]
    assert drift.profile_warnings(telemetry.limit(3), ["a"])[0].startswith("Only 3")
    with pytest.raises(FileNotFoundError):
        sinks.load_profile(spark, str(tmp_path / "nowhere"))


def test_drift_warns_for_shift_and_small_input(telemetry):
    profile = drift.reference_profile(telemetry, NUM, TEXT)
    new = telemetry.limit(6).withColumn("gpu_utilization_pct", F.lit(999.0)).drop("power_watts")
    warned = {(r["check"], r["feature"]) for r in drift.drift_report(profile, new).collect() if r["severity"] == "warning"}
    assert ("small_input_sample", "__dataset__") in warned
    assert ("outside_reference_range_share", "gpu_utilization_pct") in warned
    assert ("mean_shift_std", "gpu_utilization_pct") in warned
    with pytest.raises(ValueError, match="has no rows"):
        drift.drift_report(profile, telemetry.limit(0))


def test_drift_with_bad_text_and_constant_reference(spark):
    reference = spark.createDataFrame([(5.0, "a")] * 30, "x double, w string")
    profile = drift.reference_profile(reference, ["x"], ["w"])
    new = spark.createDataFrame([("bad", "b")] * 25 + [("5.0", "a")] * 5, "x string, w string")
    got = {r["check"]: r for r in drift.drift_report(profile, new).where("feature in ('x', 'w')").collect() if r["feature"] == "x" or r["check"] == "unseen_category_share"}
    assert got["non_numeric_values"]["input_value"] == 25
    assert got["missing_rate_delta"]["severity"] == "warning"
    assert got["mean_shift_std"]["severity"] == "ok"
    assert got["unseen_category_share"]["input_value"] == pytest.approx(25 / 30)
    none = drift.drift_report(profile, spark.createDataFrame([("bad", None)], "x string, w string"))
    checks_found = {r["check"] for r in none.where("feature = 'x'").collect()}
    assert "no_valid_numeric_values" in checks_found and "mean_shift_std" not in checks_found


def test_truncated_categories_are_judged_with_their_table(spark):
    reference = spark.range(500).select(F.col("id").cast("string").alias("w"))
    profile = drift.reference_profile(reference, [], ["w"])
    row = profile.first()
    assert row["categories_truncated"] and len(row["categories"]) == 100 and len(row["top_values"]) == 20
    new = spark.createDataFrame([("new",)] * 30 + [("499",)] * 10, "w string")
    report = drift.drift_report(profile, new)
    assert report.where("check = 'unseen_category_share'").first()["severity"] == "info"
    judged = drift.drift_report(profile, new, categories=drift.value_counts(reference, ["w"]))
    check = judged.where("check = 'unseen_category_share'").first()
    assert (check["severity"], check["input_value"], check["reference_value"]) == ("warning", 0.75, 500.0)
    assert drift.unseen_values(spark.createDataFrame([("new",)], "w string"), profile).count() == 0


def test_metrics_match_numpy_and_handle_flat_targets(spark):
    rng = np.random.default_rng(4)
    y, e = rng.normal(100, 10, 400), rng.normal(0, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "power_watts": y, "prediction": y + e}))
    row = metrics.regression_metrics(df).first()
    assert row["mae"] == pytest.approx(np.abs(e).mean()) and row["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert row["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    res = metrics.residual_diagnostics(df).first()
    assert res["residual_bias"] == pytest.approx(-e.mean()) and res["residual_std"] == pytest.approx(e.std())
    assert res["residual_p95_abs"] == pytest.approx(np.percentile(np.abs(e), 95))
    flat = spark.createDataFrame([("m", 5.0, 5.0), ("m", 5.0, 5.0), ("n", 5.0, 6.0), ("n", 5.0, 6.0)], "model string, power_watts double, prediction double")
    assert {r["model"]: r["r2"] for r in metrics.regression_metrics(flat).collect()} == {"m": 1.0, "n": 0.0}
    bins = metrics.residual_histogram(df).orderBy("bin").collect()
    assert [b["rows"] for b in bins] == np.histogram(-e, bins=40)[0].tolist()
    assert sum(b["rows"] for b in metrics.residual_histogram(flat.where("model = 'm'")).collect()) == 2


def test_leaderboard_and_pairs(spark):
    df = spark.createDataFrame([("b", 1.0, 2.0, 0.5), ("a", 1.0, 2.0, 0.6), ("c", 0.1, 0.2, 0.9)], "model string, mae double, rmse double, r2 double")
    assert [r["model"] for r in metrics.leaderboard(df).collect()] == ["c", "a", "b"]
    assert metrics.best_model(df).first()["model"] == "c"
    assert metrics.metric_pairs(df).count() == 9
    assert metrics.parameter_pairs(df, {"source": "x", "none": None}).collect() == [("source", "x")]
