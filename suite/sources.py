"""Sources and sinks. Files are derived from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.views import FEATURES, KEYS, readings, table, tel, telemetry
from wattline.functions.scalars import analytic_power_of_row
from wattline.operators.drift import reference_profile
from wattline.operators.metrics import regression_metrics
from wattline.operators.ordering import row_index
from wattline.operators.quality import preview
from wattline.session import spool_path
from wattline.sources import sinks
from wattline.sources.bmc_csv import normalize_bmc, pick_trace_files, scan_bmc_csv
from wattline.sources.long_csv import read_long_csv, scan_long_csv
from wattline.sources.records import read_records
from wattline.sources.smi_text import label_samples, malformed_lines, read_smi_text
from wattline.sources.wide_csv import read_wide_csv


def _csv(df, label):
    path = spool_path(df.sparkSession, label) + ".csv"
    df.write.option("header", True).csv(path)
    return path


@query(
    "src_02_long_csv",
    """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, CAST(user_id AS VARCHAR) AS dv, event_type AS mt, value AS vl
    FROM events WHERE event_id % 17 <> 0 AND (event_id % 19 = 0 OR event_id % 13 <> 0) AND value IS NOT NULL""",
)
def long_csv(spark, sf_dir):
    raw = readings(spark, sf_dir).select("ts", "dv", "mt", F.col("dirty").alias("vl"))
    return scan_long_csv(spark, _csv(raw, "long"))


@query(
    "src_02_long_csv_wide",
    """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS "timestamp", CAST(user_id AS VARCHAR) AS session_id,
       'unknown' AS workload_type,
       round(avg(value) FILTER (event_type = 'purchase'), 6) AS power_watts,
       round(avg(value) FILTER (event_type = 'view'), 6) AS gpu_utilization_pct
    FROM events GROUP BY 1, 2""",
)
def long_csv_wide(spark, sf_dir):
    metric = (
        F.when(F.col("mt") == "purchase", "gpu0_power_usage_report")
        .when(F.col("mt") == "view", "gpu0_encoder_util")
        .otherwise(F.col("mt"))
    )
    raw = readings(spark, sf_dir).select("ts", "dv", metric.alias("mt"), "vl")
    wide = read_long_csv(spark, _csv(raw, "long"))
    return wide.select(
        "timestamp", "session_id", "workload_type",
        F.round("power_watts", 6).alias("power_watts"),
        F.round("gpu_utilization_pct", 6).alias("gpu_utilization_pct"),
    )


def _wide_raw(spark, sf_dir):
    return telemetry(spark, sf_dir).select(
        F.col("k1").alias("job_id"),
        F.col("timestamp"),
        F.col("k2").alias("gpu"),
        F.col("gpu_utilization_pct").alias("utilization gpu pct"),
        F.col("memory_utilization_pct").alias("utilization memory pct"),
        F.col("temperature_c").alias("temperature gpu"),
        F.when(F.col("k1") % 11 == 0, F.lit("N/A")).otherwise(F.col("power_watts").cast("string")).alias("power draw W"),
        F.col("graphics_clock_mhz").alias("clocks sm MHz"),
        F.col("memory_clock_mhz").alias("clocks mem MHz"),
    )


@query(
    "src_03_wide_csv",
    tel(
        """ SELECT CAST(k1 AS VARCHAR) || '_gpu_' || CAST(k2 AS VARCHAR) AS session_id, "timestamp",
        CAST(k2 AS VARCHAR) AS gpu_id, 'mit_supercloud_gpu_trace' AS workload_type, 'dcgm.csv' AS source_file,
        round(power_watts, 6) AS power_watts, gpu_utilization_pct, round(temperature_c, 6) AS temperature_c
        FROM telemetry WHERE k1 % 11 <> 0 AND power_watts > 0 AND power_watts < 2000"""
    ),
)
def wide_csv(spark, sf_dir):
    folder = spool_path(spark, "wide")
    _wide_raw(spark, sf_dir).write.option("header", True).csv(f"{folder}/dcgm.csv")
    df = read_wide_csv(spark, folder, "mit_supercloud")
    return df.select(
        "session_id", "timestamp", "gpu_id", "workload_type", "source_file",
        F.round("power_watts", 6).alias("power_watts"), "gpu_utilization_pct",
        F.round("temperature_c", 6).alias("temperature_c"),
    )


def _trace_file(df, label):
    """CSV with comment lines and rows that have two fields too many.

    Each line is written as one value under a one-column header that is itself the
    comma-separated header line, so nothing gets quoted.
    """
    path = spool_path(df.sparkSession, label) + ".csv"
    names = [c for c in df.columns if c != "_k"]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in names])
    line = F.when(F.col("_k") % 50 == 0, F.concat(F.lit("# note "), line)).otherwise(line)
    line = F.when(F.col("_k") % 70 == 7, F.concat(line, F.lit(",9,9"))).otherwise(line)
    out = df.select(line.alias(",".join(names))).write.option("header", True)
    out.option("sep", "\u0001").option("comment", "\u0002").option("quote", "").csv(path)
    return path


def _trace(spark, sf_dir):
    return telemetry(spark, sf_dir).select(
        F.col("k1").alias("_k"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_time"),
        F.lit("").alias("result"),
        F.col("session_id").alias("device_id"),
        F.col("gpu_utilization_pct").alias("util_gpu0"),
        F.col("temperature_c").alias("temp_gpu0"),
        F.col("power_watts").alias("power_gpu0"),
        F.col("ambient_c").alias("inlet_c"),
        F.col("memory_utilization_pct").alias("mem_used_gpu0"),
        F.lit(1000.0).alias("mem_total_gpu0"),
    )


_TRACE_ROWS = "k1 % 50 <> 0 AND k1 % 70 <> 7"


@query(
    "src_04_bmc_csv",
    tel(
        f""" SELECT session_id AS device_id, count(*) AS "rows", round(sum(gpu_utilization_pct), 4) AS util,
        round(sum(power_watts), 4) AS power FROM telemetry WHERE {_TRACE_ROWS} GROUP BY 1"""
    ),
)
def bmc_csv(spark, sf_dir):
    df = scan_bmc_csv(spark, _trace_file(_trace(spark, sf_dir), "bmc"))
    return df.groupBy("device_id").agg(
        F.count("*").alias("rows"),
        F.round(F.sum(F.col("util_gpu0").cast("double")), 4).alias("util"),
        F.round(F.sum(F.col("power_gpu0").cast("double")), 4).alias("power"),
    )


@query(
    "src_05_concat_headers",
    tel(
        f""" SELECT count(*) AS "rows", count(CASE WHEN workload_type LIKE 'A%' THEN gpu_utilization_pct END) AS with_util,
        count(CASE WHEN workload_type LIKE 'A%' THEN NULL ELSE ambient_c END) AS with_inlet,
        round(sum(power_watts), 4) AS power FROM telemetry WHERE {_TRACE_ROWS}"""
    ),
)
def concat_headers(spark, sf_dir):
    both = telemetry(spark, sf_dir)
    is_a = F.col("workload_type").startswith("A")

    def part(keep, columns):
        rows = both.where(keep).select(
            F.col("k1").alias("_k"),
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_time"),
            F.col("gpu_utilization_pct").alias("util_gpu0"),
            F.col("ambient_c").alias("inlet_c"),
            F.col("power_watts").alias("power_gpu0"),
        )
        return _trace_file(rows.select("_k", "_time", *columns), "part")

    paths = [part(is_a, ["util_gpu0", "power_gpu0"]), part(~is_a, ["inlet_c", "power_gpu0"])]
    df = scan_bmc_csv(spark, paths)
    return df.agg(
        F.count("*").alias("rows"),
        F.count("util_gpu0").alias("with_util"),
        F.count("inlet_c").alias("with_inlet"),
        F.round(F.sum(F.col("power_gpu0").cast("double")), 4).alias("power"),
    )


@query(
    "src_05_bmc_normalized",
    tel(
        f""", merged AS (
          SELECT "timestamp", avg(gpu_utilization_pct) AS gpu_utilization_pct, avg(temperature_c) AS temperature_c,
                 avg(power_watts) AS power_watts, avg(ambient_c) AS inlet_c, avg(memory_utilization_pct) AS mem_used_gpu0,
                 avg(memory_utilization_pct) / 1000.0 * 100.0 AS memory_utilization_pct
          FROM telemetry WHERE {_TRACE_ROWS} GROUP BY 1)
        SELECT "timestamp", round(power_watts, 6) AS power_watts, round(gpu_utilization_pct, 6) AS gpu_utilization_pct,
               round(temperature_c, 6) AS temperature_c, round(inlet_c, 6) AS inlet_c,
               round(memory_utilization_pct, 6) AS memory_utilization_pct, 'bmc_real_trace' AS workload_type
        FROM merged WHERE power_watts > 0 AND power_watts < 2000"""
    ),
)
def bmc_normalized(spark, sf_dir):
    # File stems of a distributed write are random, so rows are merged by time alone.
    raw = scan_bmc_csv(spark, _trace_file(_trace(spark, sf_dir), "bmc")).drop("source_file")
    df = normalize_bmc(raw)
    numbers = ["power_watts", "gpu_utilization_pct", "temperature_c", "inlet_c", "memory_utilization_pct"]
    return df.select("timestamp", *[F.round(c, 6).alias(c) for c in numbers], "workload_type")


def _monitor_lines(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    util = F.when(F.col("k1") % 9 == 0, "[Not Supported]").otherwise(F.col("gpu_utilization_pct").cast("string"))
    line = F.concat_ws(
        ", ",
        F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss.SSS"), F.col("k2").cast("string"), F.lit("ACC-1"), F.col("session_id"),
        util, F.col("memory_utilization_pct").cast("string"), F.col("graphics_clock_mhz").cast("string"),
        F.col("memory_clock_mhz").cast("string"), F.col("temperature_c").cast("string"), F.col("power_watts").cast("string"),
    )
    return t.select(
        F.when(F.col("k1") % 31 == 0, F.lit("   ")).when(F.col("k1") % 37 == 0, F.concat(line, F.lit(", extra"))).otherwise(line).alias("value")
    )


@query(
    "src_06_monitor_text",
    tel(
        """ SELECT CAST(k2 AS VARCHAR) AS gpu_id, 'run_gpu_' || CAST(k2 AS VARCHAR) AS session_id, 'bench' AS workload_type,
        session_id AS gpu_uuid, count(*) AS "rows",
        round(sum(CASE WHEN k1 % 9 = 0 THEN NULL ELSE gpu_utilization_pct END), 4) AS util,
        round(sum(power_watts), 4) AS power FROM telemetry WHERE k1 % 31 <> 0 AND k1 % 37 <> 0 GROUP BY 1, 2, 3, 4"""
    ),
)
def monitor_text(spark, sf_dir):
    path = spool_path(spark, "monitor")
    _monitor_lines(spark, sf_dir).write.text(path)
    rows = label_samples(read_smi_text(spark, path, strict=False), "run", "bench")
    return rows.groupBy("gpu_id", "session_id", "workload_type", "gpu_uuid").agg(
        F.count("*").alias("rows"),
        F.round(F.sum("gpu_utilization_pct"), 4).alias("util"),
        F.round(F.sum("power_watts"), 4).alias("power"),
    )


@query(
    "src_06_malformed_lines",
    tel(" SELECT CAST(11 AS BIGINT) AS fields, count(*) AS lines FROM telemetry WHERE k1 % 31 <> 0 AND k1 % 37 = 0"),
)
def bad_lines(spark, sf_dir):
    return malformed_lines(_monitor_lines(spark, sf_dir)).groupBy("fields").agg(F.count("*").alias("lines"))


@query(
    "src_07_records",
    tel(
        """ SELECT workload_type, count(*) AS "rows", count(gpu_utilization_pct) AS with_util,
        round(sum(CASE WHEN k1 % 2 = 0 THEN gpu_utilization_pct END), 4) AS even_util
        FROM (SELECT * REPLACE (CASE WHEN k1 % 5 = 0 THEN NULL ELSE gpu_utilization_pct END AS gpu_utilization_pct) FROM telemetry)
        GROUP BY 1"""
    ),
)
def records(spark, sf_dir):
    path = spool_path(spark, "records") + ".jsonl"
    t = telemetry(spark, sf_dir).withColumn("gpu_utilization_pct", F.when(F.col("k1") % 5 != 0, F.col("gpu_utilization_pct")))
    one = F.struct("k1", "gpu_utilization_pct", "workload_type")
    # Odd orders send a records list, even orders one bare object.
    bare, listed = F.to_json(one), F.to_json(F.struct(F.array(one).alias("records")))
    t.select(F.when(F.col("k1") % 2 == 0, bare).otherwise(listed).alias("value")).write.text(path)
    df = read_records(spark, path)
    return df.groupBy("workload_type").agg(
        F.count("*").alias("rows"),
        F.count("gpu_utilization_pct").alias("with_util"),
        F.round(F.sum(F.when(F.col("k1") % 2 == 0, F.col("gpu_utilization_pct"))), 4).alias("even_util"),
    )


@query(
    "src_08_trace_choice",
    """SELECT name FROM (SELECT DISTINCT s_name || '.csv' AS name FROM supplier WHERE s_suppkey % 3 <> 0)
    ORDER BY md5('42:' || name), name LIMIT 10""",
)
def trace_choice(spark, sf_dir):
    ending = F.when(F.col("s_suppkey") % 3 == 0, ".txt").otherwise(".csv")
    return pick_trace_files(table(spark, sf_dir, "supplier").select(F.concat("s_name", ending).alias("name")), 10, 42)


_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,
    min({c}) AS "min", max({c}) AS "max", round(quantile_cont({c}, 0.05), 6) AS p05,
    round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95 FROM telemetry"""
    for c in ("gpu_utilization_pct", "ambient_c")
)


@query("src_09_profile_load", tel(" " + _PROFILE_SQL))
def profile_load(spark, sf_dir):
    folder = spool_path(spark, "run")
    profile = reference_profile(telemetry(spark, sf_dir), ["gpu_utilization_pct", "ambient_c"], ["workload_type"])
    sinks.save_profile(profile, f"{folder}/monitoring")
    kept = sinks.load_profile(spark, folder).where("feature_type = 'numeric'")
    return kept.select(
        "feature", "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max",
        F.round("p05", 6).alias("p05"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"),
    )


_SCORE_SQL = """scored AS (
  SELECT *, 25 + 1.15::DOUBLE * gpu_utilization_pct + 0.45::DOUBLE * memory_utilization_pct
    + 0.018::DOUBLE * (graphics_clock_mhz - 900) + 0.008::DOUBLE * (memory_clock_mhz - 3200)
    + 0.75::DOUBLE * greatest(temperature_c - 45, 0) + 0.0025::DOUBLE * gpu_utilization_pct * memory_utilization_pct AS prediction
  FROM telemetry)"""


@query(
    "snk_01_report_tables",
    tel(
        f""", {_SCORE_SQL} SELECT workload_type AS model, round(avg(abs(power_watts - prediction)), 6) AS mae,
        round(sqrt(avg((power_watts - prediction) ** 2)), 6) AS rmse,
        round(1 - sum((power_watts - prediction) ** 2) / (count(*) * var_pop(power_watts)), 6) AS r2
        FROM scored GROUP BY 1"""
    ),
)
def report_tables(spark, sf_dir):
    scored = telemetry(spark, sf_dir).withColumn("prediction", analytic_power_of_row())
    metrics = regression_metrics(scored.withColumnRenamed("workload_type", "model"))
    paths = sinks.write_tables({"metrics": metrics}, spool_path(spark, "report"), "csv")
    back = spark.read.schema("model string, mae double, rmse double, r2 double").option("header", True).csv(paths["metrics"])
    return back.select("model", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query(
    "snk_02_profile_sink",
    tel(" SELECT 'workload_type' AS feature, count(*) AS \"count\", count(DISTINCT workload_type) AS unique_count FROM telemetry"),
)
def profile_sink(spark, sf_dir):
    path = sinks.save_profile(reference_profile(telemetry(spark, sf_dir), [], ["workload_type"]), spool_path(spark, "run"))
    return sinks.load_profile(spark, path).select("feature", "count", "unique_count")


@query(
    "snk_03_prediction_log",
    tel(
        f""", {_SCORE_SQL} SELECT 'baseline' AS model_name, 'v1' AS model_version, workload_type, count(*) AS "rows",
        count(*) FILTER (k1 % 5 = 0) AS without_util, round(sum(prediction), 4) AS predicted
        FROM scored GROUP BY 1, 2, 3"""
    ),
)
def prediction_log(spark, sf_dir):
    path = spool_path(spark, "log")
    scored = telemetry(spark, sf_dir).withColumn("prediction", analytic_power_of_row())
    scored = scored.withColumn("gpu_utilization_pct", F.when(F.col("k1") % 5 != 0, F.col("gpu_utilization_pct")))
    half = F.col("k1") % 2 == 0
    for part in (half, ~half):  # two calls append to one log
        indexed = row_index(scored.where(part), KEYS)
        sinks.append_log(sinks.log_rows(indexed, [*FEATURES, "workload_type"], "baseline", "v1"), path)
    log = spark.read.json(path)
    return log.groupBy("model_name", "model_version", F.col("inputs.workload_type").alias("workload_type")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("inputs.gpu_utilization_pct").isNull()).alias("without_util"),
        F.round(F.sum("predicted_power_watts"), 4).alias("predicted"),
    )


@query(
    "snk_04_preview",
    tel(
        """ SELECT k1, k2, "timestamp", session_id, workload_type, round(power_watts, 6) AS power_watts FROM telemetry
        ORDER BY k1, k2, "timestamp", session_id, power_watts LIMIT 10"""
    ),
)
def preview_rows(spark, sf_dir):
    rows = preview(telemetry(spark, sf_dir), ["k1", "k2", "timestamp", "session_id", "power_watts"])
    return rows.select("k1", "k2", "timestamp", "session_id", "workload_type", F.round("power_watts", 6).alias("power_watts"))
