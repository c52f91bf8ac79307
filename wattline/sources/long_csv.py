"""Long-format (time, device, metric, value) telemetry: scan, pivot and rename."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.contract import SESSION, TIMESTAMP
from wattline.functions.coerce import as_time, numeric
from wattline.sources.files import read_text_csv

KEYS = ("ts", "dv", "mt", "vl")
# Columns that a wide table may get from metric names nobody listed.
MAX_METRICS = 2000
# Metric names and the normalised column each one becomes.
METRIC_NAMES = {
    "gpu0_power_usage_report": "power_watts",
    "gpu0_mem_util": "memory_utilization_pct",
    "gpu0_graphics_clock_report": "graphics_clock_mhz",
    "gpu0_temp": "temperature_c",
    "gpu0_encoder_util": "gpu_utilization_pct",
}


def typed_readings(raw: DataFrame) -> DataFrame:
    """Parse times and values and drop rows that lack any of the four fields."""
    gone = sorted(set(KEYS) - set(raw.columns))
    if gone:
        raise ValueError(f"Long-format CSV needs columns {sorted(KEYS)}; missing {gone}.")
    typed = raw.select(as_time(raw, "ts").alias("ts"), F.col("dv").cast("string").alias("dv"), "mt", numeric(raw, "vl").alias("vl"))
    return typed.dropna(subset=list(KEYS))


def scan_long_csv(spark: SparkSession, path: str) -> DataFrame:
    return typed_readings(read_text_csv(spark, path))


def metric_names(readings: DataFrame, most: int = MAX_METRICS) -> list[str]:
    """Distinct metric names, which become columns; more than ``most`` is an error.

    A dirty metric column can hold a name per row; ``metric_maps`` takes any number.
    """
    found = [r["mt"] for r in readings.select("mt").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"Over {most} metric names can't become columns. Name the metrics, or use metric_maps.")
    return sorted(found)


def metric_maps(readings: DataFrame) -> DataFrame:
    """One row per (ts, dv) with a map from metric name to mean, however many names there are."""
    means = readings.groupBy("ts", "dv", "mt").agg(F.avg("vl").alias("vl"))
    entries = F.sort_array(F.collect_list(F.struct("mt", "vl")))
    return means.groupBy("ts", "dv").agg(F.map_from_entries(entries).alias("metrics"))


def pivot_readings(readings: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per (ts, dv) with the mean of each metric; a metric not seen is null."""
    metrics = list(metrics) if metrics is not None else metric_names(readings)
    return readings.groupBy("ts", "dv").pivot("mt", metrics).agg(F.avg("vl"))


def rename_metrics(wide: DataFrame) -> DataFrame:
    """Normalised names plus timestamp, session and an unknown workload."""
    if "gpu0_power_usage_report" not in wide.columns:
        raise ValueError("The CSV has no GPU power metric 'gpu0_power_usage_report'.")
    return wide.withColumnsRenamed(METRIC_NAMES).withColumns(
        {
            TIMESTAMP: F.col("ts"),
            SESSION: F.col("dv").cast("string"),
            "workload_type": F.lit("unknown"),
        }
    )


def read_long_csv(spark: SparkSession, path: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """Normalised telemetry from a long-format CSV."""
    return rename_metrics(pivot_readings(scan_long_csv(spark, path), metrics))


