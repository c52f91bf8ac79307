"""Stored monitor-tool output: comma-separated text lines to telemetry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.coerce import reading

# Field order of a line and the column each field becomes.
QUERY_FIELDS = (
    "timestamp", "index", "name", "uuid", "utilization.gpu",
    "utilization.memory", "clocks.sm", "clocks.mem", "temperature.gpu", "power.draw",
)
TEXT_FIELDS = ("timestamp", "gpu_id", "gpu_name", "gpu_uuid")
NUMBER_FIELDS = (
    "gpu_utilization_pct", "memory_utilization_pct", "graphics_clock_mhz",
    "memory_clock_mhz", "temperature_c", "power_watts",
)


def _fields(lines: DataFrame) -> DataFrame:
    """Lines that are not blank and ``__fields``, counted by separators: a line is split only once."""
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    return lines.where(F.trim("value") != "").withColumn("__fields", commas + 1)


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines that do not have ten fields."""
    bad = _fields(lines).where(F.col("__fields") != len(QUERY_FIELDS))
    return bad.select("value", F.col("__fields").cast("bigint").alias("fields"))


def parse_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of the ten fields. Blank lines are skipped; a malformed line fails when
    ``strict`` and is left out otherwise (see :func:`malformed_lines`)."""
    parts, cells = _fields(lines), F.split("value", ",")
    good = F.col("__fields") == len(QUERY_FIELDS)
    if strict:
        text = F.format_string("Unexpected monitor line with %d fields: %s", F.col("__fields"), F.col("value"))
        parts = parts.withColumn("__p", F.when(good, cells).otherwise(F.raise_error(text)))
    else:
        parts = parts.where(good).withColumn("__p", cells)
    texts = [F.trim(F.get("__p", F.lit(i))).alias(n) for i, n in enumerate(TEXT_FIELDS)]
    # one expression reads all numbers: written out six times it makes a method that the JVM doesn't compile
    read = F.transform(F.slice("__p", len(TEXT_FIELDS) + 1, len(NUMBER_FIELDS)), lambda p: reading(p))
    numbers = [F.get("__n", F.lit(i)).alias(n) for i, n in enumerate(NUMBER_FIELDS)]
    return parts.withColumn("__n", read).select(*texts, *numbers)


def label_samples(rows: DataFrame, session: str, workload: str = "local_nvidia_smi_trace") -> DataFrame:
    """Give samples a per-device session id and a workload label."""
    return rows.withColumns(
        {
            "session_id": F.concat(F.lit(f"{session}_gpu_"), F.coalesce("gpu_id", F.lit("unknown"))),
            "workload_type": F.lit(workload),
        }
    )


def read_smi_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_lines(spark.read.text(path), strict)
