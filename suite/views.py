"""Telemetry views over the driver tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("k1", "k2")
FEATURES = (
    "gpu_utilization_pct", "memory_utilization_pct", "graphics_clock_mhz",
    "memory_clock_mhz", "temperature_c", "ambient_c",
)

_TELEMETRY = {
    "k1": "l_orderkey",
    "k2": "cast(l_linenumber as bigint)",
    "timestamp": "l_shipdate",
    "session_id": "concat('sup_', cast(l_suppkey as string))",
    "gpu_utilization_pct": "l_quantity * 2D",
    "memory_utilization_pct": "l_discount * 1000D",
    "graphics_clock_mhz": "900D + 17D * l_quantity",
    "memory_clock_mhz": "3200D + 13000D * l_discount",
    "temperature_c": "(18D + 50D * l_tax) + 0.48D * l_quantity + 60D * l_discount",
    "ambient_c": "18D + 50D * l_tax",
    "workload_type": "concat(l_returnflag, l_linestatus)",
    "power_watts": "25D + 2.3D * l_quantity + 450D * l_discount + 0.306D * l_quantity + 104D * l_discount"
    " + (l_extendedprice - floor(l_extendedprice / 30D) * 30D - 15D)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str, keys: bool = True) -> DataFrame:
    """Normalised telemetry built from ``lineitem``; without ``keys`` it has the contract's columns only."""
    df = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in _TELEMETRY.items()])
    return df if keys else df.drop(*KEYS)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-format readings built from ``events``."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(ts as date) as ts", "cast(user_id as string) as dv", "event_type as mt", "value as vl",
        "case when event_id % 17 = 0 then '[Not Supported]' when event_id % 19 = 0 then concat(' ', cast(value as string), ' ')"
        " when event_id % 13 = 0 then null else cast(value as string) end as dirty",
    )


def leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with a copy of the target, a constant and a power-named column."""
    return telemetry(spark, sf_dir).withColumns(
        {
            "target_copy": F.col("power_watts") * 1.0,
            "constant": F.lit(1.0),
            "board_power_like": F.col("gpu_utilization_pct") + F.col("k2"),
        }
    )


def cutoff_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, input): rows before 1999 and the later rows with tripled utilisation."""
    df = telemetry(spark, sf_dir, keys=False)
    day = F.lit("1999-01-01").cast("timestamp_ntz")
    later = df.where(F.col("timestamp") >= day).withColumn("gpu_utilization_pct", F.col("gpu_utilization_pct") * 3)
    return df.where(F.col("timestamp") < day), later.withColumn(
        "workload_type",
        F.when(F.col("workload_type") == "AF", F.lit("new_kernel")).otherwise(F.col("workload_type")),
    )


# The same views for DuckDB, written out on their own.
TELEMETRY_SQL = """telemetry AS (
  SELECT l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_shipdate AS "timestamp",
         'sup_' || CAST(l_suppkey AS VARCHAR) AS session_id,
         l_quantity * 2 AS gpu_utilization_pct, l_discount * 1000 AS memory_utilization_pct,
         900 + 17 * l_quantity AS graphics_clock_mhz, 3200 + 13000 * l_discount AS memory_clock_mhz,
         (18 + 50 * l_tax) + 0.48::DOUBLE * l_quantity + 60 * l_discount AS temperature_c,
         18 + 50 * l_tax AS ambient_c, l_returnflag || l_linestatus AS workload_type,
         25 + 2.3::DOUBLE * l_quantity + 450 * l_discount + 0.306::DOUBLE * l_quantity + 104 * l_discount
           + (l_extendedprice - floor(l_extendedprice / 30) * 30 - 15) AS power_watts
  FROM lineitem)"""

READINGS_SQL = """readings AS (
  SELECT event_id, CAST(ts AS DATE) AS ts, CAST(user_id AS VARCHAR) AS dv, event_type AS mt, value AS vl,
         CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN value
              WHEN event_id % 13 = 0 THEN NULL ELSE value END AS clean
  FROM events)"""

PARTS_SQL = """reference AS (SELECT * EXCLUDE (k1, k2) FROM telemetry WHERE "timestamp" < TIMESTAMP '1999-01-01'),
input AS (
  SELECT * EXCLUDE (k1, k2) REPLACE (gpu_utilization_pct * 3 AS gpu_utilization_pct,
         CASE WHEN workload_type = 'AF' THEN 'new_kernel' ELSE workload_type END AS workload_type)
  FROM telemetry WHERE "timestamp" >= TIMESTAMP '1999-01-01')"""

LEAKY_SQL = """leaky AS (
  SELECT *, power_watts AS target_copy, 1.0::DOUBLE AS "constant",
         gpu_utilization_pct + k2 AS board_power_like
  FROM telemetry)"""


def tel(sql: str) -> str:
    """Prefix a statement with the telemetry view."""
    return f"WITH {TELEMETRY_SQL}{sql}"


def rdg(sql: str) -> str:
    return f"WITH {READINGS_SQL}{sql}"
