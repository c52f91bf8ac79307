"""Queries on what the measured rows say themselves: clamps, blocks, regimes, base loads, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.transforms import SCORE_SQL
from suite.views import tel, telemetry
from wattline.functions.scalars import CLAMP_LIMITS
from wattline.operators import measured

_CLAMPED = " UNION ALL ".join(
    f"""SELECT session_id, '{c}' AS feature, count({c}) AS "rows", count(*) FILTER ({c} < {low}) AS below, count(*) FILTER ({c} > {high}) AS above,
    round(sum(round_even(least(greatest({c}, {low}), {high}), 3)), 3) AS clamped_total FROM telemetry GROUP BY 1"""
    for c, (low, high) in CLAMP_LIMITS.items()
)


@query("prj_13_clamped_readings", tel(f" {_CLAMPED}"))
def clamped_readings(spark, sf_dir):
    out = measured.clamped_readings(telemetry(spark, sf_dir))
    return out.withColumn("clamped_total", F.round("clamped_total", 3))


@query(
    "prj_14_activity_blocks",
    tel(
        """ , d AS (SELECT DISTINCT session_id, CAST("timestamp" AS DATE) AS d FROM telemetry),
        g AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY session_id ORDER BY d) > 7 THEN 1 ELSE 0 END AS g FROM d),
        b AS (SELECT session_id, d, sum(g) OVER (PARTITION BY session_id ORDER BY d)::BIGINT AS block FROM g)
        SELECT t.session_id, block, count(*) AS "rows", min(d) AS first_day, max(d) AS last_day, round(sum(power_watts), 4) AS power
        FROM telemetry t JOIN b ON t.session_id = b.session_id AND CAST(t."timestamp" AS DATE) = b.d GROUP BY 1, 2"""
    ),
)
def activity_blocks(spark, sf_dir):
    day = F.col("timestamp").cast("date")
    return measured.activity_blocks(telemetry(spark, sf_dir)).groupBy("session_id", "block").agg(
        F.count("*").alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.round(F.sum("power_watts"), 4).alias("power")
    )


@query(
    "prj_15_calibrated_power",
    tel(
        f""" , s AS (SELECT workload_type, power_watts, {SCORE_SQL} AS p FROM telemetry),
        b AS (SELECT *, avg(power_watts - p) OVER (PARTITION BY workload_type) AS bias FROM s)
        SELECT workload_type, count(*) AS "rows", round(any_value(bias), 5) AS bias, round(avg(abs(power_watts - p)), 5) AS plain_mae,
        round(avg(abs(power_watts - p - bias)), 5) AS calibrated_mae FROM b GROUP BY 1"""
    ),
)
def calibrated_power(spark, sf_dir):
    df = measured.with_calibrated_power(telemetry(spark, sf_dir))
    gap = F.col("power_watts") - F.col("calibrated_power")
    return df.groupBy("workload_type").agg(
        F.count("*").alias("rows"), F.round(F.first("power_bias"), 5).alias("bias"),
        F.round(F.avg(F.abs(gap + F.col("power_bias"))), 5).alias("plain_mae"), F.round(F.avg(F.abs(gap)), 5).alias("calibrated_mae"),
    )


@query(
    "prj_16_daily_regimes",
    tel(
        """ , d AS (SELECT session_id, datediff('day', DATE '1970-01-01', CAST("timestamp" AS DATE)) AS d, count(*) AS n, sum(power_watts) AS s FROM telemetry GROUP BY 1, 2),
        r AS (SELECT *, s / n - sum(s) OVER w / sum(n) OVER w AS change FROM d
          WINDOW w AS (PARTITION BY session_id ORDER BY d RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
        SELECT session_id, CASE WHEN change > 8 THEN 'up' WHEN change < -8 THEN 'down' WHEN change IS NULL THEN 'start' ELSE 'level' END AS regime,
        count(*) AS days, sum(n)::BIGINT AS "rows" FROM r GROUP BY 1, 2"""
    ),
)
def daily_regimes(spark, sf_dir):
    return measured.daily_regimes(telemetry(spark, sf_dir)).groupBy("session_id", "regime").agg(
        F.count("*").alias("days"), F.sum("rows").alias("rows")
    )


@query(
    "jon_05_base_loads",
    tel(
        """ , b AS (SELECT workload_type AS w, avg(gpu_utilization_pct) AS gpu_base, avg(memory_utilization_pct) AS mem_base FROM telemetry GROUP BY 1)
        SELECT session_id, workload_type, round(gpu_base, 6) AS gpu_base, round(mem_base, 6) AS mem_base, count(*) AS "rows",
        count(*) FILTER (gpu_utilization_pct > gpu_base) AS above FROM telemetry JOIN b ON workload_type = w GROUP BY 1, 2, 3, 4"""
    ),
)
def base_loads(spark, sf_dir):
    df = measured.with_base_loads(telemetry(spark, sf_dir), {"gpu_base": "gpu_utilization_pct", "mem_base": "memory_utilization_pct"})
    bases = [F.round(c, 6).alias(c) for c in ("gpu_base", "mem_base")]
    return df.groupBy("session_id", "workload_type", *bases).agg(
        F.count("*").alias("rows"), F.count_if(F.col("gpu_utilization_pct") > F.col("gpu_base")).alias("above")
    )
