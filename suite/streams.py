"""Streaming jobs, run to the end of their input; the result must equal the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.sources import _monitor_lines
from suite.transforms import SCORE_SQL
from suite.views import FEATURES, cutoff_parts, tel, telemetry
from wattline.functions.scalars import analytic_power_of_row
from wattline.operators.drift import reference_profile
from wattline.session import spool_path
from wattline.streaming import jobs

_FIELDS = [*FEATURES, "workload_type"]


def _finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query(
    "str_01_score_stream",
    tel(f" SELECT workload_type, count(*) AS \"rows\", round(sum({SCORE_SQL}), 3) AS predicted, count(*) AS logged FROM telemetry GROUP BY 1"),
)
def score_stream(spark, sf_dir):
    base = spool_path(spark, "scoring")
    record = F.struct(*_FIELDS)
    payload = F.to_json(F.struct(F.array(record).alias("records")))
    # every request repeats all names, so the text is stored packed
    telemetry(spark, sf_dir).select(payload.alias("value")).write.option("compression", "gzip").text(f"{base}/in")
    requests = spark.readStream.text(f"{base}/in")
    scorer = lambda df: df.withColumn("prediction", analytic_power_of_row())
    _finish(
        jobs.score_stream(
            requests, scorer, _FIELDS, _FIELDS, f"{base}/out", f"{base}/log", f"{base}/checkpoint", "baseline", "v1", once=True
        )
    )
    out = spark.read.parquet(f"{base}/out").groupBy("workload_type").agg(
        F.count("*").alias("rows"), F.round(F.sum("predicted_power_watts"), 3).alias("predicted")
    )
    logged = spark.read.json(f"{base}/log").groupBy(F.col("inputs.workload_type").alias("workload_type")).agg(F.count("*").alias("logged"))
    return out.join(logged, "workload_type")


@query(
    "str_02_drift_stream",
    tel(
        """ SELECT 'gpu_utilization_pct' AS feature, 'mean_shift_std' AS "check", round(avg(gpu_utilization_pct * 3), 6) AS input_value,
        CASE WHEN abs(avg(gpu_utilization_pct * 3) - (SELECT avg(gpu_utilization_pct) FROM telemetry WHERE "timestamp" < TIMESTAMP '1999-01-01'))
          / (SELECT stddev_pop(gpu_utilization_pct) FROM telemetry WHERE "timestamp" < TIMESTAMP '1999-01-01') > 2 THEN 'warning' ELSE 'ok' END AS severity
        FROM telemetry WHERE "timestamp" >= TIMESTAMP '1999-01-01'"""
    ),
)
def drift_stream(spark, sf_dir):
    base = spool_path(spark, "drift")
    reference, later = cutoff_parts(spark, sf_dir)
    later.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(later.schema).parquet(f"{base}/in")
    profile = reference_profile(reference, list(FEATURES), ["workload_type"])
    _finish(jobs.drift_stream(stream, profile, f"{base}/out", f"{base}/checkpoint", once=True))
    report = spark.read.parquet(f"{base}/out")
    return report.where("feature = 'gpu_utilization_pct' and check = 'mean_shift_std'").select(
        "feature", "check", F.round("input_value", 6).alias("input_value"), "severity"
    )


@query(
    "str_03_monitor_intake",
    tel(
        """ SELECT 'live_gpu_' || CAST(k2 AS VARCHAR) AS session_id, 'stress_run' AS workload_type, count(*) AS "rows", round(sum(power_watts), 4) AS power
        FROM telemetry WHERE k1 % 31 <> 0 AND k1 % 37 <> 0 GROUP BY 1"""
    ),
)
def monitor_intake(spark, sf_dir):
    base = spool_path(spark, "intake")
    _monitor_lines(spark, sf_dir).write.text(f"{base}/in")
    _finish(
        jobs.intake_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "live", "stress_run", once=True)
    )
    return spark.read.parquet(f"{base}/out").groupBy("session_id", "workload_type").agg(
        F.count("*").alias("rows"), F.round(F.sum("power_watts"), 4).alias("power")
    )
