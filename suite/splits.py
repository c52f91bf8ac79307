"""Splits, folds and hold-out membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.transforms import _ORDER
from suite.views import KEYS, tel, telemetry
from wattline.operators.ordering import flag_first
from wattline.operators.splits import attach_folds, grouped_folds, split

_BY_SESSION = """SELECT session_id, is_test, count(*) AS "rows", round(sum(power_watts), 4) AS power"""


def _by_session(df):
    return df.groupBy("session_id", "is_test").agg(
        F.count("*").alias("rows"), F.round(F.sum("power_watts"), 4).alias("power")
    )


@query(
    "win_01_time_cutoff",
    tel(
        f""" {_BY_SESSION} FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) <= floor(0.75 * count(*) OVER ()) AS is_test
        FROM telemetry) GROUP BY 1, 2"""
    ),
)
def time_cutoff(spark, sf_dir):
    df = telemetry(spark, sf_dir)
    n = df.count()
    flagged = flag_first(df, ["timestamp", *KEYS, "session_id"], int(0.75 * n), "is_test", n)
    return _by_session(flagged)


_HASH = "substr(md5('42:' || CAST(k1 AS VARCHAR) || ':' || CAST(k2 AS VARCHAR)), 1, 15)"
_REST = _ORDER.replace('"timestamp", k1, k2', 'k1, k2, "timestamp"')


@query(
    "spl_01_random",
    tel(
        f""" {_BY_SESSION}, 'random' AS split_used FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}, {_REST}) <= ceil(0.2 * count(*) OVER ()) AS is_test
        FROM telemetry) GROUP BY 1, 2"""
    ),
)
def random(spark, sf_dir):
    return _by_session(split(telemetry(spark, sf_dir), "random", 0.2, 42, KEYS)).withColumn("split_used", F.lit("random"))


@query(
    "spl_02_time",
    tel(
        f""" {_BY_SESSION}, 'time' AS split_used FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) > floor(0.8 * count(*) OVER ()) AS is_test
        FROM telemetry) GROUP BY 1, 2"""
    ),
)
def time(spark, sf_dir):
    df = split(telemetry(spark, sf_dir), "time", 0.2, 42, KEYS)
    return df.groupBy("session_id", "is_test", "split_used").agg(
        F.count("*").alias("rows"), F.round(F.sum("power_watts"), 4).alias("power")
    )


_GROUPED = """, ranked AS (SELECT session_id, row_number() OVER (ORDER BY substr(md5('42:' || session_id), 1, 15), session_id) AS rn, count(*) OVER () AS n
    FROM (SELECT DISTINCT session_id FROM telemetry)), held AS (SELECT session_id FROM ranked WHERE rn <= ceil(0.2 * n))"""


@query(
    "spl_03_grouped",
    tel(
        f"""{_GROUPED} {_BY_SESSION}, 'grouped' AS split_used FROM (SELECT *, session_id IN (SELECT session_id FROM held) AS is_test FROM telemetry) GROUP BY 1, 2"""
    ),
)
def grouped(spark, sf_dir):
    df = split(telemetry(spark, sf_dir), "grouped", 0.2, 42)
    return df.groupBy("session_id", "is_test", "split_used").agg(
        F.count("*").alias("rows"), F.round(F.sum("power_watts"), 4).alias("power")
    )


_FOLDS = """, sizes AS (SELECT session_id, count(*) AS n FROM telemetry GROUP BY 1),
    ranked AS (SELECT session_id, n, row_number() OVER (ORDER BY n DESC, session_id) AS rn FROM sizes),
    greedy(rn, a, b, c, fold) AS (
      SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
      UNION ALL
      SELECT r.rn, CASE WHEN a <= b AND a <= c THEN a + n ELSE a END, CASE WHEN b < a AND b <= c THEN b + n ELSE b END,
             CASE WHEN c < a AND c < b THEN c + n ELSE c END, CASE WHEN a <= b AND a <= c THEN 1 WHEN b <= c THEN 2 ELSE 3 END
      FROM greedy g JOIN ranked r ON r.rn = g.rn + 1),
    folds AS (SELECT session_id, n, fold FROM ranked JOIN greedy USING (rn))"""


@query(
    "spl_05_grouped_folds",
    tel(f"{_FOLDS} SELECT session_id, n AS \"rows\", fold FROM folds").replace("WITH ", "WITH RECURSIVE ", 1),
)
def folds(spark, sf_dir):
    return grouped_folds(telemetry(spark, sf_dir), 3)


@query(
    "spl_05_rows_by_fold",
    tel(
        f"{_FOLDS} SELECT fold, count(*) AS \"rows\", count(DISTINCT session_id) AS sessions, round(sum(power_watts), 3) AS power FROM telemetry JOIN folds USING (session_id) GROUP BY 1"
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def rows_by_fold(spark, sf_dir):
    df = telemetry(spark, sf_dir)
    return attach_folds(df, grouped_folds(df, 3)).groupBy("fold").agg(
        F.count("*").alias("rows"), F.countDistinct("session_id").alias("sessions"), F.round(F.sum("power_watts"), 3).alias("power")
    )


@query(
    "jon_07_holdout_membership",
    tel(
        f"""{_GROUPED} SELECT 'held_out' AS part, count(*) AS "rows", round(sum(power_watts), 3) AS power FROM telemetry WHERE session_id IN (SELECT session_id FROM held)
        UNION ALL SELECT 'kept', count(*), round(sum(power_watts), 3) FROM telemetry WHERE session_id NOT IN (SELECT session_id FROM held)"""
    ),
)
def holdout(spark, sf_dir):
    df = telemetry(spark, sf_dir)
    held = split(df, "grouped", 0.2, 42).where("is_test").select("session_id").distinct()
    total = [F.count("*").alias("rows"), F.round(F.sum("power_watts"), 3).alias("power")]
    inside = df.join(held, "session_id", "left_semi").agg(F.lit("held_out").alias("part"), *total)
    outside = df.join(held, "session_id", "left_anti").agg(F.lit("kept").alias("part"), *total)
    return inside.unionByName(outside)
