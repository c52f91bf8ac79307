"""Target quality, session sizes, previews and worst rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.contract import SESSION, TARGET, TIMESTAMP
from wattline.functions.coerce import numeric
from wattline.operators.selection import column_quantiles, whole_median
from wattline.session import spool

# When a target distribution is suspicious.
RISK_MAX_WATTS = 2000
RISK_TAIL_RATIO = 25


def session_sizes(df: DataFrame, group: str = SESSION) -> DataFrame:
    """Rows per session, rolled up. A null id counts as one more session.

    The sizes are stored once and their median is found by rank, so no task holds them all.
    """
    name = F.coalesce(F.col(group).cast("string"), F.lit("nan"))
    per = spool(df.groupBy(name.alias("g")).agg(F.count("*").alias("n")).select("n"), "sizes")
    return per.agg(
        F.count("*").alias("unique_sessions"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_rows_per_session"),
        F.lit(whole_median(per, "n")).cast("double").alias("median_rows_per_session"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_rows_per_session"),
    )


def target_coverage(df: DataFrame, target: str = TARGET) -> DataFrame:
    y = numeric(df, target)
    return df.agg(
        F.count(y).alias("target_valid_rows"),
        F.avg(y.isNull().cast("int")).alias("target_missing_rate"),
        F.min(y).alias("target_min"),
        F.max(y).alias("target_max"),
    )


def target_quality(df: DataFrame, target: str = TARGET, exact: bool = True) -> DataFrame:
    """One row of target statistics and the outlier-risk flag."""
    if target not in df.columns:
        raise ValueError(f"The table has no '{target}' to summarise.")
    q = column_quantiles(df, [target], (0.5, 0.95, 0.99), exact).get(target)
    if q is None:
        raise ValueError("Not one target value is a number.")
    y = numeric(df, target)
    ratio = q[0.99] / max(q[0.5], 1e-9)
    return df.agg(
        F.count(y).alias("count"),
        F.count_if(y.isNull()).alias("missing_targets"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
        F.avg(y).alias("mean"),
    ).select(
        "*",
        F.lit(q[0.5]).alias("median"),
        F.lit(q[0.95]).alias("p95"),
        F.lit(q[0.99]).alias("p99"),
        F.lit(ratio).alias("outlier_ratio_p99_over_p50"),
        ((F.col("max") > RISK_MAX_WATTS) | F.lit(ratio > RISK_TAIL_RATIO)).alias("invalid_grouped_metric_risk"),
    )


def worst_target_rows(df: DataFrame, ties: Sequence[str] = (), n: int = 20, target: str = TARGET) -> DataFrame:
    """Rows with the largest absolute target (a top-n report)."""
    ranked = df.withColumn("_abs_target", F.abs(numeric(df, target)))
    keep = [c for c in (SESSION, TIMESTAMP, target, "_abs_target") if c in ranked.columns]
    order = [F.col("_abs_target").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return ranked.orderBy(*order).limit(n).select(*keep, *[t for t in ties if t not in keep])


def worst_predictions(
    scored: DataFrame, ties: Sequence[str] = (), n: int = 20, actual: str = TARGET, predicted: str = "prediction"
) -> DataFrame:
    """Rows with the largest absolute error, error columns first (a top-n report)."""
    ranked = (
        scored.withColumnRenamed(actual, "actual_power_watts")
        .withColumnRenamed(predicted, "pred_power_watts")
        .withColumn("abs_error", F.abs(F.col("actual_power_watts") - F.col("pred_power_watts")))
    )
    first = [SESSION, TIMESTAMP, "actual_power_watts", "pred_power_watts", "abs_error"]
    front = [c for c in first if c in ranked.columns]
    order = [F.col("abs_error").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return ranked.orderBy(*order).limit(n).select(*front, *[c for c in ranked.columns if c not in front])


def preview(df: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in an explicit order."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(n)
