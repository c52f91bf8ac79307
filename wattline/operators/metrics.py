"""Regression metrics, residual statistics, leaderboards and binned diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.contract import TARGET
from wattline.operators.selection import quantiles

Y, Y_HAT = TARGET, "prediction"


def _by(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _metric_columns(y: Column, e: Column) -> list[Column]:
    sse, spread = F.sum(e * e), F.count(e) * F.var_pop(y)
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(spread > 0, 1.0 - F.try_divide(sse, spread)).otherwise(flat).alias("r2"),
    ]


def regression_metrics(
    scored: DataFrame, by: str | Sequence[str] = "model", actual: str = Y, predicted: str = Y_HAT
) -> DataFrame:
    """MAE, RMSE and R2 per group in one pass."""
    e = F.col(actual) - F.col(predicted)
    return scored.groupBy(*_by(by)).agg(*_metric_columns(F.col(actual), e))


def residual_diagnostics(
    scored: DataFrame, by: str = "model", actual: str = Y, predicted: str = Y_HAT
) -> DataFrame:
    """Bias, population deviation and 95th percentile of the absolute error per model."""
    e = F.col(actual) - F.col(predicted)
    long = scored.select(F.col(by).cast("string").alias("series"), F.abs(e).alias("v"))
    p95 = quantiles(long.where("v is not null and series is not null"), (0.95,))
    table = scored.sparkSession.createDataFrame(
        [(k, q[0.95]) for k, q in p95.items()], f"`{by}` string, residual_p95_abs double"
    )
    base = scored.groupBy(F.col(by).cast("string").alias(by)).agg(
        F.avg(e).alias("residual_bias"), F.stddev_pop(e).alias("residual_std")
    )
    return base.join(F.broadcast(table), by)


def leaderboard(metrics: DataFrame, by: str | Sequence[str] = "model") -> DataFrame:
    """Metrics ordered by RMSE, with the rank as a column."""
    order = [F.col("rmse").asc_nulls_last(), *[F.col(c) for c in _by(by)]]
    # One row per model: small by construction.
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the lowest RMSE; ties go to the smaller name."""
    return metrics.agg(F.min_by("model", F.struct("rmse", "model")).alias("model"))


def best_per_group(results: DataFrame, group: str, ties: Sequence[str]) -> DataFrame:
    """Row with the lowest RMSE in each group."""
    order = [F.col("rmse").asc_nulls_last(), *[F.col(t) for t in ties]]
    w = Window.partitionBy(group).orderBy(*order)
    return results.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def ordered_results(results: DataFrame, group: str, ties: Sequence[str] = ()) -> DataFrame:
    """Result table ordered by (group, rmse)."""
    return results.orderBy(group, F.col("rmse").asc_nulls_last(), *ties)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean of each metric by model over the folds, best first."""
    return folds.groupBy("model").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2")
    ).orderBy("rmse", "model")


def top_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """The k most important features (a top-k report)."""
    return importance.orderBy(F.col("importance").desc_nulls_last(), "feature").limit(k)


def residual_histogram(
    scored: DataFrame, bins: int = 40, actual: str = Y, predicted: str = Y_HAT
) -> DataFrame:
    """Equal-width bins of y - y_hat from min to max, last bin closed, empty bins kept."""
    e = scored.select((F.col(actual) - F.col(predicted)).alias("e")).where("e is not null")
    span = e.agg(F.min("e").alias("lo"), F.max("e").alias("hi")).first()
    if span["lo"] is None:
        raise ValueError("No scored rows to bin.")
    lo, hi = span["lo"], span["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("e") - lo) / width), F.lit(bins - 1)).cast("bigint")
    counts = e.groupBy(place.alias("bin")).agg(F.count("*").alias("rows"))
    edges = scored.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("high"),
    )
    return edges.join(F.broadcast(counts), "bin", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def binned_density(points: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Counts on a square grid of side ``width``: the data behind a scatter plot."""
    return points.groupBy(
        F.floor(F.col(x) / width).cast("bigint").alias("x_bin"),
        F.floor(F.col(y) / width).cast("bigint").alias("y_bin"),
    ).agg(F.count("*").alias("rows"))


def prediction_density(scored: DataFrame, width: float = 10.0, actual: str = Y, predicted: str = Y_HAT) -> DataFrame:
    """Both diagnostic grids: predicted against actual, and residual against predicted."""
    pts = scored.withColumn("__e", F.col(actual) - F.col(predicted))
    fit = binned_density(pts, actual, predicted, width).withColumn("view", F.lit("predicted_vs_actual"))
    res = binned_density(pts, predicted, "__e", width).withColumn("view", F.lit("residual_vs_predicted"))
    return fit.unionByName(res)


def axis_range(scored: DataFrame, actual: str = Y, predicted: str = Y_HAT) -> DataFrame:
    """Shared axis of the predicted-against-actual view."""
    return scored.agg(
        F.least(F.min(actual), F.min(predicted)).alias("axis_min"),
        F.greatest(F.max(actual), F.max(predicted)).alias("axis_max"),
    )


def metric_pairs(metrics: DataFrame) -> DataFrame:
    """Tracker rows: ``<model>_<metric>`` and its value."""
    return metrics.unpivot("model", ["mae", "rmse", "r2"], "metric", "value").select(
        F.concat_ws("_", "model", "metric").alias("key"), "value"
    )


def parameter_pairs(df: DataFrame, parameters: dict[str, object]) -> DataFrame:
    """Run parameters as text pairs; unset ones are left out."""
    rows = [(k, str(v)) for k, v in parameters.items() if v is not None]
    return df.sparkSession.createDataFrame(rows, "key string, value string")
