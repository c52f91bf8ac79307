"""Run scorecard: the one-row content of the experiment report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.metrics import best_model

# When grouped metrics are not to be trusted.
R2_FLOOR = -1.0
RMSE_CEILING = 5000.0

SCORECARD_SCHEMA = (
    "best_model string, primary_model string, primary_mae double, primary_rmse double, primary_r2 double, "
    "random_mae double, random_rmse double, random_r2 double, time_mae double, time_rmse double, time_r2 double, "
    "ablation_set string, ablation_model string, ablation_rmse double, sweep_model string, sweep_params string, sweep_rmse double, "
    "name_leakage_flags bigint, corr_leakage_flags bigint, target_risk boolean, grouped_metrics_suspect boolean"
)


def _least(table: DataFrame | None, columns: Sequence[str]) -> list:
    """The named values of the row with the lowest RMSE, ties to the smaller names; nulls without a table or row."""
    if table is None:
        return [None] * len(columns)
    names = [c for c in columns if c != "rmse"]
    found = table.where("rmse is not null").agg(F.min_by(F.struct(*columns), F.struct("rmse", *names)).alias("p")).first()["p"]
    return [None] * len(columns) if found is None else [found[c] for c in columns]


def run_scorecard(
    metrics: DataFrame, cv_summary: DataFrame | None = None, split_best: DataFrame | None = None,
    target_quality: DataFrame | None = None, ablation: DataFrame | None = None, sweep: DataFrame | None = None,
    audit: DataFrame | None = None,
) -> DataFrame:
    """Best model, the primary (grouped CV) metrics, those of the other splits and the trust warning,
    with the best ablation and sweep rows, the audit's flags and the risk of the target.

    All inputs are result tables of a few rows; missing ones leave nulls. ``audit`` is the table
    of :func:`wattline.operators.audit.audit_totals`.
    """
    primary = _least(cv_summary, ("model", "mae", "rmse", "r2"))
    other: dict[str, list] = {}
    if split_best is not None:
        kept = split_best.where(F.col("split_strategy").isin("random", "time")).select("split_strategy", "mae", "rmse", "r2")
        other = {r["split_strategy"]: list(r[1:]) for r in kept.collect()}
    risk = None if target_quality is None else bool(target_quality.first()["invalid_grouped_metric_risk"])
    flags = [None, None] if audit is None else list(audit.select("n_name_leakage_flags", "n_corr_leakage_flags").first())
    model, _, rmse, r2 = primary
    poor = (r2 is not None and r2 < R2_FLOOR) or (rmse is not None and rmse > RMSE_CEILING)
    row = (
        best_model(metrics).first()["model"], *primary, *other.get("random", [None] * 3), *other.get("time", [None] * 3),
        *_least(ablation, ("feature_set", "model", "rmse")), *_least(sweep, ("model", "params", "rmse")), *flags, risk,
        model is not None and (bool(risk) or poor),
    )
    return metrics.sparkSession.createDataFrame([row], SCORECARD_SCHEMA)
