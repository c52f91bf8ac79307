"""The end-to-end job: every table of one experiment over a normalised dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.contract import TIMESTAMP
from wattline.operators import audit, checks, drift, metrics, quality
from wattline.plans.attribution import mean_attribution
from wattline.plans.experiments import (
    CV_MODELS,
    DEFAULT_SWEEP,
    feature_ablation,
    grouped_blocked_cv,
    hyperparameter_sweep,
    split_comparison,
)
from wattline.plans.importance import model_scorer, permutation_importance
from wattline.plans.models import (
    DEFAULT_MODELS,
    TrainingRun,
    fit_full_pipeline,
    importances,
    resolve_features,
    train_and_evaluate,
)
from wattline.plans.registry import model_metadata, new_version, save_bundle
from wattline.plans.reports import run_scorecard
from wattline.session import spool


@dataclass(frozen=True)
class RunOptions:
    models: Sequence[str] = DEFAULT_MODELS
    params: Mapping[str, Mapping[str, Any]] | None = None
    split_strategy: str = "time"
    test_size: float = 0.2
    seed: int = 42
    keys: Sequence[str] = ()
    exclude: Sequence[str] = (TIMESTAMP,)
    permutation: bool = True
    attribution: bool = False
    ablation: bool = False
    sweep: bool = False
    sweep_space: Mapping[str, Mapping[str, Sequence[Any]]] | None = None
    validation: bool = False
    cv_folds: int = 3


def data_tables(df: DataFrame, source: str, options: RunOptions) -> dict[str, DataFrame]:
    """Summary, checks, preview, target quality, audit and reference profile."""
    numbers, texts = resolve_features(df, None, options.exclude)
    ties = [c for c in options.keys if c in df.columns] or df.columns
    return {
        "dataset_summary": checks.dataset_summary(df, source),
        "dataset_warnings": checks.suitability_checks(df, source),
        "dataset_preview": quality.preview(df, ties),
        "target_summary": quality.target_quality(df),
        "worst_target_rows": quality.worst_target_rows(df, ties),
        "data_audit": audit.audit(df),
        "data_audit_summary": audit.audit_totals(df),
        "reference_profile": drift.reference_profile(df, numbers, texts),
    }


def diagnostic_tables(run: TrainingRun, options: RunOptions) -> dict[str, DataFrame]:
    """Worst rows, residual bins, importances and optional attributions of every model."""
    out = {"feature_importance": importances(run)}
    test = run.test.drop("is_test", "split_used")
    order = [c for c in options.keys if c in test.columns] or test.columns
    for name, model in run.models.items():
        rows = run.predictions.where(F.col("model") == name).drop("model")
        out[f"{name}_worst_prediction_rows"] = quality.worst_predictions(rows, order)
        out[f"{name}_residual_histogram"] = metrics.residual_histogram(rows)
        out[f"{name}_prediction_density"] = metrics.prediction_density(rows)
        if options.permutation:
            out[f"{name}_permutation_importance"] = permutation_importance(
                test, model_scorer(run.pipeline(name)), [*run.pre.numeric, *run.pre.categorical], order, seed=options.seed
            )
        if options.attribution and isinstance(model, (RandomForestRegressionModel, GBTRegressionModel)):
            out[f"{name}_attribution"] = mean_attribution(model, run.pre.transform(test), run.pre.slot_names(test.sparkSession), name, order)
    return out


def run_experiment(df: DataFrame, source: str, options: RunOptions = RunOptions()) -> tuple[dict[str, DataFrame], TrainingRun]:
    """All result tables by name, and the training run. The input is stored once."""
    o = options
    df = spool(df, "normalized")
    tables = data_tables(df, source, o)
    run = train_and_evaluate(
        df, o.models, o.params, None, o.exclude, o.split_strategy, o.test_size, o.seed, o.keys or None
    )
    tables["metrics"] = run.metrics
    tables["residual_diagnostics"] = run.residuals
    tables.update(diagnostic_tables(run, o))
    common = dict(test_size=o.test_size, seed=o.seed, keys=o.keys or None, exclude=o.exclude)
    if o.ablation:
        found = feature_ablation(df, o.models, o.params, o.split_strategy, **common)
        tables["feature_ablation_summary"], tables["feature_ablation_best_by_set"] = found[:2]
    if o.sweep:
        both = hyperparameter_sweep(df, o.sweep_space or DEFAULT_SWEEP, o.split_strategy, **common)
        tables["hyperparameter_sweep"], tables["hyperparameter_sweep_best"] = both
    if o.validation:
        known = {o.split_strategy: run.metrics}  # fitted above with the same split, inputs and seed
        both = split_comparison(df, o.models, o.params, **common, known=known)
        tables["split_comparison"], tables["split_comparison_best"] = both
        cv = [m for m in CV_MODELS if m in o.models] or list(o.models)
        tables["grouped_blocked_cv"], tables["grouped_blocked_cv_summary"] = grouped_blocked_cv(
            df, cv, o.params, o.cv_folds, o.seed, o.exclude
        )
    tables["scorecard"] = run_scorecard(
        tables["metrics"], tables.get("grouped_blocked_cv_summary"), tables.get("split_comparison_best"), tables["target_summary"],
        tables.get("feature_ablation_best_by_set"), tables.get("hyperparameter_sweep_best"), tables["data_audit_summary"],
    )
    return tables, run


def save_best_model(
    df: DataFrame, run: TrainingRun, registry: str, source: str, options: RunOptions = RunOptions(), model: str | None = None
) -> str:
    """Refit the named or best model on all rows and store it.

    The stored metrics are those of the held-out run, not of the refit.
    """
    spark = df.sparkSession
    rows = {r["model"]: r for r in run.metrics.collect()}
    chosen = model or metrics.best_model(run.metrics).first()["model"]
    if chosen not in rows:
        raise ValueError(f"Model '{chosen}' was not part of the run: {sorted(rows)}")
    params = (options.params or {}).get(chosen)
    pipeline, numbers, texts = fit_full_pipeline(df, chosen, params, options.exclude, options.seed)
    held_out = {k: float(rows[chosen][k]) for k in ("mae", "rmse", "r2")}
    metadata = model_metadata(df.sparkSession, chosen, numbers, texts, held_out, run.split_used, source, new_version())
    return save_bundle(spark, pipeline, metadata, registry, drift.reference_profile(df, numbers, texts), drift.value_counts(df, texts))
