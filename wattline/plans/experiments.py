"""Ablation, hyper-parameter sweep, split comparison and grouped cross-validation.

Each experiment returns result tables of a few rows. Preprocessing is fitted once
per split and shared by all fits on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.contract import SESSION, TARGET, TIMESTAMP
from wattline.operators.columns import feature_families
from wattline.operators.metrics import best_per_group, cv_summary, regression_metrics, residual_diagnostics
from wattline.operators.splits import STRATEGIES, attach_folds, grouped_folds, split
from wattline.plans.models import DEFAULT_MODELS, Prepared, each_model, fit_models, predict_long, predict_wide, prepare, resolve_features
from wattline.session import spool

# Default search space of the sweep.
DEFAULT_SWEEP: dict[str, dict[str, list[Any]]] = {
    "random_forest": {"n_estimators": [120, 220], "max_depth": [8, 14], "min_samples_leaf": [1, 2]},
    "gradient_boosting": {"n_estimators": [120, 220], "learning_rate": [0.03, 0.05], "max_depth": [2, 3]},
}
CV_MODELS = ("linear_regression", "random_forest")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def expand_grid(space: Mapping[str, Mapping[str, Sequence[Any]]]) -> list[tuple[str, dict[str, Any]]]:
    """Every (model, parameters) pair, parameters in name order."""
    out = []
    for model, grid in space.items():
        names = sorted(grid)
        out += [(model, dict(zip(names, values))) for values in product(*[grid[n] for n in names])]
    return out


def parameter_text(params: Mapping[str, Any]) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(params.items()))


def grid_table(spark: SparkSession, space: Mapping[str, Mapping[str, Sequence[Any]]] = DEFAULT_SWEEP) -> DataFrame:
    """The sweep's grid as a table: (model, params)."""
    rows = [(m, parameter_text(p)) for m, p in expand_grid(space)]
    return spark.createDataFrame(rows, "model string, params string")


def _fits(models: Sequence[str], params: Mapping[str, Mapping[str, Any]] | None) -> dict[str, tuple[str, Any]]:
    return {m: (m, (params or {}).get(m)) for m in models}


def _held_out(data: Prepared, fits: Mapping[str, tuple[str, Any]], seed: int, label: str) -> DataFrame:
    """(model, actual, prediction, label) of the held-out rows of one split, stored once."""
    try:
        models = fit_models(data, fits, seed)
        wide = predict_wide(data, models, [TARGET])
        if wide is not None:
            # one row per held-out row is stored, its models' rows are made when it is read
            return each_model(spool(wide, "held-out"), models).withColumn("__label", F.lit(label))
        narrow = predict_long(data, models, [TARGET]).withColumn("__label", F.lit(label))
        return spool(narrow, "held-out")
    finally:
        data.release()


def _scores(held_out: DataFrame, label: str) -> DataFrame:
    """Metrics and residual statistics per (label, model): one pass over all experiments' rows."""
    keyed = held_out.withColumn("__key", F.concat_ws("|", "__label", "model"))
    diagnostics = residual_diagnostics(keyed, "__key")
    return (
        regression_metrics(keyed, ["__key", "__label", "model"])
        .join(F.broadcast(diagnostics), "__key")
        .withColumnRenamed("__label", label)
        .drop("__key")
    )


def feature_ablation(
    df: DataFrame,
    models: Sequence[str] = DEFAULT_MODELS,
    params: Mapping[str, Mapping[str, Any]] | None = None,
    split_strategy: str = "random",
    test_size: float = 0.2,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    exclude: Sequence[str] = (TIMESTAMP,),
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(all results, best per feature set, empty feature sets).

    All sets share one split. An empty set gives no row and is reported instead.
    """
    families = feature_families([c for c in df.columns if c not in exclude])
    used = {name: cols for name, cols in families.items() if cols}
    inputs = {c for cols in used.values() for c in cols}
    narrow = [c for c in df.columns if c in inputs or c == TARGET]
    flagged = split(df, split_strategy, test_size, seed, keys).select(*[F.col(f"`{c}`") for c in (*narrow, "is_test")])
    flagged = spool(flagged, "split")
    parts = []
    for name, cols in used.items():
        data = prepare(df, flagged, cols, exclude, split_strategy, test_size, seed, keys, carry=())
        parts.append(_held_out(data, _fits(models, params), seed, name))
    sizes = df.sparkSession.createDataFrame([(n, len(c)) for n, c in used.items()], "feature_set string, feature_count bigint")
    found = _scores(_union(parts), "feature_set").join(F.broadcast(sizes), "feature_set")
    columns = (
        "feature_set", "model", "mae", "rmse", "r2", "residual_bias", "residual_std", "residual_p95_abs", "feature_count",
    )
    table = spool(found.select(*columns), "ablation")
    empty = [n for n in families if n not in used]
    return table.orderBy("feature_set", "rmse"), best_per_group(table, "feature_set", ["model"]), empty


def hyperparameter_sweep(
    df: DataFrame,
    space: Mapping[str, Mapping[str, Sequence[Any]]] = DEFAULT_SWEEP,
    split_strategy: str = "random",
    test_size: float = 0.2,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    exclude: Sequence[str] = (TIMESTAMP,),
) -> tuple[DataFrame, DataFrame]:
    """(all combinations, best per model) on one shared split."""
    data = prepare(df, None, None, exclude, split_strategy, test_size, seed, keys, carry=())
    combos = {f"{m}: {parameter_text(p)}": (m, p) for m, p in expand_grid(space)}
    held_out = _held_out(data, combos, seed, "sweep")
    names = [(label, m, parameter_text(p)) for label, (m, p) in combos.items()]
    side = df.sparkSession.createDataFrame(names, "label string, name string, params string")
    found = _scores(held_out, "sweep").join(F.broadcast(side), F.col("model") == F.col("label"))
    table = spool(
        found.select(F.col("name").alias("model"), "params", "mae", "rmse", "r2", "residual_p95_abs"), "sweep"
    )
    return table.orderBy("model", "rmse", "params"), best_per_group(table, "model", ["params"])


def split_comparison(
    df: DataFrame,
    models: Sequence[str] = DEFAULT_MODELS,
    params: Mapping[str, Mapping[str, Any]] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    exclude: Sequence[str] = (TIMESTAMP,),
    known: Mapping[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(metrics per split strategy and model, best per strategy); grouped needs sessions.

    ``known`` holds the metrics of strategies that were run with the same settings before.
    """
    columns = ("split_strategy", "model", "mae", "rmse", "r2")
    found, parts = [], []
    for strategy in STRATEGIES:
        if strategy == "grouped" and SESSION not in df.columns:
            continue
        if strategy in (known or {}):
            found.append(known[strategy].withColumn("split_strategy", F.lit(strategy)).select(*columns))
            continue
        data = prepare(df, None, None, exclude, strategy, test_size, seed, keys, carry=())
        parts.append(_held_out(data, _fits(models, params), seed, strategy))
    if parts:
        metrics = regression_metrics(_union(parts), ["__label", "model"]).withColumnRenamed("__label", "split_strategy")
        found.append(metrics.select(*columns))
    table = spool(_union(found), "splits")
    return table.orderBy("split_strategy", "rmse"), best_per_group(table, "split_strategy", ["model"])


def grouped_blocked_cv(
    df: DataFrame,
    models: Sequence[str] = CV_MODELS,
    params: Mapping[str, Mapping[str, Any]] | None = None,
    folds: int = 3,
    seed: int = 42,
    exclude: Sequence[str] = (TIMESTAMP,),
) -> tuple[DataFrame, DataFrame]:
    """(metrics per fold and model, mean per model); empty without three sessions."""
    placed = grouped_folds(df, folds)
    if placed is None:
        empty = df.sparkSession.createDataFrame([], "fold bigint, model string, mae double, rmse double, r2 double")
        return empty, empty.drop("fold")
    numbers, texts = resolve_features(df, None, exclude)
    needed = df.select(*[F.col(f"`{c}`") for c in df.columns if c in (*numbers, *texts, SESSION, TARGET)])
    folded = attach_folds(needed, spool(placed, "folds"))
    stored = spool(folded if SESSION in (*numbers, *texts) else folded.drop(SESSION), "folded")
    parts = []
    for fold in sorted(r["fold"] for r in stored.select("fold").distinct().collect()):
        flagged = stored.withColumn("is_test", F.col("fold") == fold).drop("fold")
        data = prepare(df, flagged, None, exclude, "grouped", seed=seed, carry=())
        parts.append(_held_out(data, _fits(models, params), seed, str(fold)))
    metrics = regression_metrics(_union(parts), ["__label", "model"])
    table = spool(metrics.select(F.col("__label").cast("bigint").alias("fold"), "model", "mae", "rmse", "r2"), "cv")
    return table.orderBy("fold", "rmse"), cv_summary(table)


def over_sources(
    frames: Mapping[str, DataFrame], experiment: Callable[[DataFrame], Mapping[str, DataFrame]]
) -> dict[str, DataFrame]:
    """Run one experiment on several datasets; every result table gets a ``source`` column."""
    tables: dict[str, list[DataFrame]] = {}
    for source, df in frames.items():
        for name, table in experiment(df).items():
            tables.setdefault(name, []).append(table.withColumn("source", F.lit(source)))
    return {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) for name, parts in tables.items()}
