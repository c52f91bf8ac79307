"""Regressors, training runs and importances."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wattline.contract import TARGET, TIMESTAMP
from wattline.functions.coerce import numeric
from wattline.operators.columns import feature_columns
from wattline.operators.metrics import leaderboard, regression_metrics, residual_diagnostics
from wattline.operators.splits import split, split_used
from wattline.plans.counted import (
    COUNT, MOST_INPUTS, Counted, boosting_of, bootstraps, count_inputs, forest_of, means_suffice, next_tree, one_tree, rows_drawn, weigh,
)
from wattline.plans.preprocessing import FEATURES, Preprocessor, fit_preprocessor
from wattline.session import SORT_PARTITION_BYTES, spool

PREDICTION = "prediction"
DEFAULT_MODELS = ("linear_regression", "random_forest", "gradient_boosting")

# Default hyper-parameters of each model.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "linear_regression": {},
    "random_forest": {"n_estimators": 220, "max_depth": 14, "min_samples_leaf": 2},
    "gradient_boosting": {"n_estimators": 220, "max_depth": 3, "learning_rate": 0.05},
    "subsampled_boosting": {
        "n_estimators": 300, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.9, "colsample_bytree": 0.9,
    },
}
_COMMON = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "max_bins": "maxBins"}
_FOREST = {**_COMMON, "n_estimators": "numTrees", "bootstrap": "bootstrap"}
_BOOST = {
    **_COMMON, "n_estimators": "maxIter", "learning_rate": "stepSize",
    "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
}
FIT_PARALLELISM = 4
ROW_BYTES = 96  # what a cached row takes besides its slots: objects, target and weight
# Normal equations are exact and take 4,096 slots at most; wider vectors are fitted by steps that
# end when the loss stands still, which gives the same predictions to about six digits.
NORMAL_SLOTS = 4096
STEPWISE = {"solver": "l-bfgs", "tol": 1e-18, "maxIter": 2000}


def make_regressor(name: str, width: int, params: Mapping[str, Any] | None = None, seed: int = 42):
    """An unfitted MLlib regressor by model name."""
    if name not in DEFAULT_PARAMS:
        raise ValueError(f"No regressor is called '{name}'; choose from {', '.join(sorted(DEFAULT_PARAMS))}.")
    settings = {**DEFAULT_PARAMS[name], **(params or {})}
    base = {"featuresCol": FEATURES, "labelCol": TARGET, "predictionCol": PREDICTION}
    if name == "linear_regression":
        return LinearRegression(**base, regParam=0.0, **{**({"solver": "normal"} if width <= NORMAL_SLOTS else STEPWISE), **settings})
    names = _FOREST if name == "random_forest" else _BOOST
    unknown = sorted(set(settings) - set(names))
    if unknown:
        raise ValueError(f"Unknown parameter(s) for {name}: {unknown}")
    chosen = {names[k]: v for k, v in settings.items()}
    if name == "random_forest":
        return RandomForestRegressor(**base, seed=seed, featureSubsetStrategy="all", **chosen)
    if "featureSubsetStrategy" in chosen:
        chosen["featureSubsetStrategy"] = str(chosen["featureSubsetStrategy"])
    return GBTRegressor(**base, seed=seed, **chosen)


@dataclass
class Prepared:
    """One split with its preprocessing applied.

    Vectors of all rows are cached for the fits that need them; few distinct inputs are
    ``counted``, and fits and predictions go over those instead.
    """

    pre: Preprocessor
    train: DataFrame
    test: DataFrame
    raw_test: DataFrame
    split_used: str
    counted: Counted | None = None

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


@dataclass
class TrainingRun:
    """Fitted models and their held-out results as tables."""

    models: dict[str, Model]
    pre: Preprocessor
    predictions: DataFrame
    metrics: DataFrame
    residuals: DataFrame
    test: DataFrame
    split_used: str

    def pipeline(self, model: str) -> PipelineModel:
        return PipelineModel([*self.pre.pipeline.stages, self.models[model]])


def resolve_features(
    df: DataFrame, selected: Sequence[str] | None = None, exclude: Sequence[str] = (TIMESTAMP,)
) -> tuple[list[str], list[str]]:
    """(numeric, categorical) inputs, optionally limited to a selection."""
    if TARGET not in df.columns:
        raise ValueError(f"The table has no '{TARGET}' to learn.")
    numbers, texts = feature_columns(df, TARGET, [*exclude, TIMESTAMP])
    if selected:
        keep = set(selected)
        numbers, texts = [c for c in numbers if c in keep], [c for c in texts if c in keep]
        if not numbers and not texts:
            raise ValueError("None of the selected features is a column of the dataset.")
    return numbers, texts


def with_target(df: DataFrame) -> DataFrame:
    """Rows whose target is a finite number."""
    return df.where(numeric(df, TARGET).isNotNull())


def prepare(
    df: DataFrame,
    flagged: DataFrame | None = None,
    selected: Sequence[str] | None = None,
    exclude: Sequence[str] = (TIMESTAMP,),
    split_strategy: str = "random",
    test_size: float = 0.2,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    exact: bool = True,
    carry: Sequence[str] | None = None,
) -> Prepared:
    """Split, fit the preprocessing once on the training rows, transform both sides.

    ``flagged`` passes rows that already carry ``is_test``, such as one fold of a
    cross-validation. Else the split rows are stored: every later pass reads a flag then
    instead of comparing each row with the cut again. ``carry`` names what held-out rows
    keep besides target and inputs, by default all columns.
    """
    numbers, texts = resolve_features(df, selected, [*exclude, "is_test", "split_used"])
    kept = [c for c in df.columns if carry is None or c in (*numbers, *texts, *carry, TARGET)]
    used = split_used(df.columns, split_strategy)
    if flagged is None:
        rows = with_target(split(df, split_strategy, test_size, seed, keys))
        # training reads target and inputs only: other columns are stored for held-out rows
        own = [F.col(f"`{c}`") if c in (*numbers, *texts, TARGET) else F.when(F.col("is_test"), F.col(f"`{c}`")).alias(c) for c in kept]
        rows = spool(rows.select(*own, "is_test", "split_used"), "split")
    else:
        rows = with_target(flagged)
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    pre, counted, vectors = training_vectors(train, numbers, texts, exact)
    extra = [c for c in kept if c not in (TARGET, "is_test", "split_used")]
    held = pre.transform(test).select(*extra, TARGET, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    return Prepared(pre, vectors, held, test, used, counted)


def training_vectors(
    train: DataFrame, numbers: Sequence[str], texts: Sequence[str], exact: bool = True
) -> tuple[Preprocessor, Counted | None, DataFrame]:
    """Preprocessing of training rows, their distinct inputs if few, and the vectors of all rows, to be cached."""
    counted = count_inputs(train, [*numbers, *texts])
    if counted is None:
        pre = fit_preprocessor(train.select(*numbers, *texts, TARGET), numbers, texts, exact)
    else:
        pre = fit_preprocessor(counted.table, numbers, texts, weight=COUNT)
    rows = counted.total if counted else train.count()
    vectors = even_parts(pre.transform(train).select(FEATURES, TARGET), rows, 8 * pre.width + ROW_BYTES)
    return pre, counted, vectors.persist(StorageLevel.MEMORY_AND_DISK)


def even_parts(df: DataFrame, rows: int, row_bytes: int, part_bytes: int = SORT_PARTITION_BYTES) -> DataFrame:
    """Deal rows to parts of about ``part_bytes`` in memory where one part a core would be larger.

    A part of a file is bounded by its packed size, which for values that repeat can be a
    tenth of what its rows take when cached.
    """
    parts = -(-rows * row_bytes // part_bytes)
    return df.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def _fit_counted(
    pre: Preprocessor, counted: Counted, fits: Mapping[str, tuple[str, Mapping[str, Any] | None]], seed: int, run: Callable
) -> dict[str, Model]:
    """Fits over distinct inputs. Forests share their draws, and trees that only differ in how many stand beside them."""
    whole, forests, rounds = {}, {}, {}
    for label, (name, params) in fits.items():
        estimator = make_regressor(name, pre.width, params, seed)
        drawn = name == "random_forest" and estimator.getBootstrap()
        (forests if drawn else rounds if rows_drawn(estimator) else whole)[label] = estimator
    table = pre.transform(counted.table).select(FEATURES, COUNT, TARGET).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done = dict(zip(whole, run(lambda label: weigh(whole[label], counted.total).fit(table), list(whole))))
    finally:
        table.unpersist()
    shape = {label: (f.getMaxDepth(), f.getMaxBins(), f.getMinInstancesPerNode()) for label, f in forests.items()}
    grown: dict[tuple[int, tuple], Model] = {}
    for sums, totals in bootstraps(counted, max((f.getNumTrees() for f in forests.values()), default=0), seed):
        vectors = pre.transform(sums).persist(StorageLevel.MEMORY_AND_DISK)
        needed = {(t, shape[label]): f for label, f in forests.items() for t in totals if t < f.getNumTrees()}
        try:
            grown |= dict(zip(needed, run(lambda at: one_tree(needed[at], vectors, at[0], totals[at[0]]), list(needed))))
        finally:
            vectors.unpersist()
    for label, forest in forests.items():
        done[label] = forest_of(forest, [grown[t, shape[label]] for t in range(forest.getNumTrees())])
    for label, boosting in rounds.items():
        trees: list[Model] = []
        for sums, totals in bootstraps(counted, boosting.getMaxIter(), seed, boosting.getSubsamplingRate()):
            vectors = pre.transform(sums).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                for t, total in totals.items():
                    trees.append(next_tree(boosting, vectors, t, total, trees))
            finally:
                vectors.unpersist()
        done[label] = boosting_of(boosting, trees)
    return done


def fit_models(
    data: Prepared,
    fits: Mapping[str, tuple[str, Mapping[str, Any] | None]],
    seed: int = 42,
    parallelism: int = FIT_PARALLELISM,
) -> dict[str, Model]:
    """Fit ``{label: (model, parameters)}`` on the cached training vectors.

    A few fits run side by side, as MLlib's own tuning does, so that the short
    stages of one do not leave the cluster idle.
    """
    return fit_all(data.pre, data.counted, data.train, fits, seed, parallelism)


def fit_all(
    pre: Preprocessor,
    counted: Counted | None,
    vectors: DataFrame,
    fits: Mapping[str, tuple[str, Mapping[str, Any] | None]],
    seed: int = 42,
    parallelism: int = FIT_PARALLELISM,
) -> dict[str, Model]:
    """Fit over distinct inputs where that gives the fit on all rows, the rest on the vectors."""
    spark = vectors.sparkSession

    def run(fit: Callable, items: Sequence[Any]) -> list[Model]:
        with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
            return pool.map(inheritable_thread_target(spark)(fit), items)

    def fit(label: str) -> Model:
        name, params = fits[label]
        return make_regressor(name, pre.width, params, seed).fit(vectors)

    def by_input(name: str, params: Mapping[str, Any] | None) -> bool:
        return means_suffice(name, {**DEFAULT_PARAMS.get(name, {}), **(params or {})}) or rows_drawn(make_regressor(name, pre.width, params, seed))

    few = {} if counted is None else {k: v for k, v in fits.items() if by_input(*v)}
    done = _fit_counted(pre, counted, few, seed, run) if few else {}
    rest = [label for label in fits if label not in done]
    if len(rest) > 1:
        vectors.count()  # fill the cache once, not once per thread
    done |= dict(zip(rest, run(fit, rest)))
    return {label: done[label] for label in fits}


def _answers(data: Prepared, models: Mapping[str, Model]) -> DataFrame | None:
    """The stored prediction ``__p<i>`` of each model for the held-out side's distinct inputs ``__k<j>``, if few."""
    columns = [f"`{c}`" for c in data.counted.columns]
    inputs = spool(data.raw_test.select(*columns).distinct(), "asked")
    if inputs.count() > MOST_INPUTS:
        return None
    out = data.pre.transform(inputs)
    for i, model in enumerate(models.values()):
        out = model.transform(out, {model.predictionCol: f"__p{i}"})
    keys = [F.col(c).alias(f"__k{j}") for j, c in enumerate(columns)]
    return spool(out.select(*keys, *[f"__p{i}" for i in range(len(models))]), "answers")


def predict_wide(data: Prepared, models: Mapping[str, Model], columns: Sequence[str]) -> DataFrame | None:
    """Held-out rows with one prediction column ``__p<i>`` a model, looked up by their inputs; None if those aren't few."""
    found = None if data.counted is None else _answers(data, models)
    if found is None:
        return None
    own = [F.col(f"`{c}`").alias(f"__i{j}") for j, c in enumerate(data.counted.columns)]
    rows = data.raw_test.select(*[F.col(f"`{c}`") for c in columns], *own)
    same = reduce(lambda a, b: a & b, [F.col(f"__i{j}").eqNullSafe(F.col(f"__k{j}")) for j in range(len(own))])
    return rows.join(F.broadcast(found), same).select(*[F.col(f"`{c}`") for c in columns], *[f"__p{i}" for i in range(len(models))])


def each_model(wide: DataFrame, models: Iterable[str]) -> DataFrame:
    """One row per row and model of a table with a prediction column a model."""
    cells = [F.struct(F.col(f"__p{i}").alias(PREDICTION), F.lit(label).alias("model")) for i, label in enumerate(models)]
    keep = [F.col(f"`{c}`") for c in wide.columns if not c.startswith("__p")]
    return wide.select(*keep, F.explode(F.array(*cells)).alias("__one")).select(*keep, "__one.*")


def predict_long(data: Prepared, models: Mapping[str, Model], columns: Sequence[str] | None = None) -> DataFrame:
    """Held-out predictions, one row per row and model; ``columns`` limits what is carried."""
    keep = [c for c in data.test.columns if c != FEATURES] if columns is None else list(columns)
    wide = predict_wide(data, models, keep)
    if wide is not None:
        return each_model(wide, models)
    parts = [m.transform(data.test).select(*keep, PREDICTION, F.lit(label).alias("model")) for label, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def train_and_evaluate(
    df: DataFrame,
    models: Sequence[str] = DEFAULT_MODELS,
    params: Mapping[str, Mapping[str, Any]] | None = None,
    selected: Sequence[str] | None = None,
    exclude: Sequence[str] = (TIMESTAMP,),
    split_strategy: str = "random",
    test_size: float = 0.2,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    flagged: DataFrame | None = None,
    exact: bool = True,
) -> TrainingRun:
    """Fit every model on the training side of one split and score the held-out side."""
    data = prepare(df, flagged, selected, exclude, split_strategy, test_size, seed, keys, exact)
    try:
        fitted = fit_models(data, {m: (m, (params or {}).get(m)) for m in models}, seed)
        predictions = spool(predict_long(data, fitted), "predictions")
    finally:
        data.release()
    return TrainingRun(
        fitted, data.pre, predictions, leaderboard(regression_metrics(predictions)),
        residual_diagnostics(predictions), data.raw_test, data.split_used,
    )


def fit_full_pipeline(
    df: DataFrame,
    model: str,
    params: Mapping[str, Any] | None = None,
    exclude: Sequence[str] = (TIMESTAMP,),
    seed: int = 42,
    exact: bool = True,
) -> tuple[PipelineModel, list[str], list[str]]:
    """Refit one model on all rows: (pipeline, numeric features, categorical features)."""
    numbers, texts = resolve_features(df, None, exclude)
    make_regressor(model, 1, params, seed)  # an unknown model fails before any work
    rows = with_target(df)
    pre, fitted = fit_rows(rows, model, numbers, texts, params, seed, exact)
    return PipelineModel([*pre.pipeline.stages, fitted]), numbers, texts


def fit_rows(
    rows: DataFrame,
    model: str,
    numbers: Sequence[str],
    texts: Sequence[str] = (),
    params: Mapping[str, Any] | None = None,
    seed: int = 42,
    exact: bool = True,
) -> tuple[Preprocessor, Model]:
    """Preprocessing and one model, fitted on all rows of a table."""
    pre, counted, vectors = training_vectors(rows, numbers, texts, exact)
    try:
        return pre, fit_all(pre, counted, vectors, {model: (model, params)}, seed)[model]
    finally:
        vectors.unpersist()


def importances(run: TrainingRun) -> DataFrame:
    """(model, feature, importance): impurity importance, or the absolute coefficient."""
    spark = run.predictions.sparkSession
    rows = []
    for name, model in run.models.items():
        weights = model.coefficients if hasattr(model, "coefficients") else model.featureImportances
        rows += [(name, slot, abs(float(w))) for slot, w in enumerate(weights.toArray())]
    table = spark.createDataFrame(rows, "model string, slot bigint, importance double")
    named = table.join(run.pre.slot_names(spark), "slot").select("model", F.col("name").alias("feature"), "importance")
    return named.orderBy("model", F.col("importance").desc(), "feature")
