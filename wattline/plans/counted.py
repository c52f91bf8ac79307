"""Fits on distinct inputs: rows that agree in every input column are read once, with their count.

Whole-number readings, clocks and labels repeat, so a large table often has few distinct
inputs. Of the targets of equal inputs least squares, trees and boosting on all rows use only
their number and their mean: the spread around that mean is the same in every split and every
set of coefficients. One weighted row per distinct input therefore gives the same fit.

A bootstrapped forest draws every row by itself, once for each tree, and so does boosting on a
share of the rows, once for each round. The draws are made on all rows and summed per distinct
input; each tree is then fitted on its own sums. What boosting has predicted so far depends on
the input alone, so the mean residual of the drawn rows is their mean target less that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.regression import (
    DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.contract import TARGET
from wattline.session import spool

# Inputs are few if they fit a broadcast table and stand for several rows each.
MOST_INPUTS = 100_000
LEAST_COPIES = 4
COUNT = "__n"
TREES_A_PASS = 8
# Settings of least squares under which only the means of the targets matter.
_PLAIN_LINEAR = {"solver", "tol", "maxIter", "fitIntercept", "aggregationDepth", "maxBlockSizeInMB"}


@dataclass(frozen=True)
class Counted:
    """Distinct inputs of training rows: the ``columns``, how many rows, and the mean target."""

    table: DataFrame
    rows: DataFrame
    columns: list[str]
    total: int


def _cells(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def count_inputs(rows: DataFrame, columns: Sequence[str]) -> Counted | None:
    """The distinct inputs of ``rows``; None where they are too many to gain from it.

    The estimate only chooses between two ways to the same fit.
    """
    if not columns:
        return None
    sizes = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*_cells(columns))).alias("inputs")).first()
    if not sizes["n"] or sizes["inputs"] > MOST_INPUTS or sizes["inputs"] * LEAST_COPIES > sizes["n"]:
        return None
    narrow = rows.select(*_cells(columns), F.col(TARGET).cast("double").alias(TARGET))
    groups = narrow.groupBy(*_cells(columns)).agg(F.count("*").alias(COUNT), F.avg(TARGET).alias(TARGET))
    return Counted(spool(groups, "inputs"), narrow, list(columns), sizes["n"])


def means_suffice(model: str, settings: Mapping[str, Any]) -> bool:
    """Whether counts and means of the targets give the model's fit on all rows."""
    if model == "linear_regression":
        return set(settings) <= _PLAIN_LINEAR
    return model == "random_forest" or float(settings.get("subsample", 1.0)) == 1.0


def rows_drawn(estimator: Estimator) -> bool:
    """Whether each round of boosting takes a share of the rows."""
    return isinstance(estimator, GBTRegressor) and estimator.getSubsamplingRate() < 1.0


def weigh(estimator: Estimator, total: int) -> Estimator:
    """Let an estimator count each input as often as it stands for rows, in its leaf sizes too."""
    estimator.setWeightCol(COUNT)
    if not estimator.hasParam("minInstancesPerNode"):
        return estimator
    least = estimator.getMinInstancesPerNode()
    if 2 * least > total:
        return estimator.setMaxDepth(0)
    return estimator.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min((least - 0.5) / total, 0.5 - 1e-12))


def _draws(u: Column) -> Column:
    """How often a bootstrap of many rows takes one row (Poisson of mean 1) by a uniform number."""
    ends = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
    out = F.when(u < ends[0], 0)
    for k in range(1, 6):
        out = out.when(u < ends[k], k)
    return out.otherwise(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= u)))


def _own_seed(seed: int, tree: int) -> int:
    """Seeds of trees lie far apart: a random column adds the partition's number to its seed."""
    return int(hashlib.md5(f"{seed}:{tree}".encode()).hexdigest()[:15], 16)


def _numbered(counted: Counted) -> tuple[DataFrame, DataFrame]:
    """Distinct inputs with a number ``__id``, and all rows as that number and the target, both stored."""
    inputs = spool(counted.table.select(*_cells(counted.columns), F.monotonically_increasing_id().alias("__id")), "numbered")
    own = [F.col(f"`{c}`").alias(f"__k{j}") for j, c in enumerate(counted.columns)]
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__k{j}")) for j, c in enumerate(counted.columns)])
    rows = counted.rows.join(F.broadcast(inputs.select(*own, "__id")), same).select("__id", TARGET)
    return inputs, spool(rows, "targets")


def bootstraps(counted: Counted, trees: int, seed: int, share: float | None = None) -> Iterator[tuple[DataFrame, dict[int, int]]]:
    """Stored sums of a few trees' draws, ``__w<tree>`` and ``__y<tree>``, with each tree's number of draws.

    Rows are drawn with replacement, or each once or not at all where ``share`` says how many.
    """
    columns = _cells(counted.columns)
    several = trees > TREES_A_PASS  # passes read two numbers a row then
    inputs, rows = _numbered(counted) if several else (None, counted.rows)
    for first in range(0, trees, TREES_A_PASS):
        some = range(first, min(trees, first + TREES_A_PASS))
        drawn = rows.withColumns({f"__u{t}": F.rand(_own_seed(seed, t)) for t in some})
        taken = _draws if share is None else lambda u: F.when(u < share, 1).otherwise(0)
        drawn = drawn.withColumns({f"__w{t}": taken(F.col(f"__u{t}")) for t in some})
        sums = [F.sum(f"__w{t}").alias(f"__w{t}") for t in some] + [F.sum(F.col(f"__w{t}") * F.col(TARGET)).alias(f"__y{t}") for t in some]
        if several:
            summed = inputs.join(drawn.groupBy("__id").agg(*sums), "__id").drop("__id")
        else:
            summed = drawn.groupBy(*columns).agg(*sums)
        table = spool(summed, "draws")
        row = table.agg(*[F.sum(f"__w{t}").alias(f"__w{t}") for t in some]).first()
        yield table, {t: row[f"__w{t}"] for t in some}


def one_tree(forest: RandomForestRegressor, table: DataFrame, tree: int, total: int) -> DecisionTreeRegressionModel:
    """One tree of a forest from its summed draws."""
    same = ("featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "minInstancesPerNode", "seed")
    estimator = DecisionTreeRegressor(**{p: forest.getOrDefault(p) for p in same})
    w = F.col(f"__w{tree}")
    own = table.where(w > 0).select(forest.getFeaturesCol(), w.cast("double").alias(COUNT), (F.col(f"__y{tree}") / w).alias(TARGET))
    return weigh(estimator, total).fit(own)


def forest_of(forest: RandomForestRegressor, trees: Sequence[DecisionTreeRegressionModel]) -> RandomForestRegressionModel:
    """The forest's model from trees that were fitted one by one."""
    context = SparkSession.active().sparkContext
    package = context._jvm.org.apache.spark.ml.regression
    listed = context._gateway.new_array(package.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        listed[i] = t._java_obj
    made = package.RandomForestRegressionModel(forest.uid, listed, trees[0].numFeatures)
    model = forest._copyValues(RandomForestRegressionModel(made))
    model._transfer_params_to_java()  # the model divides by its number of trees
    return model


def next_tree(
    boosting: GBTRegressor, table: DataFrame, tree: int, total: int, before: Sequence[DecisionTreeRegressionModel]
) -> DecisionTreeRegressionModel:
    """The tree of one round from its summed draws: the targets first, later the slope of the squared error."""
    same = ("featuresCol", "labelCol", "predictionCol", "maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "featureSubsetStrategy")
    estimator = RandomForestRegressor(
        **{p: boosting.getOrDefault(p) for p in same}, numTrees=1, bootstrap=False, subsamplingRate=1.0, seed=boosting.getSeed() + tree
    )
    w, features = F.col(f"__w{tree}"), boosting.getFeaturesCol()
    mean = F.col(f"__y{tree}") / w
    own = table.where(w > 0).select(features, w.cast("double").alias(COUNT), mean.alias(TARGET))
    if before:
        own = DataFrame(_boosted(boosting, before).transform(own._jdf), own.sparkSession)
        own = own.withColumn(TARGET, 2 * (F.col(TARGET) - F.col(boosting.getPredictionCol()))).drop(boosting.getPredictionCol())
    return weigh(estimator, total).fit(own).trees[0]


def _boosted(boosting: GBTRegressor, trees: Sequence[DecisionTreeRegressionModel]):
    """The JVM's model of some rounds; a Python model wraps every tree anew, too often for each round."""
    context = SparkSession.active().sparkContext
    listed = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = context._gateway.new_array(context._jvm.double, len(trees))
    for i, t in enumerate(trees):
        listed[i], weights[i] = t._java_obj, boosting.getStepSize() if i else 1.0
    made = context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(boosting.uid, listed, weights, trees[0].numFeatures)
    return made.setFeaturesCol(boosting.getFeaturesCol()).setPredictionCol(boosting.getPredictionCol())


def boosting_of(boosting: GBTRegressor, trees: Sequence[DecisionTreeRegressionModel]) -> GBTRegressionModel:
    """The model of boosting from trees that were fitted one by one; the first counts in full."""
    model = boosting._copyValues(GBTRegressionModel(_boosted(boosting, trees)))
    model._transfer_params_to_java()
    return model
