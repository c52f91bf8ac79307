"""Mean absolute attribution of tree ensembles (path-dependent Shapley values).

For one leaf only the features on its path matter. Let o_i say whether the row takes the path
at feature i's splits and z_i be the share of training rows that does. The leaf's value is
then shared out as

    value * (o_i - z_i) * integral over t in [0, 1] of prod over j != i of (z_j * (1 - t) + o_j * t)

and the integral of that polynomial is exact with half as many Gauss points as it has factors.
A batch of rows walks a tree once: every row carries the bits o of the path as a number, and at
a leaf the number picks its shares from a table made for the leaf. Trees are flat arrays of
nodes in one broadcast; no path is ever an object of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.plans.preprocessing import FEATURES
from wattline.session import spool_path

# Tasks receive this module's functions by value, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 16384  # rows that walk the trees together
TABLE_BITS = 9  # paths of more features get a table of the patterns that occur only


@dataclass(frozen=True)
class Trees:
    """All nodes of an ensemble. ``left`` and ``right`` are places in the arrays, -1 at a leaf.

    A row goes left where its feature is at most the threshold, or among the node's
    ``categories``. ``cover`` is the weight of the training rows of a node.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    categories: dict[int, np.ndarray] = field(default_factory=dict)


def ensemble_trees(model: Model) -> Trees:
    """The nodes of a fitted forest or boosted model as flat arrays."""
    if isinstance(model, RandomForestRegressionModel):
        weights = np.full(model.getNumTrees, 1.0 / model.getNumTrees)
    elif isinstance(model, GBTRegressionModel):
        weights = np.array(model.treeWeights, float)
    else:
        raise TypeError("Attribution needs a tree ensemble.")
    spark = SparkSession.active()
    path = spool_path(spark, "trees")
    model.write().save(path)
    rule = F.col("nodeData.split")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.impurityStats")[0].alias("cover"), rule["featureIndex"].alias("feature"), rule["numCategories"].alias("listed"),
        rule["leftCategoriesOrThreshold"].alias("values"),
    )
    # the model is on the driver already; this is as large
    table = nodes.toPandas().sort_values(["tree", "id"]).reset_index(drop=True)
    tree, number = table["tree"].to_numpy(), table["id"].to_numpy()
    roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    start = roots[np.cumsum(np.isin(np.arange(len(table)), roots)) - 1]
    place = {(t, n): i for i, (t, n) in enumerate(zip(tree.tolist(), number.tolist()))}
    dense = bool((number == np.arange(len(table)) - start).all())

    def at(child: str) -> np.ndarray:
        ids = table[child].to_numpy()
        if dense:
            return np.where(ids < 0, -1, start + ids)
        return np.array([-1 if n < 0 else place[t, n] for t, n in zip(tree.tolist(), ids.tolist())])

    listed = table["listed"].to_numpy() > 0
    first = np.array([v[0] if len(v) else np.nan for v in table["values"]], float)
    categories = {int(i): np.array(table["values"][i], float) for i in np.flatnonzero(listed)}
    return Trees(
        table["feature"].to_numpy(), first, at("leftChild"), at("rightChild"), table["value"].to_numpy(float), table["cover"].to_numpy(float),
        roots, weights, categories,
    )


def base_value(trees: Trees) -> float:
    """Expected prediction over the training rows."""
    size = np.diff(np.append(trees.roots, len(trees.value)))
    share = np.repeat(trees.weights / trees.cover[trees.roots], size) * trees.cover
    return float((share * trees.value)[trees.left < 0].sum())


def _gauss(features: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [0, 1] that integrate products of ``features`` - 1 factors exactly."""
    at, weight = np.polynomial.legendre.leggauss(max(1, (features + 1) // 2))
    return (at + 1) / 2, weight / 2


_POINTS = [_gauss(d) for d in range(33)]  # by features of a path; MLlib's trees have at most 30 levels
_PATTERNS = [(np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float) for d in range(TABLE_BITS + 1)]


def leaf_shares(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Shares of a leaf of value 1 by pattern and feature: ``o`` has the bits of a pattern in a row."""
    out = np.zeros(o.shape)
    for t, w in zip(*_POINTS[len(z)]):
        factors = z * (1 - t) + o * t  # above zero, as every child has training rows
        out += (w * factors.prod(axis=1))[:, None] / factors
    return out * (o - z)


def _walk(trees: Trees, root: int, weight: float, x: np.ndarray, out: np.ndarray) -> None:
    """Add a tree's attributions to ``out``, slots by rows; ``x`` is slots by rows."""
    # (node, features of the path, their shares z, the bits o of every row)
    stack = [(root, (), np.zeros(0), np.zeros(x.shape[1], np.int64))]
    while stack:
        node, features, z, bits = stack.pop()
        if trees.left[node] < 0:
            if not features:
                continue
            if len(features) <= TABLE_BITS:
                table, pick = leaf_shares(z, _PATTERNS[len(features)]), bits
            else:
                found, pick = np.unique(bits, return_inverse=True)
                table = leaf_shares(z, (found[:, None] >> np.arange(len(features)) & 1).astype(float))
            table = np.ascontiguousarray((weight * trees.value[node] * table).T)
            for feature, shares in zip(features, table):
                out[feature] += shares.take(pick)
            continue
        feature = int(trees.feature[node])
        listed = trees.categories.get(node)
        left = x[feature] <= trees.threshold[node] if listed is None else np.isin(x[feature], listed)
        known = feature in features
        j = features.index(feature) if known else len(features)
        path = features if known else (*features, feature)
        for child, takes in ((int(trees.left[node]), left), (int(trees.right[node]), ~left)):
            share = trees.cover[child] / trees.cover[node]
            shares = z.copy() if known else np.append(z, 1.0)
            shares[j] *= share
            rows = bits & ~((~takes).astype(np.int64) << j) if known else bits | (takes.astype(np.int64) << j)
            stack.append((child, path, shares, rows))


def attributions(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Shapley values, rows by vector slots."""
    out = np.zeros(x.shape)
    for i in range(0, len(x), ROWS):
        part = np.ascontiguousarray(x[i : i + ROWS].T, float)
        found = np.zeros(part.shape)
        for root, weight in zip(trees.roots.tolist(), trees.weights.tolist()):
            _walk(trees, root, weight, part, found)
        out[i : i + ROWS] = found.T
    return out


def row_attributions(model: Model, vectors: DataFrame, keys: Sequence[str], trees: Trees | None = None) -> DataFrame:
    """Per row: the keys and the attribution of every vector slot."""
    shared = vectors.sparkSession.sparkContext.broadcast(vars(trees or ensemble_trees(model)))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = Trees(**shared.value)
        for pdf in frames:
            if len(pdf):
                phi = attributions(nodes, np.stack(pdf["__x"].to_numpy()))
                yield pdf.drop(columns="__x").assign(attribution=list(phi))

    narrow = vectors.select(*keys, vector_to_array(FEATURES).alias("__x"))
    schema = narrow.drop("__x").schema.add("attribution", T.ArrayType(T.DoubleType()))
    return narrow.mapInPandas(batches, schema)


def mean_attribution(
    model: Model, vectors: DataFrame, slots: Sequence[str] | DataFrame, name: str, order: Sequence[str] = (), max_rows: int | None = None
) -> DataFrame:
    """(feature, mean_abs_attribution, model, sample_rows), largest first.

    ``slots`` names the slots, as a list or as a table (slot, name). Every row counts; ``max_rows`` limits the report to the first rows of ``order``.
    """
    rows = vectors
    if max_rows is not None:
        rows = vectors.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(max_rows)
    per = row_attributions(model, rows, [])
    long = per.select(F.posexplode("attribution").alias("slot", "a"))
    sums = long.groupBy("slot").agg(F.avg(F.abs("a")).alias("mean_abs_attribution"), F.count("*").alias("sample_rows"))
    names = slots if isinstance(slots, DataFrame) else vectors.sparkSession.createDataFrame(list(enumerate(slots)), "slot bigint, name string")
    return (
        sums.join(names, "slot")
        .select(F.col("name").alias("feature"), "mean_abs_attribution", F.lit(name).alias("model"), "sample_rows")
        .orderBy(F.col("mean_abs_attribution").desc(), "feature")
    )
