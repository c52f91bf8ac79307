"""Batch scoring: align inputs to a model's features, predict, number the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.coerce import numeric
from wattline.operators.ordering import row_index

PREDICTION = "prediction"


def align(
    df: DataFrame, numeric_features: Sequence[str], categorical_features: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """The model's columns in the model's order.

    A feature the input lacks is null, numbers are parsed, unknown columns are
    dropped except those named in ``keep``.
    """
    have = set(df.columns)
    columns = [F.col(f"`{k}`") for k in keep]
    columns += [(numeric(df, c) if c in have else F.lit(None).cast("double")).alias(c) for c in numeric_features]
    columns += [(F.col(f"`{c}`") if c in have else F.lit(None)).cast("string").alias(c) for c in categorical_features]
    return df.select(*columns)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("There is nothing to predict: the input has no records.")
    return df


def score(df: DataFrame, scorer: Column) -> DataFrame:
    """Append a prediction given as a column expression."""
    return df.withColumn(PREDICTION, scorer)


def prediction_rows(scored: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(index, predicted_power_watts): the prediction and its place.

    Records of a request keep their ``row_index``; without that column the place is the
    0-based position in ``order``.
    """
    if "row_index" in scored.columns:
        return scored.select(F.col("row_index").cast("bigint").alias("index"), F.col(PREDICTION).alias("predicted_power_watts"))
    narrow = scored.select(*order, *[c for c in [PREDICTION] if c not in order])
    return row_index(narrow, order, "index").select("index", F.col(PREDICTION).alias("predicted_power_watts"))
