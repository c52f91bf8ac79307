"""Leakage audit and the column guards that act on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.contract import SESSION, TARGET, TIMESTAMP
from wattline.functions.coerce import numeric
from wattline.operators.columns import POWER_CHANNEL_TOKENS, POWER_TOKENS, has_token, numeric_columns
from wattline.operators.wide import column_stats

# The audit flags strictly above its limit and needs more than 8
# pairs; the loader guard drops at or above the same limit and needs 12 pairs.
CORR_LIMIT = 0.995
AUDIT_MIN_PAIRS = 9
GUARD_MIN_PAIRS = 12
FEATURES_PER_PASS = 4  # a correlation carries ten running sums


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; null for a constant column.

    Written with moments because ``corr`` divides by zero on constants in ANSI mode.
    """
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def target_correlations(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    """(feature, pairs, corr) of every feature with the target."""
    y = F.col("__y")
    return column_stats(
        df.where(numeric(df, target).isNotNull()),
        features,
        lambda _, x: {"pairs": F.count(x), "corr": correlation(x, y)},
        extra={"__y": numeric(df, target)},
        size=FEATURES_PER_PASS,
    )


def audit(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Per numeric feature: correlation with the target and both leakage flags."""
    if target not in df.columns:
        raise ValueError(f"Without '{target}' there is nothing to audit against.")
    features = [c for c in numeric_columns(df) if c != target]
    if not features:
        raise ValueError("Dataset audit found no numeric feature.")
    corr = F.when(F.col("pairs") >= AUDIT_MIN_PAIRS, F.abs("corr"))
    named = [f for f in features if has_token(f, POWER_TOKENS)]
    return (
        target_correlations(df, features, target)
        .withColumn("abs_corr_with_target", corr)
        .select(
            "feature",
            "abs_corr_with_target",
            F.col("feature").isin(named).alias("name_leakage_risk"),
            F.coalesce(F.col("abs_corr_with_target") > CORR_LIMIT, F.lit(False)).alias("corr_leakage_risk"),
        )
        .orderBy(F.col("abs_corr_with_target").desc_nulls_last(), "feature")
    )


def audit_totals(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Row count, number of numeric features and of each flag."""
    flags = audit(df, target)
    return flags.agg(
        F.lit(df.count()).cast("bigint").alias("n_rows"),
        F.count("*").alias("n_features_numeric"),
        F.count_if("name_leakage_risk").alias("n_name_leakage_flags"),
        F.count_if("corr_leakage_risk").alias("n_corr_leakage_flags"),
    )


def sparse_columns(df: DataFrame, protect: Sequence[str] = (TARGET, SESSION, TIMESTAMP)) -> list[str]:
    """Columns with fewer than max(40, a quarter of the rows) values; keys and target are kept."""
    stats = column_stats(
        df, df.columns, lambda _, x: {"n": F.count(x), "rows": F.count(F.lit(1))}, lambda d, c: d[f"`{c}`"]
    )
    few = {r["feature"] for r in stats.collect() if r["n"] < max(40, int(0.25 * r["rows"]))}
    return [c for c in df.columns if c in few and c not in protect]


def flat_columns(df: DataFrame, protect: Sequence[str] = (TARGET,)) -> list[str]:
    """Numeric columns that are nearly empty (below max(20, 5 %)) or hold a single value."""
    names = [c for c in numeric_columns(df) if c not in protect]
    if not names:
        return []
    stats = column_stats(
        df, names, lambda _, x: {"n": F.count(x), "lo": F.min(x), "hi": F.max(x), "rows": F.count(F.lit(1))}
    )
    bad = {r["feature"] for r in stats.collect() if r["n"] < max(20, int(0.05 * r["rows"])) or r["lo"] == r["hi"]}
    return [c for c in names if c in bad]


def power_named_columns(df: DataFrame, target: str = TARGET) -> list[str]:
    """Columns whose name says they carry power, energy, voltage or current."""
    return [c for c in df.columns if c != target and has_token(c, POWER_CHANNEL_TOKENS)]


def leaking_columns(df: DataFrame, target: str = TARGET, threshold: float = CORR_LIMIT) -> list[str]:
    """Numeric columns that nearly repeat the target."""
    names = [c for c in numeric_columns(df) if c != target]
    if target not in df.columns or not names:
        return []
    rows = target_correlations(df, names, target).where(
        (F.col("pairs") >= GUARD_MIN_PAIRS) & (F.abs("corr") >= threshold)
    )
    return sorted(r["feature"] for r in rows.collect())


def decisions(df: DataFrame, dropped: Sequence[str]) -> DataFrame:
    """A guard's verdict as a table: (column, dropped)."""
    rows = [(c, c in set(dropped)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, dropped boolean")


def plausible_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows whose target is strictly between 0 and 2000 W."""
    return df.where((F.col(target) > 0) & (F.col(target) < 2000))
