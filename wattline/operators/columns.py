"""Schema-time helpers: which columns are numeric, which are features, which families."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.contract import TARGET, TIMESTAMP

# Name parts that mark a column as a power reading.
POWER_TOKENS = ("power", "energy", "watt")
# Wider list used when board-controller traces are loaded.
POWER_CHANNEL_TOKENS = ("power", "energy", "watts", "psu", "_cin", "_vin")
# Name prefixes of host-side sensors.
SYSTEM_PREFIXES = ("cpu", "freq", "load", "PSU", "mem_", "cycles", "cache")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def feature_columns(
    df: DataFrame, target: str = TARGET, exclude: Sequence[str] = (TIMESTAMP,)
) -> tuple[list[str], list[str]]:
    """(numeric, categorical) model features; everything that is not a number is categorical."""
    skip = {target, *exclude}
    numbers = [c for c in numeric_columns(df) if c not in skip]
    others = [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in skip]
    return numbers, others


def has_token(name: str, tokens: Iterable[str]) -> bool:
    return any(t in name.lower() for t in tokens)


# Patterns a name of each kind of column matches.
KIND_PATTERNS = {
    "accelerator": "gpu|memory_|clock",
    "thermal": "temp|ambient",
    "host": "^(?:" + "|".join(SYSTEM_PREFIXES) + ")",
    "label": "^workload_type$",
}
# The kinds that make up each ablation set; no kinds means every column.
ABLATION_SETS = {
    "all_features": (),
    "gpu_only": ("accelerator", "label"),
    "gpu_plus_thermal": ("accelerator", "thermal", "label"),
    "system_only": ("host", "thermal"),
}


def feature_families(columns: Sequence[str]) -> dict[str, list[str]]:
    """Named feature sets for ablation; power-like names never take part."""
    usable = [c for c in columns if c not in (TARGET, TIMESTAMP) and not has_token(c, POWER_TOKENS)]

    def members(kinds: Sequence[str]) -> list[str]:
        wanted = re.compile("|".join(KIND_PATTERNS[k] for k in kinds))
        return sorted({c for c in usable if wanted.search(c)})

    return {name: members(kinds) if kinds else usable for name, kinds in ABLATION_SETS.items()}


def family_table(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    rows = [(name, c) for name, cols in feature_families(columns).items() for c in cols]
    return spark.createDataFrame(rows, "feature_set string, feature string")


def select_features(
    df: DataFrame, wanted: Sequence[str], target: str = TARGET, keys: Sequence[str] = ()
) -> DataFrame:
    """Keep the wanted features that exist, the target and the keys."""
    numbers, others = feature_columns(df, target)
    keep = [c for c in numbers + others if c in set(wanted)]
    if not keep:
        raise ValueError("None of the selected features is a column of the dataset.")
    extra = [k for k in keys if k in df.columns and k not in keep]
    return df.select(*keep, target, *[k for k in extra if k != target])


def column_difference(spark: SparkSession, expected: Sequence[str], present: Sequence[str]) -> DataFrame:
    """Set difference of column names both ways: (feature, side)."""
    left, right = F.array(*map(F.lit, expected)), F.array(*map(F.lit, present))
    if not expected:
        left = F.array().cast("array<string>")
    if not present:
        right = F.array().cast("array<string>")
    sides = F.concat(
        F.transform(F.array_except(left, right), lambda c: F.struct(c.alias("feature"), F.lit("missing").alias("side"))),
        F.transform(F.array_except(right, left), lambda c: F.struct(c.alias("feature"), F.lit("extra").alias("side"))),
    )
    return spark.range(1).select(F.explode(sides).alias("d")).select("d.*")
