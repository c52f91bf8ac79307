"""Statistics of many columns.

One aggregate over very many columns compiles to a method that the JVM refuses to
optimise, and gets an order of magnitude slower. Columns are therefore handled a
few at a time. Each group reads only its own columns, so a columnar source is
still read once overall, and all groups run in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.coerce import numeric

PASS_COLUMNS = 8


def groups(columns: Sequence[str], size: int = PASS_COLUMNS) -> Iterator[list[str]]:
    for i in range(0, len(columns), size):
        yield list(columns[i : i + size])


def column_stats(
    df: DataFrame,
    columns: Sequence[str],
    build: Callable[[str, Column], Mapping[str, Column]],
    value: Callable[[DataFrame, str], Column] = numeric,
    extra: Mapping[str, Column] | None = None,
    size: int = PASS_COLUMNS,
) -> DataFrame:
    """One row per column: ``feature`` and the aggregates that ``build`` names.

    ``build`` gets the column's name and its cleaned value; ``extra`` adds shared
    columns that the aggregates may use.
    """
    parts = []
    for group in groups(columns, size):
        base = df.select(
            *[value(df, c).alias(f"x{i}") for i, c in enumerate(group)], *[e.alias(n) for n, e in (extra or {}).items()]
        )
        built = [build(c, F.col(f"x{i}")) for i, c in enumerate(group)]
        row = base.agg(*[e.alias(f"{n}_{i}") for i, b in enumerate(built) for n, e in b.items()])
        cells = [
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{i}").alias(n) for n in b])
            for i, (c, b) in enumerate(zip(group, built))
        ]
        parts.append(row.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def unpivoted(
    df: DataFrame,
    columns: Sequence[str],
    value: Callable[[DataFrame, str], Column],
    names: tuple[str, str],
    prefix: Column | None = None,
    size: int = PASS_COLUMNS,
) -> DataFrame:
    """(name, value) rows of the non-null values of several columns."""
    label = (lambda c: F.lit(c)) if prefix is None else (lambda c: F.concat(prefix, F.lit("|" + c)))
    parts = []
    for group in groups(columns, size):
        cells = [F.struct(label(c).alias(names[0]), value(df, c).alias(names[1])) for c in group]
        parts.append(df.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts).dropna(subset=list(names))
