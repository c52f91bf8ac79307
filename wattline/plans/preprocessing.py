"""Feature preprocessing fitted with aggregates and kept as saveable ML stages.

Numbers: median fill, then standardise with the population deviation. Text: fill
with the most frequent value (ties to the smaller one), then one-hot with all
zeros for values not seen in training. The fitted form is one ``SQLTransformer``
plus indexer, encoder and assembler, so it runs in whole-stage code, saves with
the model and works on streams. Where the text columns have more than ``LISTED``
values together, or an empty one, a stored table of numbered values takes the place of indexer and
encoder (``categories.py``), so that no list of labels reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.coerce import numeric
from wattline.operators.drift import value_counts
from wattline.operators.selection import medians, weighted_medians
from wattline.operators.wide import column_stats
from wattline.plans.categories import CategoryVectors, number_categories
from wattline.session import spool

FEATURES = "features"
# Labels that an indexer may keep on the driver, all text columns together.
LISTED = 10_000


@dataclass
class Preprocessor:
    """Fitted preprocessing, the width of its vector and the names of the slots.

    ``slots`` is None where there are too many to list; ``slot_names`` has them at any width.
    """

    pipeline: PipelineModel
    numeric: list[str]
    categorical: list[str]
    slots: list[str] | None
    width: int
    dropped: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)

    def slot_names(self, spark: SparkSession) -> DataFrame:
        """(slot, name) of every slot, as a table."""
        if self.slots is None:
            return self.pipeline.stages[-1].slot_names(spark)
        return spark.createDataFrame(list(enumerate(self.slots)), "slot bigint, name string")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"{value!r}D"


def category_counts(
    df: DataFrame, columns: Sequence[str], max_categories: int | None = None, weight: str | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """The stored (feature, value, n) of text columns, and how many values each has.

    ``max_categories`` makes a wider column an error that names it. ``weight`` names the
    column that says how many rows a row stands for.
    """
    counts = spool(value_counts(df, columns, weight), "values")
    sizes = {r["feature"]: r["n"] for r in counts.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    wide = {c: n for c, n in sizes.items() if max_categories is not None and n > max_categories}
    if wide:
        raise ValueError(f"Too many categories for one-hot (limit {max_categories}): {wide}. Exclude these columns.")
    return counts, sizes


def _listed(counts: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """(value, count) of each text column that has values, sorted by value. Counted few before."""
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in counts.collect():
        out[r["feature"]].append((r["value"], r["n"]))
    return {c: sorted(v) for c, v in out.items() if v}


def _weighted_stats(df: DataFrame, columns: Sequence[str], value, weight: str) -> dict[str, dict[str, float]]:
    """Mean and population deviation of rows that stand for several; the mean is found first, for the digits."""
    extra = {"w": F.col(weight)}
    w = F.col("w")
    first = column_stats(df, columns, lambda _, x: {"mean": F.sum(x * w) / F.sum(w), "low": F.min(x), "high": F.max(x)}, value, extra)
    found = {r["feature"]: r.asDict() for r in first.collect()}
    apart = lambda c, x: (x - F.lit(found[c]["mean"])) * (x - F.lit(found[c]["mean"]))
    second = column_stats(df, columns, lambda c, x: {"scale": F.sqrt(F.sum(apart(c, x) * w) / F.sum(w))}, value, extra)
    for r in second.collect():
        flat = found[r["feature"]]["low"] == found[r["feature"]]["high"]
        found[r["feature"]]["scale"] = 0.0 if flat else r["scale"]
    return found


def numeric_fit(
    df: DataFrame, columns: Sequence[str], exact: bool = True, weight: str | None = None
) -> dict[str, tuple[float, float, float]]:
    """{column: (fill, mean, scale)} after median fill; all-null columns are left out."""
    fill = medians(df, columns, exact) if weight is None else weighted_medians(df, columns, weight)
    kept = [c for c in columns if c in fill]
    if not kept:
        return {}
    filled = lambda d, c: F.coalesce(numeric(d, c), F.lit(fill[c]))
    if weight is None:
        stats = column_stats(df, kept, lambda _, x: {"mean": F.avg(x), "scale": F.stddev_pop(x)}, filled)
        at = {r["feature"]: r for r in stats.collect()}
    else:
        at = _weighted_stats(df, kept, filled, weight)
    return {c: (fill[c], at[c]["mean"], at[c]["scale"] or 1.0) for c in kept}


def fit_preprocessor(
    df: DataFrame,
    numeric_columns: Sequence[str],
    categorical_columns: Sequence[str],
    exact: bool = True,
    max_categories: int | None = None,
    weight: str | None = None,
) -> Preprocessor:
    """Fit on a training table whose numeric columns are already numbers.

    With ``weight``, a column of counts, the table has one row per distinct input.
    """
    numbers = numeric_fit(df, list(numeric_columns), exact, weight)
    counts, sizes = category_counts(df, list(categorical_columns), max_categories, weight) if categorical_columns else (None, {})
    texts = [c for c in categorical_columns if sizes.get(c)]
    dropped = [c for c in numeric_columns if c not in numbers] + [c for c in categorical_columns if c not in texts]
    if not numbers and not texts:
        raise ValueError("No usable feature column.")
    parts = [
        f"(coalesce(if(abs(cast(`{c}` as double)) < double('Infinity'), cast(`{c}` as double), null), {_number(f)})"
        f" - {_number(m)}) / {_number(s)} AS `num__{c}`"
        for c, (f, m, s) in numbers.items()
    ]
    fills: dict[str, object] = {c: f for c, (f, _, _) in numbers.items()}
    # An indexer's label can't be the empty text.
    listed = sum(sizes.values()) <= LISTED and not (texts and not counts.where(F.col("value") == "").isEmpty())
    if not texts:
        tables = {}
    elif listed:
        tables = _listed(counts, texts)
        fills |= {c: min(v, key=lambda x: (-x[1], x[0]))[0] for c, v in tables.items()}
    else:
        numbered = number_categories(counts, texts)
        fills |= numbered.fills
    parts += [f"coalesce(cast(`{c}` as string), {_text(fills[c])}) AS `cat__{c}`" for c in texts]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    plain = [f"num__{c}" for c in numbers]
    if not listed:
        last = CategoryVectors(
            table=numbered.path, numbers=plain, columns=numbered.columns, sizes=numbered.sizes, outputCol=FEATURES
        )
        slots, width = None, last.width
    else:
        if texts:
            indexer = StringIndexerModel.from_arrays_of_labels(
                [[v for v, _ in tables[c]] for c in texts],
                inputCols=[f"cat__{c}" for c in texts],
                outputCols=[f"ix__{c}" for c in texts],
                handleInvalid="keep",
            )
            # The indexer's last label is "unknown"; dropping that slot leaves all zeros.
            encoder = OneHotEncoder(
                inputCols=[f"ix__{c}" for c in texts], outputCols=[f"oh__{c}" for c in texts], dropLast=True
            )
            stages += [indexer, encoder.fit(PipelineModel([*stages, indexer]).transform(df.limit(1)))]
        last = VectorAssembler(inputCols=[*plain, *[f"oh__{c}" for c in texts]], outputCol=FEATURES)
        slots = [*plain, *[f"cat__{c}_{v}" for c in texts for v, _ in tables[c]]]
        width = len(slots)
    return Preprocessor(
        PipelineModel([*stages, last]), list(numbers), texts, slots, width, dropped, fills,
        {c: m for c, (_, m, _) in numbers.items()}, {c: s for c, (_, _, s) in numbers.items()},
    )
