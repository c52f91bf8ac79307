"""Permutation importance without pairing rows by a global index.

Each repeat puts the rows in a random order by hash and cuts that order into
blocks of a bounded number of rows. Inside its block a row takes the feature
values of the next row, the last takes those of the first, so every column is
permuted and no row is lost. One shuffle per repeat serves all features, and the
hash is taken over a unique row position, so copies of a row never pile up.
Repeats of a large table are shuffled in passes, and a pass's files go when it has
ended: what lies on disk at once follows the table, not the table times the repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.contract import TARGET
from wattline.functions.coerce import HASH_EXTENT, hash60
from wattline.operators.metrics import regression_metrics
from wattline.operators.ordering import row_index
from wattline.session import shuffles_dropped

BLOCK_ROWS = 50_000
REPEATS = 8
PASS_ROWS = 100_000_000  # rows times repeats of one pass, unless one repeat has more

Scorer = Callable[[DataFrame], DataFrame]


def column_scorer(expression: Column) -> Scorer:
    """A scorer from a column expression."""
    return lambda df: df.withColumn("prediction", expression)


def permuted(
    indexed: DataFrame, features: Sequence[str], n: int, repeats: int = REPEATS, seed: int = 42, block_rows: int = BLOCK_ROWS, first: int = 0
) -> DataFrame:
    """Rows times repeats, counted from ``first``; ``__next`` holds the permuted feature values of the repeat."""
    blocks = max(1, -(-n // block_rows))
    many = indexed.withColumn("__repeat", F.explode(F.sequence(F.lit(first), F.lit(first + repeats - 1))))
    hashed = many.withColumn("__h", hash60(seed, F.col("__repeat"), F.col("__idx")))
    block = (F.col("__repeat") - first).cast("bigint") * blocks + F.pmod("__h", F.lit(blocks))
    # a block's hashes leave one remainder: their quotients stand in the same order and are shorter
    hashed = hashed.withColumn("__block", block).withColumn("__h", F.expr(f"__h div {blocks}L")).drop("__repeat")
    # Block and leading hash bits in one number are sorted without comparing rows. The window's own
    # sort by block, hash and position then meets rows in order, and only settles equal numbers.
    long = (HASH_EXTENT[1] // blocks).bit_length()
    bits = min(long, 63 - (repeats * blocks).bit_length())
    place = F.shiftleft("__block", bits).bitwiseOR(F.shiftright("__h", long - bits))
    placed = hashed.repartition("__block").sortWithinPartitions(place)
    w = Window.partitionBy("__block").orderBy("__h", "__idx")
    values = F.struct(*[F.col(f"`{c}`") for c in features])
    start = F.first(values).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = placed.withColumn("__next", F.coalesce(F.lead(values).over(w), start))
    return out.withColumn("repeat", F.expr(f"int(__block div {blocks}L) + {first}")).drop("__h", "__block")


def permutation_importance(
    df: DataFrame,
    scorer: Scorer,
    features: Sequence[str],
    order: Sequence[str],
    repeats: int = REPEATS,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean rise of the RMSE when one feature is permuted, largest first."""
    spark = df.sparkSession
    with shuffles_dropped(spark):
        indexed = row_index(df, order, "__idx")
        n = indexed.count()
        base = regression_metrics(scorer(df).withColumn("model", F.lit("base"))).first()["rmse"]
        some, found = max(1, min(repeats, PASS_ROWS // max(1, n))), []
        for first in range(0, repeats, some):
            rows = permuted(indexed, features, n, min(some, repeats - first), seed, block_rows, first)
            # Each row stands once per feature, with only that feature exchanged.
            each = rows.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in features])))
            swapped = each.withColumns(
                {c: F.when(F.col("feature") == c, F.col(f"__next.`{c}`")).otherwise(F.col(f"`{c}`")) for c in features}
            ).drop("__next")
            found += regression_metrics(scorer(swapped), ["feature", "repeat"]).select("feature", "repeat", "rmse").collect()
    per = spark.createDataFrame(found, "feature string, repeat int, rmse double")  # a line per feature and repeat
    return (
        per.groupBy("feature")
        .agg(F.avg(F.col("rmse") - F.lit(base)).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
    )


def model_scorer(pipeline, keep: Sequence[str] = (TARGET, "feature", "repeat")) -> Scorer:
    """A scorer from a fitted pipeline that carries only what the metrics need."""

    def run(df: DataFrame) -> DataFrame:
        out = pipeline.transform(df)
        return out.select(*[c for c in keep if c in out.columns], "prediction")

    return run
