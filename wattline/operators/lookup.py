"""Look up one value per key in a table of any size, also where a few keys hold most rows.

The table says of each key whether it is *hot*. Hot keys are few by their share of the rows,
so they are broadcast. The other keys are broadcast while counted few, and joined by a
shuffle beyond; rows whose key is hot are dealt over all tasks of that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot if more than one row in HOT_SHARE carries it; fewer than HOT_SHARE keys can be.
HOT_SHARE = 1000
BROADCAST_KEYS = 100_000
SPREAD = 1 << 20

_PLAIN = (T.NumericType, T.StringType, T.DatetimeType, T.BooleanType, T.BinaryType)


def is_hot(rows: Column, total: Column, share: int = HOT_SHARE) -> Column:
    """Whether ``rows`` of ``total`` rows are more than one in ``share``."""
    return rows * share > total


def dealt(df: DataFrame) -> Column:
    """A number from 0 to SPREAD - 1 by the row and its partition, the same when a lost task runs again."""
    plain = [f for f in df.schema.fields if isinstance(f.dataType, _PLAIN)]
    cells = [F.col("`" + f.name.replace("`", "``") + "`") for f in plain]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *cells), F.lit(SPREAD))


def look_up(
    df: DataFrame, side: DataFrame, keys: int, key: Column, name: str, broadcast_keys: int | None = None
) -> DataFrame:
    """Add ``name``: the ``found`` of the row's key in ``side`` (key, found, hot), null where it is not there.

    ``side`` has one row per key, ``keys`` is how many, or more. A null key finds nothing, and
    a key that ``side`` lacks but many rows share is left to adaptive execution to split.
    """
    limit = BROADCAST_KEYS if broadcast_keys is None else broadcast_keys
    if keys <= limit:
        small = F.broadcast(side.select(F.col("key").alias("__key"), F.col("found").alias(name)))
        return df.join(small, key == F.col("__key"), "left").drop("__key")
    hot = F.broadcast(side.where("hot").select(F.col("key").alias("__key"), F.col("found").alias("__hot")))
    open_ = F.col("__hot").isNull() & key.isNotNull()
    first = df.withColumn("__deal", dealt(df)).join(hot, key == F.col("__key"), "left")
    # One key of both parts: beside a constant of its own the optimizer would shuffle by the key alone.
    own = F.struct(F.when(open_, F.lit(-1).cast("bigint")).otherwise(F.col("__deal")).alias("deal"), F.when(open_, key).alias("key"))
    rest = side.where(~F.col("hot")).select(
        F.struct(F.lit(-1).cast("bigint").alias("deal"), F.col("key")).alias("__at"), F.col("found").alias("__rest")
    )
    out = first.withColumn("__at", own).drop("__key").join(rest, "__at", "left").withColumn(name, F.coalesce("__hot", "__rest"))
    return out.drop("__at", "__deal", "__hot", "__rest")
