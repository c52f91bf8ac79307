"""One-hot slots of text columns with very many values, without their labels on the driver.

The values are counted and numbered once by a distributed sort and stored as a table
``feature, value, ix, hot``. Rows look their number up in that table by a join, and the
sparse vector is built from the numbers. The driver sees one line per column.

Values that many rows carry are broadcast and never shuffled onto one task (``lookup.py``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.lookup import HOT_SHARE, is_hot, look_up
from wattline.operators.ordering import row_index
from wattline.session import spool_path

MAX_SLOTS = (1 << 31) - 1


@dataclass(frozen=True)
class Categories:
    """A stored table of numbered values, the columns in it, their sizes and fill values."""

    path: str
    columns: list[str]
    sizes: list[int]
    fills: dict[str, str]


def number_categories(counts: DataFrame, columns: Sequence[str], hot_share: int = HOT_SHARE) -> Categories:
    """Number the values of each column from 0 in their order and store the table.

    ``counts`` is (feature, value, n). A column without a value is left out. The fill value
    is the most frequent one, ties go to the smaller.
    """
    spark = counts.sparkSession
    placed = row_index(counts, ["feature", "value"], "__at")
    facts = placed.groupBy("feature").agg(
        F.min("__at").alias("__first"),
        F.count("*").alias("__size"),
        F.sum("n").alias("__rows"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("__fill"),
    )
    at = {r["feature"]: r for r in facts.collect()}  # one row per column
    kept = [c for c in columns if c in at]
    side = spark.createDataFrame([(c, at[c]["__first"], at[c]["__rows"]) for c in kept], "feature string, __first bigint, __rows bigint")
    table = placed.join(F.broadcast(side), "feature").select(
        "feature", "value", (F.col("__at") - F.col("__first")).alias("ix"), is_hot(F.col("n"), F.col("__rows"), hot_share).alias("hot")
    )
    path = spool_path(spark, "categories")
    table.write.parquet(path)
    return Categories(path, kept, [at[c]["__size"] for c in kept], {c: at[c]["__fill"] for c in kept})


def sparse_vector(width: int, indices: Column, values: Column) -> Column:
    """A sparse ML vector from ascending indices and their values, inside the JVM.

    The vector's stored form is a struct; reading it back as JSON gives it its type. It
    carries no attribute per slot, which a very wide vector could not afford.
    """
    struct = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"), indices.alias("indices"), values.alias("values")
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(struct.alias("v"))), schema)["v"]


class CategoryVectors(Transformer, MLReadable, MLWritable):
    """Numbers and numbered texts as one sparse vector; saves its table with itself.

    Slots are the ``numbers`` first, then one per value of each column. A value that the
    table doesn't hold sets no slot of its column.
    """

    table = Param(Params._dummy(), "table", "folder of the numbered values", TypeConverters.toString)
    numbers = Param(Params._dummy(), "numbers", "number columns", TypeConverters.toListString)
    columns = Param(Params._dummy(), "columns", "text columns as the table names them", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "values of each text column", TypeConverters.toListInt)
    outputCol = Param(Params._dummy(), "outputCol", "the vector's name", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, table=None, numbers=None, columns=None, sizes=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        if sizes is not None and self.width > MAX_SLOTS:
            raise ValueError(f"A vector has at most {MAX_SLOTS} slots, these columns need {self.width}.")

    @property
    def width(self) -> int:
        return len(self.getOrDefault(self.numbers)) + sum(self.getOrDefault(self.sizes))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stored = dataset.sparkSession.read.parquet(self.getOrDefault(self.table))
        numbers = self.getOrDefault(self.numbers)
        out, offset = dataset, len(numbers)
        indices = [F.array(*[F.lit(i) for i in range(offset)]).cast("array<int>")]
        values = [F.array(*[F.col(f"`{c}`").cast("double") for c in numbers]).cast("array<double>")]
        for c, size in zip(self.getOrDefault(self.columns), self.getOrDefault(self.sizes)):
            side = stored.where(F.col("feature") == c).select(F.col("value").alias("key"), F.col("ix").alias("found"), "hot")
            out = look_up(out, side, size, F.col(f"`cat__{c}`"), f"ix__{c}")
            out = out.withColumn(f"ix__{c}", F.coalesce(F.col(f"`ix__{c}`"), F.lit(size)).cast("double"))
            slot = F.col(f"`ix__{c}`")
            known = slot < size
            none_i, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
            indices.append(F.when(known, F.array((slot + offset).cast("int"))).otherwise(none_i))
            values.append(F.when(known, F.array(F.lit(1.0))).otherwise(none_v))
            offset += size
        return out.withColumn(self.getOrDefault(self.outputCol), sparse_vector(offset, F.concat(*indices), F.concat(*values)))

    def slot_names(self, spark) -> DataFrame:
        """(slot, name) of every slot, as a table."""
        numbers = self.getOrDefault(self.numbers)
        at, offset = [], len(numbers)
        for c, size in zip(self.getOrDefault(self.columns), self.getOrDefault(self.sizes)):
            at.append((c, offset))
            offset += size
        starts = F.broadcast(spark.createDataFrame(at, "feature string, __start bigint"))
        texts = spark.read.parquet(self.getOrDefault(self.table)).join(starts, "feature").select(
            (F.col("ix") + F.col("__start")).alias("slot"), F.concat(F.lit("cat__"), "feature", F.lit("_"), "value").alias("name")
        )
        return spark.createDataFrame(list(enumerate(numbers)), "slot bigint, name string").unionByName(texts)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: CategoryVectors):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        stored = self.sparkSession.read.parquet(self.instance.getOrDefault(self.instance.table))
        stored.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CategoryVectors:
        found = DefaultParamsReader(self.cls).load(path)
        return found._set(table=f"{path}/table")
