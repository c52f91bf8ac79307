"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word separators of every operator here: the ASCII white space, and nothing else.
WORD = "[^\\x20\\x09-\\x0D]+"
SLICE_BYTES = 4 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did, as local mode needs; clusters install it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns can't clash."""
    return df.select(*[F.col(quoted(source)).alias(name) for name, source in columns.items()])


def quoted(name: str) -> str:
    """A column name that is read literally, with its dots and back ticks."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    """Every column of ``df`` under its own name, whatever characters the name has."""
    return [F.col(quoted(c)) for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use, in any case of letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, to size partitions by."""
    return int(df.agg(F.sum(F.octet_length(F.col(quoted(column)))).alias("n")).first()["n"] or 0)


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // each))


def text_slices(batches: Iterable[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text of each has about ``most`` bytes, or is a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text falls into the held-out fold; null ids don't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(False))
