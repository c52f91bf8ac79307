"""Small Hadoop file-system helpers and text-typed CSV scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def stem(name: str) -> str:
    base = name.rstrip("/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base[1:] else base


def read_text_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header, every column kept as text: no inference pass, no cast errors."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _header_cells(line: str) -> list[str]:
    import csv

    return next(csv.reader([line]))


def headers(spark: SparkSession, paths: str | Sequence[str], comment: str = "#") -> list[tuple[list[str], list[str]]]:
    """(header cells, files) for each distinct header among the files.

    One pass over the text finds each file's first line that is not a comment, among the
    splits that start a file; only headers and file names reach the driver.
    """
    lines = (
        spark.read.text(paths)
        .where(F.col("_metadata.file_block_start") == 0)
        .where((F.trim("value") != "") & ~F.col("value").startswith(comment))
        .select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    )
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for r in first.collect():
        groups.setdefault(r["header"], []).append(r["file"])
    return [(_header_cells(h), sorted(f)) for h, f in sorted(groups.items())]


def read_trace_csv(spark: SparkSession, columns: Sequence[str], files: Sequence[str], comment: str = "#") -> DataFrame:
    """CSV files that share one header, as text, plus ``source_file`` (the file's stem).

    Comment lines are skipped and short rows are padded with nulls. Rows with more
    fields than the header, empty ones included, are dropped: the reader reports every
    row of another length, and of those the separators outside quotes are counted.
    """
    odd = "__odd"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, odd]])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("comment", comment)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", odd)
        .option("columnPruning", False)  # else rows are not measured when columns go unused
        .csv(list(files))
        .select("*", F.col("_metadata.file_name").alias("__file"))
    )
    unquoted = F.regexp_replace(odd, '"[^"]*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    # the reader wants another column besides the odd rows, also where only rows are counted
    any_ = F.coalesce(F.length(F.col(f"`{columns[0]}`")), F.lit(0)) >= 0
    kept = df.where(any_ & (F.col(odd).isNull() | (fields <= len(columns))))
    return kept.withColumn("source_file", F.regexp_replace("__file", r"\.[^.]*$", "")).drop(odd, "__file")
