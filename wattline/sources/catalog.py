"""One entry point over all telemetry sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wattline.contract import contract
from wattline.sources.bmc_csv import read_bmc_folder
from wattline.sources.long_csv import read_long_csv
from wattline.sources.wide_csv import read_wide_csv


def read_telemetry(
    spark: SparkSession,
    source: str,
    path: str | None = None,
    max_rows: int | None = None,
    max_files: int | None = None,
    seed: int = 42,
    exact: bool = True,
    cap_order: Sequence[str] | None = None,
) -> DataFrame:
    """Normalised telemetry of a source as a lazy DataFrame.

    All rows and all files are read unless ``max_rows`` or ``max_files`` asks for fewer.

    ``synthetic`` reads an already normalised Parquet table: this library has no
    random generator.
    """
    contract(source)
    if not path:
        raise ValueError(f"Source '{source}' needs the path of its data.")
    if source == "nrel_eagle":
        return read_long_csv(spark, path)
    if source == "bmcdata_public":
        return read_bmc_folder(spark, path, max_files, seed, exact)
    if source == "synthetic":
        return spark.read.parquet(path)
    return read_wide_csv(spark, path, source, max_rows, cap_order)
