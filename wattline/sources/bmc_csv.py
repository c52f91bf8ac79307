"""Board-controller traces: unit repair, target inference, guards and normalisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.contract import SESSION, TARGET, TIMESTAMP
from wattline.functions.coerce import as_time, numeric
from wattline.functions.scalars import used_share_pct
from wattline.operators.audit import (
    flat_columns,
    leaking_columns,
    plausible_target,
    power_named_columns,
    sparse_columns,
)
from wattline.operators.columns import numeric_columns
from wattline.operators.selection import medians
from wattline.session import spool
from wattline.sources.files import headers, names_in, read_trace_csv

# Bookkeeping columns of the export and columns that stay text.
BOOKKEEPING = ("result", "table", "_start", "_stop")
TEXT_COLUMNS = ("_time", "_measurement", "device_id", "name_gpu0", "source_file")
# Fixed values: (name parts, median above, divide by); the first rule that fits applies.
UNIT_RULES = (
    (("temp", "inlet", "outlet"), 500.0, 1000.0),
    (("vin", "cin"), 2000.0, 1000.0),
    (("power",), 1_000_000.0, 1_000_000.0),
    (("power",), 5_000.0, 1000.0),
)
RENAMES = {"util_gpu0": "gpu_utilization_pct", "temp_gpu0": "temperature_c", "_time": TIMESTAMP}


def pick_trace_files(names: DataFrame, max_files: int | None = None, seed: int = 42) -> DataFrame:
    """The CSV names in order: all, or a seeded choice of ``max_files`` without replacement.

    ``names`` has one column ``name``. The choice is by hash, so the same seed and
    names always give the same files.
    """
    csv = names.where(F.lower("name").endswith(".csv")).select("name").distinct()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("name")))
    return (csv if max_files is None else csv.orderBy(key, "name").limit(max_files)).orderBy("name")


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_bmc_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Trace files as text, one read per distinct header, joined by column name."""
    frames = [read_trace_csv(spark, cells, files) for cells, files in headers(spark, paths)]
    if not frames:
        raise ValueError("No CSV files found.")
    return concat_frames(frames).drop(*BOOKKEEPING)


def coerce_sensors(raw: DataFrame) -> DataFrame:
    """Parse the time, drop rows without one, make every sensor column a number."""
    if "_time" not in raw.columns:
        raise ValueError("Expected a '_time' column in the trace files.")
    columns = [
        as_time(raw, "_time").alias("_time") if c == "_time" else
        F.col(f"`{c}`") if c in TEXT_COLUMNS else numeric(raw, c).alias(c)
        for c in raw.columns
    ]
    return raw.select(*columns).dropna(subset=["_time"])


def unit_divisor(name: str, median: float | None) -> float:
    """What a column has to be divided by, judged by its name and median."""
    if median is None:
        return 1.0
    for tokens, above, divisor in UNIT_RULES:
        if median > above and any(t in name.lower() for t in tokens):
            return divisor
    return 1.0


def repair_units(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rescale columns whose median shows milli- or micro-units."""
    tokens = [t for rule in UNIT_RULES for t in rule[0]]
    suspects = [c for c in numeric_columns(df) if any(t in c.lower() for t in tokens)]
    found = medians(df, suspects, exact)
    scale = {c: unit_divisor(c, found.get(c)) for c in suspects}
    return df.withColumns({c: F.col(f"`{c}`") / d for c, d in scale.items() if d != 1.0})


def merge_duplicates(df: DataFrame) -> DataFrame:
    """Mean of every numeric column per (source_file, _time)."""
    keys = [k for k in ("source_file", "_time") if k in df.columns]
    numbers = [c for c in numeric_columns(df) if c not in keys]
    if not numbers:
        raise ValueError("No numeric columns found in the trace files.")
    return df.groupBy(*keys).agg(*[F.avg(f"`{c}`").alias(c) for c in numbers])


def infer_target(df: DataFrame) -> DataFrame:
    """Device power, else the sum of both supplies, else the first supply, as the target."""
    if "power_gpu0" in df.columns:
        return df.withColumnRenamed("power_gpu0", TARGET)
    supplies = [F.coalesce(F.col(f"PSU{i}_Total_Power"), F.lit(0.0)) for i in (1, 2)]
    if {"PSU1_Total_Power", "PSU2_Total_Power"} <= set(df.columns):
        return df.withColumn(TARGET, supplies[0] + supplies[1])
    if "PSU1_Total_Power" in df.columns:
        return df.withColumnRenamed("PSU1_Total_Power", TARGET)
    raise ValueError("Could not infer a power target from the trace columns.")


def add_memory_share(df: DataFrame) -> DataFrame:
    """Memory utilisation from used and total memory when it is not reported."""
    if "memory_utilization_pct" in df.columns or not {"mem_total_gpu0", "mem_used_gpu0"} <= set(df.columns):
        return df
    return df.withColumn("memory_utilization_pct", used_share_pct(F.col("mem_used_gpu0"), F.col("mem_total_gpu0")))


def finalize(df: DataFrame) -> DataFrame:
    """Normalised names, session and workload label."""
    out = df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in df.columns})
    session = F.col("source_file").cast("string") if "source_file" in out.columns else F.lit("bmc_session_0")
    return out.withColumns({SESSION: session, "workload_type": F.lit("bmc_real_trace")})


def normalize_bmc(raw: DataFrame, exact: bool = True) -> DataFrame:
    """Full path from raw trace text to guarded, normalised telemetry.

    The typed readings are stored once, so that the text is parsed a single time and
    the medians read only the columns they need. So is the merged table, because the
    guards look at it several times.
    """
    typed = spool(coerce_sensors(raw), "readings")
    merged = merge_duplicates(repair_units(typed, exact))
    table = spool(add_memory_share(infer_target(merged)), "traces")
    keep = (TARGET, "source_file", "_time")
    table = table.drop(*sparse_columns(table, keep))
    table = plausible_target(table.drop(*power_named_columns(table)))
    table = table.drop(*flat_columns(table, keep))
    table = table.drop(*leaking_columns(table))
    return finalize(table)


def read_bmc_folder(spark: SparkSession, folder: str, max_files: int | None = None, seed: int = 42, exact: bool = True) -> DataFrame:
    """Normalised telemetry from all CSV traces in a folder, or a seeded choice of ``max_files``."""
    listing = spark.createDataFrame([(n,) for n in names_in(spark, folder)], "name string")
    chosen = [r["name"] for r in pick_trace_files(listing, max_files, seed).collect()]
    if not chosen:
        raise ValueError(f"No CSV files found under {folder}.")
    return normalize_bmc(scan_bmc_csv(spark, [f"{folder.rstrip('/')}/{n}" for n in chosen]), exact)
