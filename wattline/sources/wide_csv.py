"""Wide accelerator CSV exports: alias resolution and normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.contract import SESSION, TARGET, TIMESTAMP
from wattline.functions.coerce import as_time, numeric, with_clean_names
from wattline.functions.scalars import session_of, trace_label
from wattline.operators.audit import plausible_target
from wattline.operators.ordering import first_rows
from wattline.sources.files import exists, is_directory, names_in, read_text_csv, stem

# Cleaned header names accepted for each normalised column, best first.
TARGET_ALIASES = ("power_draw_w", "power_draw_watts", "power_watts", "gpu_power_w", "gpu_power", "power")
TIME_ALIASES = ("timestamp", "time", "datetime", "ts")
JOB_ALIASES = ("job_id", "jobid", "slurm_job_id", "jid")
NODE_ALIASES = ("node", "hostname", "host", "node_id")
DEVICE_ALIASES = ("gpu", "gpu_id", "device_id", "minor_number", "index")
FEATURE_ALIASES = {
    "gpu_utilization_pct": (
        "utilization_gpu_pct", "gpu_utilization_pct", "utilization_gpu",
        "gpu_utilization", "sm_utilization", "sm_utilization_pct",
    ),
    "memory_utilization_pct": (
        "utilization_memory_pct", "memory_utilization_pct", "utilization_memory", "memory_utilization",
    ),
    "temperature_c": (
        "temperature_gpu", "temperature_gpu_c", "gpu_temperature", "gpu_temperature_c", "temperature_c",
    ),
    "memory_temperature_c": (
        "temperature_memory", "temperature_memory_c", "memory_temperature", "memory_temperature_c",
    ),
    "memory_used_mib": ("memory_used_mib", "memory_used_mb", "gpu_memory_used_mib", "gpu_memory_used_mb"),
    "memory_free_mib": ("memory_free_mib", "memory_free_mb", "gpu_memory_free_mib", "gpu_memory_free_mb"),
    "graphics_clock_mhz": ("clocks_sm_mhz", "sm_clock_mhz", "graphics_clock_mhz", "clock_sm_mhz"),
    "memory_clock_mhz": ("clocks_mem_mhz", "memory_clock_mhz", "clock_memory_mhz", "mem_clock_mhz"),
    "pcie_tx_mbps": ("pcie_tx_mbps", "pcie_tx_bytes", "pcie_tx"),
    "pcie_rx_mbps": ("pcie_rx_mbps", "pcie_rx_bytes", "pcie_rx"),
}
# File names looked for when a folder is given, best first.
PREFERRED_FILES = {
    "mit_supercloud": ("dcgm.csv", "nvidia_smi.csv"),
    "local_nvidia_smi": ("gpu_telemetry.csv", "nvidia_smi.csv"),
}
NEEDED = ("gpu_utilization_pct", "memory_utilization_pct", "temperature_c")


def first_present(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate that is a column."""
    have = set(columns)
    return next((c for c in candidates if c in have), None)


def resolve_file(spark: SparkSession, path: str, source: str) -> str:
    """The path itself, or the preferred file of a folder.

    A folder whose own name ends in ``.csv`` is one distributed CSV and is used whole.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"{source} path does not exist: {path}")
    if not is_directory(spark, path) or path.rstrip("/").endswith(".csv") or holds_parquet(spark, path):
        return path
    for name in PREFERRED_FILES[source]:
        candidate = f"{path.rstrip('/')}/{name}"
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(f"Expected one of {list(PREFERRED_FILES[source])} under {path}.")


def holds_parquet(spark: SparkSession, path: str) -> bool:
    """True for a folder of collected samples: Parquet files, or one folder per stream batch."""
    return is_directory(spark, path) and any(n.endswith(".parquet") or n.startswith("batch_id=") for n in names_in(spark, path))


def normalize_wide(
    raw: DataFrame, source: str, file_name: str, keep_session_id: bool = False, formats: Sequence[str] = ()
) -> DataFrame:
    """Bring a wide export to the normalised schema.

    Byte and MB columns are renamed without a unit conversion. An existing
    ``session_id`` or workload label is replaced unless ``keep_session_id``.
    """
    df = with_clean_names(raw)
    pick = lambda names: first_present(df.columns, names)
    target = pick(TARGET_ALIASES)
    if target is None:
        raise ValueError(f"{source} CSV must include a GPU power column such as 'power_draw_w' or 'power_watts'.")
    features = {name: pick(aliases) for name, aliases in FEATURE_ALIASES.items()}
    gone = [c for c in NEEDED if features[c] is None]
    if gone:
        raise ValueError(f"{source} CSV lacks key telemetry columns {gone}. Available: {', '.join(sorted(raw.columns))}")
    job, node, device, time = pick(JOB_ALIASES), pick(NODE_ALIASES), pick(DEVICE_ALIASES), pick(TIME_ALIASES)
    as_col = lambda name: None if name is None else F.col(name)
    columns = [numeric(df, target).alias(TARGET)]
    if time:
        columns.append(as_time(df, time, formats).alias(TIMESTAMP))
    if keep_session_id and SESSION in df.columns:
        columns.append(F.col(SESSION))
    else:
        columns.append(session_of(as_col(job), as_col(node), stem(file_name), as_col(device)).alias(SESSION))
    if device:
        columns.append(F.col(device).cast("string").alias("gpu_id"))
    columns += [numeric(df, src).alias(name) for name, src in features.items() if src]
    columns += [trace_label(source).alias("workload_type"), F.lit(file_name).alias("source_file")]
    return plausible_target(df.select(*columns))


def read_wide_csv(
    spark: SparkSession,
    path: str,
    source: str,
    max_rows: int | None = None,
    cap_order: Sequence[str] | None = None,
    keep_session_id: bool = False,
) -> DataFrame:
    """Read and normalise a wide accelerator CSV, or the Parquet that the intake stream wrote.

    ``max_rows`` caps the raw rows before any filter: the first of ``cap_order``, else
    of all columns from left to right. The cap stays distributed.
    """
    file = resolve_file(spark, path, source)
    stored = holds_parquet(spark, file)
    raw = spark.read.parquet(file) if stored else read_text_csv(spark, file)
    if raw.isEmpty():
        raise ValueError(f"{source} CSV is empty: {file}")
    if max_rows is not None:
        raw = first_rows(raw, cap_order or raw.columns, max_rows)
    out = normalize_wide(raw, source, file.rstrip("/").rsplit("/", 1)[-1], keep_session_id or stored)
    if out.isEmpty():
        raise ValueError(f"{source} CSV has no valid positive GPU power rows after normalisation.")
    return out
