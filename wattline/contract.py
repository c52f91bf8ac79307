"""The normalised telemetry contract: columns, expected ranges and sources."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TARGET = "power_watts"
SESSION = "session_id"
TIMESTAMP = "timestamp"

# Column names of the normalised schema.
REQUIRED_COLUMNS = ("power_watts",)
RECOMMENDED_COLUMNS = (
    "timestamp",
    "session_id",
    "gpu_utilization_pct",
    "memory_utilization_pct",
    "graphics_clock_mhz",
    "memory_clock_mhz",
    "temperature_c",
    "workload_type",
)

# Plausible range of each physical column (low, high).
EXPECTED_RANGES = {
    "gpu_utilization_pct": (0.0, 100.0),
    "memory_utilization_pct": (0.0, 100.0),
    "temperature_c": (-20.0, 120.0),
    "ambient_c": (-20.0, 60.0),
    "graphics_clock_mhz": (0.0, 10000.0),
    "memory_clock_mhz": (0.0, 12000.0),
    "power_watts": (0.0, 2000.0),
}

# Thresholds of the suitability checks.
MIN_ROWS_FOR_MODELING = 500
MIN_SESSIONS = 3
MIN_ROWS_PER_SESSION = 20
MAX_OUT_OF_RANGE_SHARE = 0.05


@dataclass(frozen=True)
class SourceContract:
    name: str
    data_kind: str
    description: str
    required_columns: tuple[str, ...] = REQUIRED_COLUMNS
    recommended_columns: tuple[str, ...] = RECOMMENDED_COLUMNS
    session_column: str = SESSION
    timestamp_column: str = TIMESTAMP
    target_column: str = TARGET


# Source names and kinds.
_SOURCES = {
    "synthetic": ("synthetic", "Generated telemetry for development; says nothing about real accuracy."),
    "bmcdata_public": ("public_real_trace", "Board-controller traces brought to the common schema."),
    "mit_supercloud": ("public_real_trace", "Wide accelerator CSV exports of a public cluster."),
    "local_nvidia_smi": ("local_measured_trace", "Monitor-tool samples measured on an own machine."),
    "nrel_eagle": ("public_manual_trace", "Long-format metric CSV supplied by the user."),
}


def source_names() -> list[str]:
    return sorted(_SOURCES)


def contract(source: str) -> SourceContract:
    """Contract of one source; an unknown name is an error."""
    if source not in _SOURCES:
        raise ValueError(f"No source is called '{source}'.")
    kind, text = _SOURCES[source]
    return SourceContract(source, kind, text)


def contract_table(spark: SparkSession) -> DataFrame:
    """All registered contracts as a table, ordered by name."""
    words = T.ArrayType(T.StringType())
    schema = T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("data_kind", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("required_columns", words),
            T.StructField("recommended_columns", words),
            T.StructField("session_column", T.StringType()),
            T.StructField("timestamp_column", T.StringType()),
            T.StructField("target_column", T.StringType()),
        ]
    )
    rows = [
        tuple(list(v) if isinstance(v, tuple) else v for v in asdict(contract(n)).values())
        for n in source_names()
    ]
    return spark.createDataFrame(rows, schema).orderBy("name")
