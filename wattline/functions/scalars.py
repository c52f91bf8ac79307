"""Scalar telemetry expressions: clamps, ratios, labels and the analytic power model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical limits applied when readings are clamped (low, high).
CLAMP_LIMITS = {
    "gpu_utilization_pct": (0.0, 100.0),
    "memory_utilization_pct": (0.0, 100.0),
    "graphics_clock_mhz": (600.0, 2100.0),
    "memory_clock_mhz": (1800.0, 7500.0),
    "temperature_c": (22.0, 92.0),
    "power_watts": (18.0, 420.0),
}

# Typical utilisation by workload label (gpu, memory).
WORKLOAD_BASE = {
    "idle": (8, 15),
    "memory_bound": (42, 77),
    "compute_bound": (78, 43),
    "mixed": (62, 63),
    "inference": (54, 57),
    "training": (84, 71),
}


def clamp(c: Column, low: float, high: float, digits: int = 3) -> Column:
    """Limit to [low, high] and round half to even; null stays null."""
    limited = F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)
    return F.bround(limited, digits)


def used_share_pct(used: Column, total: Column) -> Column:
    """used / total in percent; null unless total is positive."""
    return F.when(total > 0, used / total * 100.0)


def analytic_power(
    gpu: Column, mem: Column, gclk: Column, mclk: Column, temp: Column
) -> Column:
    """Closed-form power estimate from utilisation, clocks and temperature."""
    return (
        F.lit(25.0)
        + F.lit(1.15) * gpu
        + F.lit(0.45) * mem
        + F.lit(0.018) * (gclk - 900)
        + F.lit(0.008) * (mclk - 3200)
        + F.lit(0.75) * F.greatest(temp - 45, F.lit(0.0))
        + F.lit(0.0025) * gpu * mem
    )


def analytic_power_of_row(prefix: str = "") -> Column:
    """:func:`analytic_power` over the normalised column names."""
    names = (
        "gpu_utilization_pct",
        "memory_utilization_pct",
        "graphics_clock_mhz",
        "memory_clock_mhz",
        "temperature_c",
    )
    return analytic_power(*[F.col(prefix + n) for n in names])


def regime_signal(index: Column) -> Column:
    """Slow sine plus an 8 W step in the first 400 of every 2000 positions."""
    step = F.when(index % 2000 < 400, F.lit(8.0)).otherwise(F.lit(0.0))
    return F.sin(index / 900.0) * 6 + step


def lookup(key: Column, table: Mapping[str, float]) -> Column:
    """Value of ``key`` in a small fixed table; unknown keys give null."""
    pairs = [F.lit(x) for k, v in table.items() for x in (k, float(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def trace_label(source: str) -> Column:
    """Workload label of rows that come from a wide accelerator trace."""
    return F.lit(f"{source}_gpu_trace")


def session_of(job: Column | None, node: Column | None, stem: str, gpu: Column | None) -> Column:
    """Session id: job, else node, else file stem, then the device id.

    A missing job or node id gives ``unknown`` rather than the text of a null.
    """
    source = job if job is not None else node
    base = F.lit(stem) if source is None else F.coalesce(source.cast("string"), F.lit("unknown"))
    if gpu is None:
        return base
    return F.concat(base, F.lit("_gpu_"), F.coalesce(gpu.cast("string"), F.lit("unknown")))
