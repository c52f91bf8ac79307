"""Wattline: power-telemetry analytics as plain Spark DataFrame jobs.

The library turns raw accelerator and server telemetry into one time-series
schema, guards it against unit errors and target leakage, splits it without
leaking sessions, fits MLlib regressors, keeps versioned models, scores batches
and streams, and reports input drift.
"""

__version__ = "0.1.0"
