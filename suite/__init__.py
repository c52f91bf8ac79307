"""Registered queries over the driver tables and the DuckDB statements they must match."""


def load_all() -> None:
    """Import every module that registers queries."""
    from suite import checks, measured, models, sources, splits, statistics, streams, transforms  # noqa: F401
