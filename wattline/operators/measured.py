"""What the measured rows say themselves: clamped readings, activity blocks, regimes, base loads, calibration.

Everything is summed up before it is shuffled. Windows run over one row per trace and day, so a
trace that holds a third of all rows costs its days and not its rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.contract import SESSION, TARGET, TIMESTAMP
from wattline.functions.coerce import numeric
from wattline.functions.scalars import CLAMP_LIMITS, analytic_power_of_row, clamp

GAP_DAYS = 7
ROLLING_DAYS = 30
STEP_WATTS = 8.0


def clamped_readings(df: DataFrame, by: str = SESSION, limits: Mapping[str, tuple[float, float]] = CLAMP_LIMITS) -> DataFrame:
    """(``by``, feature, rows, below, above, clamped_total): what the physical limits change in each group.

    ``rows`` counts the readings that are numbers and ``clamped_total`` adds them up after the
    clamp; it is null without any. Columns that ``df`` lacks are left out.
    """
    parts, out = [], []
    for i, (c, (low, high)) in enumerate((c, x) for c, x in limits.items() if c in df.columns):
        x = numeric(df, c)
        parts += [
            F.count(x).alias(f"n{i}"), F.count_if(x < low).alias(f"b{i}"), F.count_if(x > high).alias(f"a{i}"),
            F.sum(clamp(x, low, high)).alias(f"t{i}"),
        ]
        values = {"rows": f"n{i}", "below": f"b{i}", "above": f"a{i}", "clamped_total": f"t{i}"}
        out.append(F.struct(F.lit(c).alias("feature"), *[F.col(v).alias(k) for k, v in values.items()]))
    if not out:
        raise ValueError("No column has a physical limit.")
    return df.groupBy(by).agg(*parts).select(by, F.explode(F.array(*out)).alias("r")).select(by, "r.*")


def _day(df: DataFrame, time: str) -> Column:
    return F.unix_date(F.col(f"`{time}`").cast("date"))


def activity_blocks(df: DataFrame, trace: str = SESSION, time: str = TIMESTAMP, gap_days: int = GAP_DAYS, name: str = "block") -> DataFrame:
    """``df`` with the number, from 0, of the stretch of activity that each row belongs to.

    A stretch of a trace ends where ``gap_days`` days or more have no row before the next one.
    Rows without a trace or a time are in no stretch.
    """
    rows = df.withColumn("__day", _day(df, time))
    days = rows.select(trace, "__day").where(F.col(trace).isNotNull() & F.col("__day").isNotNull()).distinct()
    order = Window.partitionBy(trace).orderBy("__day")
    new = F.col("__day") - F.lag("__day").over(order) > gap_days
    blocks = days.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int"))
    blocks = blocks.select(trace, "__day", F.sum("__new").over(order).alias(name))
    return rows.join(blocks, [trace, "__day"], "left").select(*df.columns, name)


def daily_regimes(
    df: DataFrame, trace: str = SESSION, time: str = TIMESTAMP, value: str = TARGET, days: int = ROLLING_DAYS, step: float = STEP_WATTS
) -> DataFrame:
    """(``trace``, day, rows, mean, rolling, regime): each day's mean beside that of the ``days`` days before it.

    ``regime`` is ``up`` or ``down`` where the two differ by more than ``step``, else ``level``;
    ``start`` without an earlier day. Rows without a time or a number are left out; a null
    trace is a trace of its own.
    """
    x = numeric(df, value)
    daily = df.select(trace, _day(df, time).alias("__day"), x.alias("__x")).where("__day is not null and __x is not null")
    daily = daily.groupBy(trace, "__day").agg(F.count("__x").alias("rows"), F.sum("__x").alias("__sum"))
    before = Window.partitionBy(trace).orderBy("__day").rangeBetween(-days, -1)
    daily = daily.withColumns({"mean": F.col("__sum") / F.col("rows"), "rolling": F.sum("__sum").over(before) / F.sum("rows").over(before)})
    change = F.col("mean") - F.col("rolling")
    regime = F.when(change > step, "up").when(change < -step, "down").when(change.isNull(), "start").otherwise("level")
    return daily.select(trace, F.date_from_unix_date("__day").alias("day"), "rows", "mean", "rolling", regime.alias("regime"))


def _with_group(df: DataFrame, table: DataFrame, by: str) -> DataFrame:
    """``df`` with the columns of ``table``, a row per value of ``by`` (null included)."""
    side = table.withColumnRenamed(by, "__by")
    return df.join(side, F.col(f"`{by}`").eqNullSafe(F.col("__by")), "left").drop("__by")


def with_base_loads(df: DataFrame, columns: Mapping[str, str], by: str = "workload_type") -> DataFrame:
    """``df`` with the mean of each column over its rows of one ``by``; ``columns`` maps new names to columns."""
    bases = df.groupBy(by).agg(*[F.avg(numeric(df, c)).alias(name) for name, c in columns.items()])
    return _with_group(df, bases, by)


def with_calibrated_power(df: DataFrame, by: str = "workload_type", name: str = "calibrated_power") -> DataFrame:
    """``df`` with the closed-form power and the mean error that it has on the rows of one ``by``.

    A group without a target or with an input missing everywhere has no error and gets null.
    """
    model = analytic_power_of_row()
    bias = df.groupBy(by).agg(F.avg(numeric(df, TARGET) - model).alias("power_bias"))
    return _with_group(df, bias, by).withColumn(name, model + F.col("power_bias"))
