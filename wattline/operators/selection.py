"""Exact order statistics without a global sort.

Values are narrowed by histogram passes. Each pass is one partial/final hash
aggregate that counts rows in at most ``BINS`` equal slices of the interval that
still holds the wanted rank, and keeps each slice's own smallest and largest
value as the next interval. Narrowing stops once the interval holds at most
``row_bound`` rows or a single value, so the last sort is over a proven small
set however large the input or however many rows share one value.

The input is always in long form: ``series STRING, v DOUBLE|BIGINT``, v not null.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.coerce import numeric
from wattline.operators.wide import unpivoted

BINS = 2048
ROW_BOUND = 100_000


@dataclass(frozen=True)
class Slot:
    """Closed interval of one series: ``before`` rows sort ahead of it, ``size`` lie in it."""

    series: str
    low: float | int
    high: float | int
    before: int
    size: int

    @property
    def single(self) -> bool:
        return self.low == self.high


def long_form(df: DataFrame, columns: Sequence[str], group: Column | None = None) -> DataFrame:
    """Unpivot numeric columns; ``group`` prefixes the series name with ``group|``."""
    return unpivoted(df, columns, numeric, ("series", "v"), group)


def extents(long: DataFrame) -> dict[str, Slot]:
    """Whole interval of every series, in one pass."""
    rows = long.groupBy("series").agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    return {r["series"]: Slot(r["series"], r["low"], r["high"], 0, r["n"]) for r in rows.collect()}


def bin_width(low: float, high: float) -> float:
    """Width of one of BINS bins; the ends are divided first, so it can't overflow."""
    return high / BINS - low / BINS or high - low or 1.0


def bin_number(value: Column, low: Column, width: Column) -> Column:
    """Bin of a double; where the distance to ``low`` overflows both are divided first."""
    near = (value - low) / width
    far = value / width - low / width
    return F.least(F.floor(F.when(F.abs(value - low) < F.lit(float("inf")), near).otherwise(far)), F.lit(BINS))


def _slot_table(long: DataFrame, slots: Sequence[Slot], ranks: Sequence[Sequence[int]]) -> DataFrame:
    value = long.schema["v"].dataType
    whole = not isinstance(value, T.DoubleType)
    schema = T.StructType(
        [
            T.StructField("slot", T.IntegerType()),
            T.StructField("series", T.StringType()),
            T.StructField("low", value),
            T.StructField("high", value),
            T.StructField("width", value),
            T.StructField("before", T.LongType()),
            T.StructField("ranks", T.ArrayType(T.LongType())),
        ]
    )
    rows = []
    for i, s in enumerate(slots):
        width = (s.high - s.low) // BINS + 1 if whole else bin_width(s.low, s.high)
        rows.append((i, s.series, s.low, s.high, width or 1.0, s.before, [int(r) for r in ranks[i]]))
    return long.sparkSession.createDataFrame(rows, schema)


def _in_slots(long: DataFrame, table: DataFrame) -> DataFrame:
    # One row per interval that still matters (series x ranks), so it is always tiny.
    side = F.broadcast(table.withColumnRenamed("series", "s"))
    return long.join(side, (F.col("series") == F.col("s")) & F.col("v").between(F.col("low"), F.col("high")))


def _wanted(start: Column, end: Column) -> Column:
    return F.exists("ranks", lambda r: (r >= start) & (r < end))


def locate(
    long: DataFrame, wanted: Mapping[str, Iterable[int]], whole: Mapping[str, Slot], row_bound: int = ROW_BOUND
) -> dict[tuple[str, int], Slot]:
    """Narrow every (series, 0-based rank) to a slot that is small or a single value."""
    open_: dict[Slot, list[int]] = {}
    for series, ranks in wanted.items():
        open_.setdefault(whole[series], []).extend(sorted(set(ranks)))
    done: dict[tuple[str, int], Slot] = {}
    while open_:
        for slot in [s for s in open_ if s.single or s.size <= row_bound]:
            for r in open_.pop(slot):
                done[(slot.series, r)] = slot
        if not open_:
            break
        slots = list(open_)
        table = _slot_table(long, slots, [open_[s] for s in slots])
        if isinstance(long.schema["v"].dataType, T.DoubleType):
            piece = bin_number(F.col("v"), F.col("low"), F.col("width"))
        else:
            piece = F.expr("(v - low) div width")
        counts = (
            _in_slots(long, table)
            .groupBy("slot", piece.alias("piece"))
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        # At most BINS + 1 rows per slot reach this window.
        running = F.sum("n").over(Window.partitionBy("slot").orderBy("piece"))
        hits = (
            counts.join(F.broadcast(table.select("slot", "before", "ranks")), "slot")
            .withColumn("end", F.col("before") + running)
            .withColumn("start", F.col("end") - F.col("n"))
            .where(_wanted(F.col("start"), F.col("end")))
            .select("slot", "lo", "hi", "start", "n")
            .collect()
        )
        following: dict[Slot, list[int]] = {}
        for h in hits:
            parent = slots[h["slot"]]
            child = Slot(parent.series, h["lo"], h["hi"], h["start"], h["n"])
            if child.size == parent.size and (child.low, child.high) == (parent.low, parent.high):
                raise ArithmeticError(f"A narrowing pass over '{parent.series}' left {child.size} rows in one bin.")
            following[child] = [r for r in open_[parent] if h["start"] <= r < h["start"] + h["n"]]
        open_ = following
    return done


def values_at(
    long: DataFrame, wanted: Mapping[str, Iterable[int]], whole: Mapping[str, Slot], row_bound: int = ROW_BOUND
) -> dict[tuple[str, int], float | int]:
    """Exact value at each (series, 0-based rank)."""
    found = locate(long, wanted, whole, row_bound)
    out = {key: slot.low for key, slot in found.items() if slot.single}
    rest: dict[Slot, list[int]] = {}
    for key, slot in found.items():
        if not slot.single:
            rest.setdefault(slot, []).append(key[1])
    if not rest:
        return out
    slots = list(rest)
    table = _slot_table(long, slots, [rest[s] for s in slots])
    # Each slot holds at most row_bound rows here, so its sorted values are a bounded list.
    sorted_values = _in_slots(long, table).groupBy("slot").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    side = F.broadcast(table.select("slot", "before", "ranks"))
    picked = F.transform("ranks", lambda r: F.get("vs", (r - F.col("before")).cast("int")))
    for h in sorted_values.join(side, "slot").select("slot", "ranks", picked.alias("values")).collect():
        for r, v in zip(h["ranks"], h["values"]):
            out[(slots[h["slot"]].series, r)] = v
    return out


def quantiles(
    long: DataFrame, probs: Sequence[float], row_bound: int = ROW_BOUND
) -> dict[str, dict[float, float]]:
    """Exact quantiles with linear interpolation, per series: ``{series: {p: value}}``."""
    whole = extents(long)
    spots = {s: {p: p * (slot.size - 1) for p in probs} for s, slot in whole.items()}
    wanted = {
        s: {k for h in at.values() for k in (math.floor(h), math.ceil(h))} for s, at in spots.items()
    }
    values = values_at(long, wanted, whole, row_bound)
    out: dict[str, dict[float, float]] = {}
    for s, at in spots.items():
        out[s] = {}
        for p, h in at.items():
            low, high = values[(s, math.floor(h))], values[(s, math.ceil(h))]
            out[s][p] = float(low + (high - low) * (h - math.floor(h)))
    return out


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True
) -> dict[str, dict[float, float]]:
    """Quantiles of numeric columns; an all-null column is absent from the result.

    ``exact=False`` uses one sketch pass instead of the narrowing passes.
    """
    if not columns:
        return {}
    if exact:
        return quantiles(long_form(df, columns), probs)
    points = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(
        *[F.percentile_approx(numeric(df, c), points, 10_000).alias(f"q{i}") for i, c in enumerate(columns)]
    ).first()
    return {
        c: dict(zip(probs, map(float, row[f"q{i}"]))) for i, c in enumerate(columns) if row[f"q{i}"] is not None
    }


def whole_median(df: DataFrame, column: str) -> float | None:
    """Exact median of a whole-number column, by ranks; None without values."""
    v = F.col(f"`{column}`").cast("bigint")
    long = df.select(F.lit(column).alias("series"), v.alias("v")).dropna(subset=["v"])
    return quantiles(long, (0.5,)).get(column, {}).get(0.5)


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float]:
    """Median of every numeric column that has a value."""
    return {c: q[0.5] for c, q in column_quantiles(df, columns, (0.5,), exact).items()}


def weighted_medians(df: DataFrame, columns: Sequence[str], weight: str) -> dict[str, float]:
    """Medians of a counted table of at most some 100,000 rows, each of which stands for ``weight`` rows."""
    if not columns:
        return {}
    cells = [F.struct(F.lit(c).alias("series"), numeric(df, c).alias("v")) for c in columns]
    long = df.select(F.col(weight).alias("n"), F.explode(F.array(*cells)).alias("c")).select("c.*", "n").dropna(subset=["v"])
    per = long.groupBy("series", "v").agg(F.sum("n").alias("n"))
    end = F.sum("n").over(Window.partitionBy("series").orderBy("v"))
    placed = per.withColumn("end", end).withColumn("total", F.sum("n").over(Window.partitionBy("series")))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    has = lambda rank: (rank < F.col("end")) & (rank >= F.col("end") - F.col("n"))
    found = placed.groupBy("series").agg(F.max(F.when(has(low), F.col("v"))).alias("lo"), F.max(F.when(has(high), F.col("v"))).alias("hi"))
    return {r["series"]: r["lo"] + (r["hi"] - r["lo"]) * 0.5 for r in found.collect()}
