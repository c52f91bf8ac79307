"""Global order at scale: cut points, first-k flags and row positions.

Every order is made total: ties on the given columns are broken by all other
columns, ascending with nulls last. Nothing here puts the rows into one
partition. A cut is found by narrowing (see ``selection``) and then applied as a
row-local comparison, so splitting a table costs no shuffle of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.coerce import epoch_micros
from wattline.operators.selection import BINS, ROW_BOUND, Slot, bin_number, bin_width
from wattline.session import size_known, sort_partitions, spool

_CHUNK = 7  # bytes of a string that fit a non-negative BIGINT


def total_order(df: DataFrame, order: Sequence[str]) -> list[str]:
    """``order`` followed by every other column."""
    return list(order) + [c for c in df.columns if c not in order]


def _literal(value: Any, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.lit(str(value)).cast(kind)
    return F.lit(value).cast(kind)


@dataclass(frozen=True)
class Cut:
    """The last row of "the first k rows".

    ``copies`` rows equal this one and ``inside`` of them belong to the first k.
    """

    schema: T.StructType
    order: tuple[str, ...]
    values: dict[str, Any]
    inside: int
    copies: int

    def _lit(self, name: str) -> Column:
        return _literal(self.values[name], self.schema[name].dataType)

    def at(self) -> Column:
        """Row equals the cut row."""
        out = F.lit(True)
        for c in self.order:
            out = out & F.col(f"`{c}`").eqNullSafe(self._lit(c))
        return out

    def ahead(self) -> Column:
        """Row sorts strictly before the cut row."""
        out = F.lit(False)
        for c in reversed(self.order):
            col = F.col(f"`{c}`")
            if self.values[c] is None:
                less, same = col.isNotNull(), col.isNull()
            else:
                less, same = F.coalesce(col < self._lit(c), F.lit(False)), col.eqNullSafe(self._lit(c))
            out = less | (same & out)
        return out


def _integer_keys(df: DataFrame, name: str) -> Iterator[tuple[Column, bool]]:
    """Order-preserving numeric keys of a column; the flag asks to stop at short strings."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        yield c.cast("bigint"), False
    elif isinstance(kind, T.BooleanType):
        yield c.cast("int").cast("bigint"), False
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # infinities and NaN, which sorts last, would stretch the bins: they are told apart first
        d = c.cast("double")
        endless = F.abs(d) == F.lit(float("inf"))
        rank = F.when(F.isnan(d), 2).when(endless & (d > 0), 1).when(endless, -1).otherwise(0)
        yield F.when(d.isNotNull(), rank).cast("bigint"), False
        yield F.when(d.isNotNull(), F.when(F.isnan(d) | endless, 0.0).otherwise(d)), False
    elif isinstance(kind, T.DecimalType) and kind.scale <= 18:
        whole = F.floor(c).cast("decimal(38,0)")
        high = F.floor(whole / F.lit(10**18).cast("decimal(19,0)")).cast("bigint")
        yield high, False
        yield (whole - high.cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)")).cast("bigint"), False
        if kind.scale:
            yield ((c - F.floor(c)).cast(T.DecimalType(19, kind.scale)) * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("bigint"), False
    elif isinstance(kind, T.DateType):
        yield F.unix_date(c).cast("bigint"), False
    elif isinstance(kind, T.TimestampNTZType):
        yield epoch_micros(c), False
    elif isinstance(kind, T.TimestampType):
        yield F.unix_micros(c), False
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        start = 1
        while True:
            part = F.hex(F.substring(c.cast("binary"), start, _CHUNK))
            yield F.conv(F.rpad(part, 2 * _CHUNK, "0"), 16, 10).cast("bigint"), True
            start += _CHUNK
    else:
        raise TypeError(f"Column '{name}' of type {kind.simpleString()} cannot be ordered; flatten it first.")


@dataclass(frozen=True)
class _Candidates:
    """Rows that may hold the wanted rank; ``depth`` columns were used to find them."""

    rows: DataFrame
    rank: int
    size: int
    depth: int


def _within(key: Column, slot: Slot, kind: T.DataType, extent: tuple[int, int] | None) -> Column:
    """Whether a key lies in a slot. Inside a known ``extent`` doubling can't overflow, and the key stands there
    once: two comparisons would hash a row twice, as the optimizer puts the key's expression into both."""
    if extent is not None and max(map(abs, extent)) < 1 << 61:
        return F.abs(key * F.lit(2) - F.lit(slot.low + slot.high)) <= F.lit(slot.high - slot.low)
    return key.between(_literal(slot.low, kind), _literal(slot.high, kind))


def _shrink(keyed: DataFrame, whole: Slot, rank: int, row_bound: int, extent: tuple[int, int] | None = None) -> Slot:
    """Histogram passes over ``__key`` until the slot that holds ``rank`` is small or one value."""
    kind = keyed.schema["__key"].dataType
    key, slot = F.col("__key"), whole
    while slot.size > row_bound and not slot.single:
        low = _literal(slot.low, kind)
        if isinstance(kind, T.DoubleType):
            piece = bin_number(key, low, F.lit(bin_width(slot.low, slot.high)))
        else:
            width = (slot.high - slot.low) // BINS + 1
            piece = F.expr(f"(__key - ({slot.low}L)) div {width}L")
        start = slot
        rows = keyed if slot == whole else keyed.where(_within(key, slot, kind, extent))
        before = slot.before
        pieces = rows.groupBy(piece.alias("piece")).agg(
            F.count("__key").alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi")
        )
        for p in sorted((p for p in pieces.collect() if p["n"]), key=lambda p: p["piece"]):
            if rank < before + p["n"]:
                slot = Slot("key", p["lo"], p["hi"], before, p["n"])
                break
            before += p["n"]
        if slot.size == start.size and (slot.low, slot.high) == (start.low, start.high):
            raise ArithmeticError(f"A narrowing pass left {slot.size} rows in one bin.")
    return slot


def _narrow(
    df: DataFrame, order: Sequence[str], rank: int, size: int, row_bound: int, extent: tuple[int, int] | None
) -> _Candidates:
    rows = df
    for depth, name in enumerate(order):
        for step, (key, is_text) in enumerate(_integer_keys(df, name)):
            if size <= row_bound:
                return _Candidates(rows, rank, size, depth if step == 0 else depth + 1)
            keyed = rows.withColumn("__key", key)
            known = extent if depth == 0 else None
            if known:
                whole, filled, octets = Slot("key", *known, 0, size), size, 0
            else:
                span = keyed.agg(
                    F.count("__key").alias("filled"),
                    F.min("__key").alias("low"),
                    F.max("__key").alias("high"),
                    (F.max(F.octet_length(F.col(f"`{name}`"))) if is_text else F.lit(0)).alias("octets"),
                ).first()
                filled, octets = span["filled"], span["octets"]
                whole = Slot("key", span["low"], span["high"], 0, filled)
            if rank >= filled:  # nulls come last
                rows, rank, size = rows.where(key.isNull()), rank - filled, size - filled
                break
            slot = _shrink(keyed, whole, rank, row_bound, known)
            kind = keyed.schema["__key"].dataType
            rows = rows.where(_within(key, slot, kind, known))
            rank, size = rank - slot.before, slot.size
            if not slot.single:
                return _Candidates(rows, rank, size, depth + 1)
            if is_text and octets <= (step + 1) * _CHUNK:
                break
    return _Candidates(rows, rank, size, len(order))


def cut_point(
    df: DataFrame,
    order: Sequence[str],
    k: int,
    n: int,
    row_bound: int = ROW_BOUND,
    extent: tuple[int, int] | None = None,
) -> Cut:
    """The k-th row (1-based) of the ``n`` rows of ``df`` in the total order that starts with ``order``.

    ``extent`` is the known (lowest, highest) value of the first column when that
    column has no nulls, and saves the pass that would find it.
    """
    columns = total_order(df, order)
    left = _narrow(df, columns, k - 1, n, row_bound, extent)
    if left.size > row_bound:  # every column was narrowed to one value: all candidates are copies
        return Cut(df.schema, tuple(columns), left.rows.first().asDict(), left.rank + 1, left.size)
    # A counted set of at most row_bound rows: one sort of it is safe.
    w = Window.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in columns])
    peers = w.rangeBetween(Window.currentRow, Window.currentRow)
    row = (
        left.rows.withColumn("__rn", F.row_number().over(w))
        .withColumn("__rank", F.rank().over(w))
        .withColumn("__copies", F.count(F.lit(1)).over(peers))
        .withColumn("__lead", F.count(F.lit(1)).over(Window.partitionBy(F.col(f"`{columns[0]}`"))))
        .where(F.col("__rn") == left.rank + 1)
        .first()
    )
    # If only the first column was used to narrow and no other row shares its
    # value, that column alone decides.
    alone = left.depth <= 1 and row["__lead"] == 1
    values = {c: row[c] for c in columns}
    decisive = tuple(columns[:1] if alone else columns)
    return Cut(df.schema, decisive, values, row["__rn"] - row["__rank"] + 1, row["__copies"])


def flag_first(
    df: DataFrame,
    order: Sequence[str],
    k: int,
    name: str,
    n: int | None = None,
    row_bound: int = ROW_BOUND,
    extent: tuple[int, int] | None = None,
) -> DataFrame:
    """Add a boolean that is true for exactly the first ``k`` rows of the order."""
    n = df.count() if n is None else n
    if k <= 0 or k >= n:
        return df.withColumn(name, F.lit(k >= n and n > 0))
    cut = cut_point(df, order, k, n, row_bound, extent)
    if cut.inside == cut.copies:
        return df.withColumn(name, cut.ahead() | cut.at())
    # The cut falls between copies of one row. Copies are interchangeable, so they
    # are counted, left out, and written back by a distributed range.
    rest = df.where(~cut.at()).withColumn(name, cut.ahead())
    copies = df.sparkSession.range(cut.copies).select(
        *[cut._lit(c).alias(c) for c in df.columns], (F.col("id") < cut.inside).alias(name)
    )
    return rest.unionByName(copies)


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Exactly the first ``k`` rows of the order, left distributed."""
    return flag_first(df, order, k, "__first").where("__first").drop("__first")


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Add the 0-based global position of each row.

    Rows are range-partitioned and sorted on the full order, stored once, and the
    position inside a partition gets that partition's offset. The source partition
    id is the last sort key: it spreads a hot group of identical rows over many
    ranges, and a re-run of a lost task gives it the same value. A table whose size is
    not known before it is computed, such as a join, is stored first and its files
    tell the number of ranges.
    """
    spark = df.sparkSession
    tagged = df.withColumn("__src", F.spark_partition_id())
    if not size_known(df):
        tagged = spool(tagged, "unsorted")
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in total_order(df, order)] + [F.col("__src").asc()]
    placed = (
        tagged.repartitionByRange(sort_partitions(tagged), *keys)
        .sortWithinPartitions(*keys)
        .drop("__src")
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    stored = spool(placed, "order").withColumn("__part", F.shiftright("__pos", 33))
    counts = {r["__part"]: r["n"] for r in stored.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):  # one entry per shuffle partition
        offsets.append((part, total))
        total += counts[part]
    table = spark.createDataFrame(offsets, "__part bigint, __offset bigint")
    local = F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.join(F.broadcast(table), "__part")
        .withColumn(name, F.col("__offset") + local)
        .drop("__part", "__pos", "__offset")
    )


def session_blocks(df: DataFrame, order: Sequence[str], blocks: int = 6, least: int = 100) -> DataFrame:
    """Label consecutive blocks of the ordered rows ``synthetic_session_<k>``.

    Block length is ``max(least, rows // blocks)``.
    """
    indexed = row_index(df, order, "__idx")
    span = max(least, indexed.count() // blocks)
    block = F.floor(F.col("__idx") / span).cast("string")
    return indexed.withColumn("session_id", F.concat(F.lit("synthetic_session_"), block)).drop("__idx")
