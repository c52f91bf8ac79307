"""Column expressions that turn raw text into clean values; null means missing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts a monitor tool prints for "no reading".
MISSING_TOKENS = ("", "[Not Supported]", "N/A", "Not Supported")

_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
# numbers that are finite by their look: no exponent, no more than 300 digits before the point
_FINITE = r"^[+-]?(?:\d{1,300}(?:\.\d*)?|\.\d+)$"
HASH_EXTENT = (0, 2**60 - 1)
_OFFSET = r":\d{2}(?:[.]\d+)?([+-])(\d{2}):?(\d{2})$"
_OFFSET_END = r"[+-]\d{2}:?\d{2}$"
EPOCH_PER_SECOND = 1  # times given as numbers count seconds


def safe_number(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def to_number(c: Column) -> Column:
    """Parse text as a double; anything that is not a plain number is null.

    The pattern comes first because Spark also accepts typed suffixes such as
    ``1d``, which are not numbers in a telemetry file. Most texts can't stand for an
    infinity; those are matched and parsed once, without the check that does so again.
    """
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    return F.when(text.rlike(_FINITE), number).otherwise(safe_number(F.when(text.rlike(_NUMBER), number)))


def numeric(df: DataFrame, name: str) -> Column:
    """Numeric reading of a column: parsed when text, cleaned when a number."""
    c = F.col(f"`{name}`")
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return safe_number(c)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return to_number(c)
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    return F.lit(None).cast("double")


def reading(c: Column, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    """Number printed by a monitor tool; its "no reading" texts become null."""
    text = F.trim(c.cast("string"))
    return F.when(text.isin(list(tokens)), None).otherwise(to_number(text))


def from_epoch(c: Column, per_second: int = EPOCH_PER_SECOND) -> Column:
    """Zone-less timestamp of a number of units since 1970; null beyond the years of a timestamp."""
    seconds = safe_number(c) / per_second
    seconds = F.when(F.abs(seconds) < F.lit(2.0e11), seconds)
    days = F.floor(seconds / 86400)
    rest = (seconds - days * 86400).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"), zero, zero, rest)


def to_time(c: Column, formats: Sequence[str] = ()) -> Column:
    """Parse text as a zone-less timestamp; unparsable is null.

    ISO forms and ``yyyy/MM/dd ...`` need no format. A numeric offset is
    converted to UTC, a trailing ``Z`` is taken as is, a plain number counts seconds
    since 1970. Every value is parsed on its own, so files that mix formats keep all
    their rows.
    """
    text = F.trim(c.cast("string"))
    dashed = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    iso = F.when(F.contains(text, F.lit("/")), dashed).otherwise(text)
    # The offset is cut off and subtracted, so the session's zone plays no part.
    sign, hours, minutes = (F.regexp_extract(iso, _OFFSET, i) for i in (1, 2, 3))
    away = F.make_dt_interval(F.lit(0), hours.try_cast("int"), minutes.try_cast("int"))
    local = F.regexp_replace(iso, _OFFSET_END, "").try_cast("timestamp_ntz")
    shifted = F.when(sign == "-", local + away).otherwise(local - away)
    # the pattern is looked for only where a sign follows a colon
    clock = text.substr(F.instr(text, ":"), F.length(text))
    signed = F.contains(clock, F.lit("+")) | F.contains(clock, F.lit("-"))
    plain = F.when(signed & iso.rlike(_OFFSET), shifted).otherwise(iso.try_cast("timestamp_ntz"))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries, plain, from_epoch(to_number(text)))


def as_time(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """Zone-less timestamp of a column that may already be a time."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        return from_epoch(c.cast("double"))
    return to_time(c, formats)


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the zone."""
    seconds = F.unix_date(c.cast("date")).cast("bigint") * F.lit(86400).cast("bigint") + (
        F.hour(c) * 3600 + F.minute(c) * 60
    ).cast("bigint")
    micros = (F.date_part(F.lit("SECOND"), c) * F.lit(1000000)).cast("bigint")
    return seconds * F.lit(1000000).cast("bigint") + micros


def clean_text(c: Column) -> Column:
    """Snake-case form of a header held in a column."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^0-9a-zA-Z]+", "_"), F.lit("_"))


def clean_name(name: str) -> str:
    """Snake-case form of one header."""
    return re.sub("[^0-9a-zA-Z]+", "_", str(name).strip().lower()).strip("_")


def with_clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; two headers that collide are an error."""
    names = [clean_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"Headers collide after cleaning: {clash}")
    return df.toDF(*names)


def hash60(seed: int | str, *keys: Column) -> Column:
    """Uniform 60-bit integer from a seed and key columns (first 15 hex digits of MD5)."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
