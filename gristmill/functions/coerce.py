"""The coercions that operators share, as columns.

Values of a text file are strings until something needs a number, a date or a
truth value. Each rule is stated once here; all of them are built-in
expressions and none raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
PLAIN = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, NUMERIC):
        return "num"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(t, T.NullType):
        return "null"
    return "any"


def blank_to_null(c: Column, kind: str) -> Column:
    return F.when(c != "", c) if kind == "str" else c


def is_blank(c: Column, kind: str) -> Column:
    return c.isNull() | (c == "") if kind == "str" else c.isNull()


def num(c: Column, kind: str) -> Column:
    """The value as a double, null where it is none; blank is null."""
    if kind == "num":
        return c.cast("double")
    if kind == "bool":
        return c.cast("int").cast("double")
    if kind == "time":
        return F.unix_millis(c.cast("timestamp")).cast("double")
    if kind == "str":
        return F.when(c.rlike(PLAIN), F.trim(F.regexp_replace(c, r"\s", "")).try_cast("double"))
    return F.lit(None).cast("double")


def parse_float(c: Column, kind: str) -> Column:
    """The longest numeric prefix of a string."""
    return F.regexp_extract(c, PREFIX, 1).try_cast("double") if kind == "str" else num(c, kind)


def text(c: Column, kind: str) -> Column:
    """The value as a string, null where it is null; whole doubles have no fraction."""
    if kind == "num":
        return F.regexp_replace(c.cast("string"), r"\.0$", "")
    if kind == "any":
        return F.to_json(c)
    return c.cast("string")


def truthy(c: Column, kind: str) -> Column:
    if kind == "bool":
        return F.coalesce(c, F.lit(False))
    if kind == "num":
        return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))
    if kind == "str":
        return F.coalesce(c != "", F.lit(False))
    return c.isNotNull()


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + 0.5) / scale


def to_time(c: Column, kind: str) -> Column:
    """A timestamp, null where the value is none; strings as ISO, with slashes, or month first; numbers in milliseconds."""
    if kind == "time":
        return c.cast("timestamp")
    if kind == "num":
        return F.timestamp_millis(c.cast("long"))
    if kind == "str":
        s = F.trim(c)
        return F.coalesce(s.try_cast("timestamp"), F.try_to_timestamp(s, F.lit("yyyy/MM/dd")), F.try_to_timestamp(s, F.lit("MM/dd/yyyy")), F.try_to_timestamp(s, F.lit("yyyy/MM/dd HH:mm:ss")))
    return F.lit(None).cast("timestamp")


def event_time(c: Column, kind: str) -> Column:
    """Like to_time, but numbers under 1e11 are seconds."""
    if kind == "num":
        return F.when(F.abs(c) < 1e11, F.timestamp_millis((c * 1000).cast("long"))).otherwise(F.timestamp_millis(c.cast("long")))
    return to_time(c, kind)
