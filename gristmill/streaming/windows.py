"""Time windows on streams: tumbling, sliding and session, with watermarks. The row operators take streaming DataFrames as they are."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expression import compile_value, quoted
from ..operators.aggregate import aggregate, parse_specs


def windowed(df: DataFrame, time: str, size: str, specs: str | Iterable[str], slide: str | None = None, session: bool = False, late: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """Aggregates by time window (and ``by``); ``late`` is how long the state waits for late rows."""
    rows = df.withColumn(time, quoted(time).cast("timestamp"))
    if late:
        rows = rows.withWatermark(time, late)
    w = F.session_window(quoted(time), size) if session else F.window(quoted(time), size, slide)
    made = [aggregate(fn, compile_value(arg, rows.schema) if arg else None, exact=not df.isStreaming).alias(alias) for alias, fn, arg in parse_specs(specs)]
    out = rows.groupBy(w.alias("w"), *(quoted(c) for c in by)).agg(*made)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in out.columns if c != "w"))


def distinct_stream(df: DataFrame, keys: Iterable[str], time: str, late: str) -> DataFrame:
    """The first row of each key among rows not later than ``late`` after it."""
    return df.withColumn(time, quoted(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
