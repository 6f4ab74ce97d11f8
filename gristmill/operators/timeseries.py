"""Resampling to time buckets, with gaps filled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import compile_value, quoted
from .aggregate import aggregate

UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800, "mo": "month", "month": "month", "y": "year", "year": "year"}


def parse_interval(text: str) -> tuple[int, str]:
    """"15m" -> (15, seconds as "900 seconds" scaled later); (n, "second"), (n, "month") or (n, "year")."""
    m = re.fullmatch(r"\s*(\d*)\s*([a-z]+?)s?\s*", text.lower()) if text.lower() != "s" else re.fullmatch(r"(\d*)(s)", "s")
    if re.fullmatch(r"\s*\d*\s*s\s*", text.lower()):
        m = re.fullmatch(r"\s*(\d*)\s*(s)\s*", text.lower())
    if not m or m[2] not in UNITS:
        raise ArgumentError(f"not an interval: {text!r}")
    n, unit = int(m[1] or 1), UNITS[m[2]]
    return (n, unit) if isinstance(unit, str) else (n * unit, "second")


def bucket(ts: Column, interval: str) -> Column:
    """The start of a timestamp's bucket: aligned with the epoch, or with the calendar for months and years."""
    n, unit = parse_interval(interval)
    if unit == "second":
        return F.timestamp_seconds(F.floor(F.unix_millis(ts) / (1000 * n)) * n)
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    step = n * (12 if unit == "year" else 1)
    start = F.floor(months / step) * step
    return F.add_months(F.lit("1970-01-01").cast("date"), start.cast("int")).cast("timestamp")


def _step(interval: str) -> Column:
    n, unit = parse_interval(interval)
    return F.expr({"second": f"make_dt_interval(0, 0, 0, {n})", "month": f"make_ym_interval(0, {n})", "year": f"make_ym_interval({n}, 0)"}[unit])


def parse_specs(specs: str | list[str]) -> list[tuple[str, str, str]]:
    """"avg(cpu) as x, mem" -> [(alias, function, column)]; a bare column is an average."""
    out = []
    for item in specs.split(",") if isinstance(specs, str) else specs:
        m = re.fullmatch(r"\s*(?:(\w+)\s*\(\s*([^)]*?)\s*\)|([^()\s]+))(?:\s+as\s+(\w+))?\s*", item, re.I)
        if not m:
            raise ArgumentError(f"not an aggregate: {item!r}")
        fn, col = (m[1].lower(), m[2]) if m[1] else ("avg", m[3])
        col = "" if col == "*" else col
        out.append((m[4] or (f"{fn}_{col}" if col else fn), fn, col))
    return out


def resample(df: DataFrame, time: str, interval: str, aggs: str | list[str] = "count(*)", fill: str | None = None, order_by: str | None = None, output: str = "timestamp") -> DataFrame:
    """Time buckets with aggregates, ascending. ``fill``: zero, null, ffill, bfill or linear for buckets without rows. ``output``: timestamp, iso, epoch_ms, epoch_s or date_only."""
    ts = co.event_time(quoted(time), co.kind_of(df.schema[time].dataType))
    rows = df.withColumn("_bucket", bucket(ts, interval)).filter(F.col("_bucket").isNotNull())
    order = F.struct(*(quoted(c) for c in order_by.split(","))) if order_by else F.struct(ts)
    specs = parse_specs(aggs)
    made = []
    for alias, fn, col in specs:
        if fn in ("first", "last"):
            made.append((F.max_by if fn == "last" else F.min_by)(quoted(col), order).alias(alias))
        else:
            made.append(aggregate(fn, compile_value(f"`{col}`", df.schema) if col else None).alias(alias))
    out = rows.groupBy("_bucket").agg(*made)
    if fill:
        out = fill_gaps(out, "_bucket", interval, [s[0] for s in specs], fill)
    shown = {"timestamp": F.col("_bucket"), "iso": F.date_format("_bucket", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "epoch_ms": F.unix_millis("_bucket"), "epoch_s": F.unix_seconds("_bucket"), "date_only": F.date_format("_bucket", "yyyy-MM-dd")}
    if output not in shown:
        raise ArgumentError(f"unknown output {output!r}")
    return out.orderBy("_bucket").select(shown[output].alias(time), *(s[0] for s in specs)) if not df.isStreaming else out.select(shown[output].alias(time), *(s[0] for s in specs))


def fill_gaps(df: DataFrame, time: str, interval: str, columns: list[str], how: str) -> DataFrame:
    """A row for every bucket between the first and the last. Runs on aggregated rows, one per bucket."""
    if how not in ("zero", "null", "ffill", "bfill", "linear"):
        raise ArgumentError(f"unknown fill {how!r}")
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).filter("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b", _step(interval))).alias(time))
    out = spine.join(df.withColumn("_there", F.lit(True)), time, "left")
    if how == "null":
        return out.drop("_there")
    if how == "zero":
        return out.fillna(0, columns).drop("_there")
    back = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    made = {}
    for c in columns:
        before, after = F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)
        if how == "linear":
            at = F.unix_millis(time)
            known = F.when(F.col(c).isNotNull(), at)
            a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
            made[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(before + (after - before) * (at - a) / (b - a))
        else:
            made[c] = F.coalesce(F.col(c), before if how == "ffill" else after)
    return out.withColumns(made).drop("_there")
