"""Window functions by specification: row_number(), lag(col, n, default), running_sum(col), moving_avg(col, n) and so on."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import quoted
from .ordering import sort_columns

SPEC = re.compile(r"^\s*(?:(?P<alias>\w+)\s*=\s*)?(?P<fn>\w+)\s*\((?P<args>.*)\)\s*$")


def _default(text: str | None) -> object:
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def window_column(df: DataFrame, fn: str, args: list[str], w, zero: bool = True) -> Column:
    """``zero``: non-numeric values count as 0 in running and moving figures other than minima and maxima."""
    if fn in ("row_number", "rank", "dense_rank"):
        return getattr(F, fn)().over(w)
    if fn == "running_count":
        return F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not args or args[0] not in df.columns:
        raise ArgumentError(f"{fn} needs a column")
    c = quoted(args[0])
    if fn in ("lag", "lead"):
        n = max(1, int(args[1])) if len(args) > 1 else 1
        return getattr(F, fn)(c, n, _default(args[2]) if len(args) > 2 else None).over(w)
    kind, _, what = fn.partition("_")
    if kind not in ("running", "moving") or what not in ("sum", "avg", "min", "max"):
        raise ArgumentError(f"unknown window function {fn!r}")
    n = co.num(c, co.kind_of(df.schema[args[0]].dataType))
    if what in ("sum", "avg") and zero:
        n = F.coalesce(n, F.lit(0.0))
    size = int(args[1]) if len(args) > 1 else 5
    return getattr(F, what)(n).over(w.rowsBetween(Window.unboundedPreceding if kind == "running" else 1 - size, 0))


def window(df: DataFrame, specs: Mapping[str, str] | Iterable[str], by: Iterable[str] = (), order_by: str | Iterable[str] | None = None, zero: bool = True) -> DataFrame:
    """Add window columns. Without ``order_by`` the rows' arrival order in their partitions is used, which holds only straight after a read."""
    items = [(k, v) for k, v in specs.items()] if isinstance(specs, Mapping) else [(None, s) for s in specs]
    by = [by] if isinstance(by, str) else list(by)
    out = df
    if order_by is None:
        out = df.withColumn("_arrival", F.monotonically_increasing_id())
        order = [F.col("_arrival")]
    else:
        order = sort_columns(df, order_by)
    w = Window.partitionBy(*(quoted(c) for c in by)).orderBy(*order)
    made = {}
    for name, spec in items:
        m = SPEC.match(spec)
        if not m:
            raise ArgumentError(f"not a window function: {spec!r}")
        args = [a.strip() for a in m["args"].split(",")] if m["args"].strip() else []
        made[name or m["alias"] or "_".join([m["fn"], *args[:1]])] = window_column(df, m["fn"], args, w, zero)
    return out.withColumns(made).drop("_arrival")
