"""Reduce, group, count, frequencies, unique, pivot and unpivot."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import Val, compile_value, quoted
from .ordering import parse_keys, sort_columns

SPEC = re.compile(r"^\s*(?:(?P<alias>[^=()]+?)\s*=\s*)?(?P<fn>\w+)\s*\((?P<arg>.*)\)\s*$", re.S)
RSD = 0.0325


def _first(v: Val, order: Column | None, last: bool) -> Column:
    """First or last value that is not blank, in the given order."""
    shown = F.when(~v.blank, v.col)
    if order is None:
        return (F.last if last else F.first)(shown, ignorenulls=True)
    return (F.max_by if last else F.min_by)(v.col, F.when(~v.blank, order))


def aggregate(fn: str, v: Val | None, order: Column | None = None, exact: bool = True) -> Column:
    """One aggregate as a column. Blank and non-numeric values are skipped; ``exact`` is about distinct counts."""
    if fn == "count":
        return F.count(F.lit(1)) if v is None else F.count(F.when(~v.blank, F.lit(1)))
    if v is None:
        raise ArgumentError(f"{fn} needs an argument")
    if fn == "sum":
        return F.coalesce(F.sum(v.num), F.lit(0.0))
    if fn in ("avg", "mean"):
        return F.avg(v.num)
    if fn in ("min", "max"):
        return getattr(F, fn)(v.num)
    if fn in ("countDistinct", "count_distinct", "distinct"):
        shown = F.when(~v.blank, v.col)
        return F.count_distinct(shown) if exact else F.approx_count_distinct(shown, RSD)
    if fn in ("stddev", "variance"):
        made = (F.stddev_samp if fn == "stddev" else F.var_samp)(v.num)
        return F.when(F.count(v.num) == 1, F.lit(0.0)).otherwise(made)
    if fn in ("first", "last"):
        return _first(v, order, fn == "last")
    raise ArgumentError(f"unknown aggregate {fn!r}")


def parse_specs(specs: str | Iterable[str] | Mapping[str, str]) -> list[tuple[str, str, str]]:
    """"total = sum(price), n = count()" -> [(alias, function, argument)]."""
    if isinstance(specs, Mapping):
        items = [f"{k} = {v}" for k, v in specs.items()]
    elif isinstance(specs, str):
        items, depth, at = [], 0, 0
        for i, ch in enumerate(specs + ","):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                items.append(specs[at:i])
                at = i + 1
    else:
        items = list(specs)
    out = []
    for item in items:
        m = SPEC.match(item)
        if not m:
            raise ArgumentError(f"not an aggregate: {item!r}")
        arg = m["arg"].strip()
        alias = m["alias"] or (re.sub(r"\W+", "_", f"{arg}_{m['fn']}") if arg else m["fn"])
        out.append((alias.strip(), m["fn"], arg))
    return out


def group_keys(df: DataFrame, by: Iterable[str]) -> list[Column]:
    """Keys in which blank and null are one group."""
    return [co.blank_to_null(quoted(c), co.kind_of(df.schema[c].dataType)).alias(c) for c in by]


def reduce_rows(df: DataFrame, specs: str | Iterable[str] | Mapping[str, str], by: Iterable[str] = (), order_by: str | None = None, exact: bool = True, custom: Mapping[str, Column] | None = None) -> DataFrame:
    """Aggregates over all rows (one row even for no rows) or by group; arguments are expressions.

    ``custom``: aggregates of the caller's own by name, built-in ones or a
    grouped pandas_udf, beside or instead of ``specs``.
    """
    order = F.struct(*(quoted(c) for c in order_by.split(","))) if order_by else None
    made = [aggregate(fn, compile_value(arg, df.schema) if arg else None, order, exact).alias(alias) for alias, fn, arg in (parse_specs(specs) if specs else [])]
    made += [c.alias(name) for name, c in (custom or {}).items()]
    if not made:
        raise ArgumentError("no aggregates")
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*group_keys(df, by)).agg(*made) if by else df.agg(*made)


def group(df: DataFrame, by: str | Iterable[str], order_by: str | None = None, exact: bool = True, **columns: str | Iterable[str] | bool) -> DataFrame:
    """group(df, "a", sum="x,y", count=True) -> a, x_sum, y_sum, count; a count if nothing is asked for."""
    specs = []
    for fn, names in columns.items():
        if fn == "count" and names is True:
            specs.append("count = count()")
            continue
        for name in names.split(",") if isinstance(names, str) else names:
            specs.append(f"{name.strip()}_{fn} = {fn}(`{name.strip()}`)")
    return reduce_rows(df, specs or ["count = count()"], by.split(",") if isinstance(by, str) else by, order_by, exact)


def count(df: DataFrame, by: str | None = None, distinct: str | None = None, approx: bool = False) -> DataFrame:
    if by is not None:
        return df.groupBy(quoted(by)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), quoted(by).asc_nulls_last())
    made = [F.count(F.lit(1)).alias("total")]
    if distinct is not None:
        made.append((F.approx_count_distinct(quoted(distinct), 0.01625) if approx else F.count_distinct(quoted(distinct))).alias("distinct"))
    return df.agg(*made)


def frequencies(df: DataFrame, column: str, limit: int | None = 20, ascending: bool = False, skip_nulls: bool = False) -> DataFrame:
    """value, count, percent of all rows; most frequent first."""
    value = F.coalesce(quoted(column).cast("string"), F.lit("<null>")).alias("value")
    every = df.select(value).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    total = every.agg(F.sum("count").alias("total"))
    out = every.crossJoin(F.broadcast(total)).withColumn("percent", co.half_up(F.col("count") * 100.0 / F.col("total"), 2)).drop("total")  # one row
    if skip_nulls:
        out = out.filter(F.col("value") != "<null>")
    out = out.orderBy(F.asc("count") if ascending else F.desc("count"), "value")
    return out.limit(limit) if limit else out


def unique(df: DataFrame, columns: Iterable[str] | None = None, keep: str = "first", order_by: str | Iterable[str] | None = None) -> DataFrame:
    """One row per key: the first or last of the given order. Without an order, any (dropDuplicates)."""
    names = list(columns or df.columns)
    if order_by is None:
        return df.dropDuplicates(names)
    order = sort_columns(df, order_by)
    # a partial aggregation keeps one row per key and task before the shuffle, however frequent a key is
    kinds = {n: co.kind_of(df.schema[n].dataType) for n, _ in parse_keys(order_by)}
    if set(kinds.values()) <= {"num", "time"}:
        keys, place = [quoted(c) for c in names], []
        for n, way in parse_keys(order_by):  # as sort has it: nulls last, with a descending key first
            c = quoted(n)
            place += [c.isNull(), c] if way == "asc" else [c.isNotNull(), -(F.unix_micros(c.cast("timestamp")) if kinds[n] == "time" else c)]
        pick = (F.max_by if keep == "last" else F.min_by)(F.struct(*(quoted(c) for c in df.columns)), F.struct(*place, *(quoted(c) for c in df.columns)))
        return df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(pick.alias("_row")).select("_row.*")
    if keep == "last":
        order = sort_columns(df, [f"{n}:{'asc' if w == 'desc' else 'desc'}" for n, w in parse_keys(order_by)])
    w = Window.partitionBy(*(quoted(c) for c in names)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def pivot(df: DataFrame, index: Iterable[str], columns: str, values: str | None = None, agg: str = "sum", fill: object = None, headers: list | None = None) -> DataFrame:
    """Long to wide. Headers are the column's values in order (numbers as numbers), null as "null"; one extra pass finds them unless given."""
    index = [index] if isinstance(index, str) else list(index)
    head = F.coalesce(quoted(columns).cast("string"), F.lit("null"))
    if headers is None:
        headers = [r[0] for r in df.select(head.alias("h")).distinct().collect()]  # they become columns
        headers.sort(key=lambda h: (0, float(h), h) if re.fullmatch(r"-?\d+(\.\d+)?", h) else (1, 0.0, h))
    value = compile_value(f"`{values}`", df.schema) if values else Val(F.lit(1), "num")
    made = aggregate("count" if agg == "count" else agg, value)
    if agg in ("sum", "avg", "mean"):
        made = co.half_up(made, 6)
    out = df.withColumn("_head", head).groupBy(*(quoted(c) for c in index)).pivot("_head", headers).agg(made)
    if fill is not None:
        typed = isinstance(fill, (int, float))
        return out.withColumns({h: F.coalesce(quoted(h), F.lit(fill)) if typed else F.coalesce(co.text(quoted(h), co.kind_of(out.schema[h].dataType)), F.lit(fill)) for h in headers})
    if agg in ("sum", "count"):
        return out.withColumns({h: F.coalesce(quoted(h), F.lit(0)) for h in headers})
    return out


def unpivot(df: DataFrame, index: Iterable[str], values: Iterable[str] | None = None, variable: str = "variable", value: str = "value", drop_null: bool = False) -> DataFrame:
    """Wide to long; values of different types become strings."""
    index = [index] if isinstance(index, str) else list(index)
    names = list(values) if values is not None else [c for c in df.columns if c not in index]
    types = {df.schema[c].dataType for c in names}
    if len(types) > 1:
        numeric = {co.kind_of(t) for t in types} == {"num"}
        df = df.withColumns({c: quoted(c).cast("double") if numeric else co.text(quoted(c), co.kind_of(df.schema[c].dataType)) for c in names})
    out = df.unpivot([quoted(c) for c in index], [quoted(c) for c in names], variable, value)
    return out.filter(quoted(value).isNotNull()) if drop_null else out


def distinct_sketches(df: DataFrame, column: str, by: Iterable[str] = (), precision: int = 12) -> DataFrame:
    """A HyperLogLog sketch of a column's values by group, to be kept and merged later."""
    return df.groupBy(*(quoted(c) for c in by)).agg(F.hll_sketch_agg(quoted(column), F.lit(precision)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Estimated distinct values of the union of sketches."""
    return sketches.groupBy(*(quoted(c) for c in by)).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
