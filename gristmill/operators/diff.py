"""Keyed comparison of two data sets: one full outer join, then column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, DuplicateKeyError, MismatchError
from ..functions import coerce as co
from ..functions.expression import quoted
from .ordering import sort_columns


def _kind(df: DataFrame, c: str) -> str:
    return co.kind_of(df.schema[c].dataType)


def _one_per_key(df: DataFrame, keys: list[str], policy: str, order_by: str | None) -> DataFrame:
    if policy == "error":
        again = df.groupBy(*(quoted(k) for k in keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").first()
        if again is not None:
            raise DuplicateKeyError(f"duplicate key {tuple(again)[:-1]}")
        return df
    if policy not in ("first", "last"):
        raise ArgumentError(f"unknown policy {policy!r}")
    order = sort_columns(df, order_by) if order_by else [quoted(c) for c in df.columns]
    if policy == "last":
        order = sort_columns(df, ",".join(f"{x.split(':')[0]}:{'asc' if x.endswith(':desc') else 'desc'}" for x in order_by.split(","))) if order_by else [quoted(c).desc() for c in df.columns]
    w = Window.partitionBy(*(quoted(k) for k in keys)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def same(a: Column, a_kind: str, b: Column, b_kind: str, coerce: bool = False, epsilon: float | None = None, trim: bool = False, ignore_case: bool = False) -> Column:
    """Whether two values are equal; strict unless told otherwise: null, "" and values of other types differ."""
    if a_kind == b_kind == "str" or (coerce and "str" in (a_kind, b_kind)):
        x, y = co.text(a, a_kind), co.text(b, b_kind)
        if trim or coerce:
            x, y = F.trim(x), F.trim(y)
        if ignore_case:
            x, y = F.lower(x), F.lower(y)
        if not coerce:
            return x.eqNullSafe(y)
        x, y = F.when(x != "", x), F.when(y != "", y)
        m, n = co.num(x, "str"), co.num(y, "str")
        near = F.abs(m - n) <= (epsilon or 0.0)
        flags = [F.when(F.lower(v).isin("true", "1"), 1).when(F.lower(v).isin("false", "0"), 0) for v in (x, y)]
        truth = (flags[0] == flags[1]) if "bool" in (a_kind, b_kind) else F.lit(None).cast("boolean")
        times = (co.to_time(a, a_kind) == co.to_time(b, b_kind)) if "time" in (a_kind, b_kind) else F.lit(None).cast("boolean")
        return x.eqNullSafe(y) | F.coalesce(near, F.lit(False)) | F.coalesce(truth, F.lit(False)) | F.coalesce(times, F.lit(False))
    if a_kind == b_kind == "num":
        if epsilon is not None:
            return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= epsilon, F.lit(False))
        return a.eqNullSafe(b)
    if coerce and {a_kind, b_kind} <= {"num", "bool"}:
        return co.num(a, a_kind).eqNullSafe(co.num(b, b_kind))
    if a_kind == b_kind:
        return F.to_json(a).eqNullSafe(F.to_json(b)) if a_kind == "any" else a.eqNullSafe(b)
    return a.isNull() & b.isNull()


def diff(left: DataFrame, right: DataFrame, keys: str | Iterable[str], columns: Iterable[str] | None = None, ignore: Iterable[str] = (), duplicates: str = "error", order_by: str | None = None, only: Iterable[str] | None = None, coerce: bool = False, epsilon: float | None = None, trim: bool = False, ignore_case: bool = False) -> DataFrame:
    """Keys, change_type (added, removed, changed, unchanged), changed_columns, and the rows ``left`` and ``right`` as structs."""
    keys = keys.split(",") if isinstance(keys, str) else list(keys)
    ignore = list(ignore)
    if set(keys) & set(ignore):
        raise ArgumentError("a key cannot be ignored")
    every = list(columns) if columns else list(dict.fromkeys([*left.columns, *right.columns]))
    compared = [c for c in every if c not in keys and c not in ignore]
    l, r = _one_per_key(left, keys, duplicates, order_by), _one_per_key(right, keys, duplicates, order_by)
    l = l.select(F.struct(*(quoted(c) for c in left.columns)).alias("left"))
    r = r.select(F.struct(*(quoted(c) for c in right.columns)).alias("right"))
    a, b = (lambda c: F.col("left").getField(c)), (lambda c: F.col("right").getField(c))

    def key(x: Column, k: str, df: DataFrame) -> Column:
        return F.coalesce(co.num(x, _kind(df, k)).cast("string"), F.trim(x.cast("string"))) if coerce else x

    on = None
    for k in keys:
        if not coerce and _kind(left, k) != _kind(right, k):
            one = F.lit(False)
        else:
            one = key(a(k), k, left).eqNullSafe(key(b(k), k, right))
        on = one if on is None else on & one
    both = l.join(r, on, "full")
    differ = []
    for c in compared:
        if c in left.columns and c in right.columns:
            equal = same(a(c), _kind(left, c), b(c), _kind(right, c), coerce, epsilon, trim, ignore_case)
        else:  # a missing column differs from any value, and from null too unless values are coerced
            x, side = (a(c), left) if c in left.columns else (b(c), right)
            equal = co.is_blank(x, _kind(side, c)) if coerce else F.lit(False)
        differ.append(F.when(~equal, F.lit(c)))
    changed = F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>")
    both = both.withColumn("changed_columns", F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    kind = F.when(F.col("left").isNull(), "added").when(F.col("right").isNull(), "removed").when(F.size("changed_columns") > 0, "changed").otherwise("unchanged")
    out = both.select(*(F.coalesce(a(k), b(k).cast(left.schema[k].dataType)).alias(k) if _kind(left, k) == _kind(right, k) else F.coalesce(a(k).cast("string"), b(k).cast("string")).alias(k) for k in keys), kind.alias("change_type"), "changed_columns", "left", "right")
    return out.filter(F.col("change_type").isin(*only)) if only else out


def summary(changes: DataFrame) -> DataFrame:
    """change_type, column (null for whole rows), count."""
    rows = changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("count")).select("change_type", F.lit(None).cast("string").alias("column"), "count")
    cells = changes.select(F.explode("changed_columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("count")).select(F.lit("changed").alias("change_type"), "column", "count")
    return rows.unionByName(cells)


def schema_diff(left: DataFrame, right: DataFrame) -> dict[str, list]:
    a, b = dict(left.dtypes), dict(right.dtypes)
    return {"added": [c for c in b if c not in a], "removed": [c for c in a if c not in b], "changed": [(c, a[c], b[c]) for c in a if c in b and a[c] != b[c]]}


def patch(changes: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    """One JSON line per change: insert with its row, delete, update with the old and new value of each changed column."""
    keys = keys.split(",") if isinstance(keys, str) else list(keys)
    key = F.struct(*(quoted(k) for k in keys))
    both = [c for c in changes.schema["left"].dataType.names if c in changes.schema["right"].dataType.names]
    cell = lambda c: F.struct(co.text(F.col("left").getField(c), co.kind_of(changes.schema["left"].dataType[c].dataType)).alias("old"), co.text(F.col("right").getField(c), co.kind_of(changes.schema["right"].dataType[c].dataType)).alias("new"))
    cells = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("key"), cell(c).alias("value")) for c in both)), lambda e: F.array_contains("changed_columns", e["key"])))
    line = F.when(F.col("change_type") == "added", F.to_json(F.struct(F.lit("insert").alias("op"), key.alias("key"), F.col("right").alias("row"))))
    line = line.when(F.col("change_type") == "removed", F.to_json(F.struct(F.lit("delete").alias("op"), key.alias("key"))))
    line = line.otherwise(F.to_json(F.struct(F.lit("update").alias("op"), key.alias("key"), cells.alias("changes"))))
    return changes.filter("change_type <> 'unchanged'").select(line.alias("value"))


def fail_on_difference(changes: DataFrame) -> None:
    if not changes.filter("change_type <> 'unchanged'").isEmpty():
        raise MismatchError("the data sets differ")


def fingerprint(df: DataFrame, columns: Iterable[str] | None = None, name: str = "_fingerprint") -> DataFrame:
    return df.withColumn(name, F.xxhash64(*(quoted(c) for c in columns or df.columns)))
