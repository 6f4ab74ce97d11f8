"""Row-level operators: filter, select, derive, rename, cast, clean, explode, flatten, mask. None of them shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import compile_filter, compile_value, quoted

NULL_WORDS = ("N/A", "NA", "null", "NULL", "none", "NONE", "-")
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "t", "y"), ("false", "0", "no", "f", "n")


def kind(df: DataFrame, name: str) -> str:
    return co.kind_of(df.schema[name].dataType)


def filter_rows(df: DataFrame, condition: str | Column | Callable[[dict], bool]) -> DataFrame:
    """``condition``: an expression, a Column, or a function of a row, which runs in Python workers batch by batch."""
    if isinstance(condition, str):
        return df.filter(compile_filter(condition, df))
    if isinstance(condition, Column):
        return df.filter(condition)

    def kept(batches):
        for b in batches:
            yield b.filter(pa.array([bool(condition(r)) for r in b.to_pylist()], pa.bool_()))

    return df.mapInArrow(kept, df.schema)


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns in the given order; one that does not exist is an empty string."""
    return df.select([quoted(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def derive(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """New or replaced columns; every expression sees the input row."""
    return df.withColumns({k: compile_value(v, df.schema).col if isinstance(v, str) else v for k, v in columns.items()})


def map_rows(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """A Python function from row dict to row dict, in Arrow batches; the slow path."""

    def run(batches):
        for b in batches:
            yield b.__class__.from_records([function(r) for r in b.to_dict("records")], columns=names)

    names = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).names
    return df.mapInPandas(run, schema)


def rename(df: DataFrame, names: Mapping[str, str] | str) -> DataFrame:
    if isinstance(names, str):
        names = dict(x.strip().split("=", 1) for x in names.split(","))
    return df.withColumnsRenamed(dict(names))


def cast_column(c: Column, from_kind: str, to: str) -> Column:
    """The value in the named type, null where it has none; blank is null."""
    s = F.trim(co.text(c, from_kind)) if from_kind != "any" else F.to_json(c)
    if to == "string":
        return F.coalesce(co.text(c, from_kind), F.lit(""))
    if to in ("int", "integer"):
        return F.when(s.rlike(r"^-?\d+$"), s.try_cast("bigint"))
    if to in ("number", "float", "double"):
        return co.num(c, from_kind)
    if to in ("bool", "boolean"):
        low = F.lower(s)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if to == "date":
        return F.to_date(co.to_time(c, from_kind))
    if to in ("datetime", "timestamp"):
        return co.to_time(c, from_kind)
    if to == "json":
        return F.try_parse_json(s)
    raise ArgumentError(f"unknown type {to!r}")


def cast(df: DataFrame, types: Mapping[str, str], on_error: str = "null") -> DataFrame:
    """``on_error``: null, fail, keep (the column stays a string) or skip-row. Columns that do not exist are ignored."""
    if on_error not in ("null", "fail", "keep", "skip-row"):
        raise ArgumentError(f"unknown error policy {on_error!r}")
    made, bad = {}, []
    for name, to in types.items():
        if name not in df.columns:
            continue
        c, k = quoted(name), kind(df, name)
        new = cast_column(c, k, to)
        wrong = ~co.is_blank(c, k) & new.isNull()
        if on_error == "fail":
            new = F.when(wrong, F.raise_error(F.concat(F.lit(f"{name}: not {to}: "), c.cast("string")))).otherwise(new)
        elif on_error == "keep":
            new = F.coalesce(new.cast("string"), c.cast("string"))
        elif on_error == "skip-row":
            bad.append(wrong)
        made[name] = new
    for b in bad:
        df = df.filter(~b)
    return df.withColumns(made)


def _title(c: Column) -> Column:
    """Upper case at the start of each run of word characters."""
    words = F.regexp_extract_all(c, F.lit(r"(\w+|\W+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def clean(df: DataFrame, columns: Iterable[str] | None = None, strip: str | None = None, trim: bool = True, case: str | None = None, null_words: Iterable[str] | None = NULL_WORDS, fill: object | Mapping[str, object] | None = None, coerce: bool = False, drop_empty: bool = False) -> DataFrame:
    """String columns: strip characters, trim, case, null words, coerce to numbers, fill nulls, drop rows that are all null."""
    made = {}
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c, k = quoted(f.name), co.kind_of(f.dataType)
        if k == "str":
            if strip:
                c = F.regexp_replace(c, "[" + re.escape(strip) + "]", "")
            if trim:
                c = F.regexp_replace(c, r"^\s+|\s+$", "")
            if case:
                c = {"lower": F.lower, "upper": F.upper, "title": _title}[case](c)
            if null_words is not None:
                c = F.when((c != "") & ~c.isin(*null_words), c)
            if coerce:
                c = co.num(c, "str")
                k = "num"
        value = fill.get(f.name) if isinstance(fill, Mapping) else fill
        if value is not None and (k == "str") == isinstance(value, str):
            c = F.coalesce(c, F.lit(value))
        made[f.name] = c
    df = df.withColumns(made)
    return df.dropna(how="all") if drop_empty else df


def explode(df: DataFrame, column: str, delimiter: str = ",", trim: bool = True, drop_empty: bool = True, preserve: bool = False) -> DataFrame:
    """One row for each element of an array, a JSON array or a delimited string."""
    c, t = quoted(column), df.schema[column].dataType
    if isinstance(t, T.ArrayType):
        items, text = c, isinstance(t.elementType, T.StringType)
    else:
        s = c.cast("string")
        parts = F.split(s, re.escape(delimiter), -1)
        items = F.when(F.ltrim(s).startswith("["), F.coalesce(F.from_json(s, "array<string>"), parts)).otherwise(parts)
        text = True
    if text and trim:
        items = F.transform(items, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    if drop_empty:
        items = F.filter(items, (lambda x: x.isNotNull() & (x != "")) if text else (lambda x: x.isNotNull()))
    return df.withColumn(column, (F.explode_outer if preserve else F.explode)(items))


def flatten(df: DataFrame, separator: str = ".", depth: int = 10, arrays: bool = False) -> DataFrame:
    """Struct fields as columns of their own, named by their path; arrays by their index if asked (one extra pass for their sizes)."""

    def leaves(c: Column, t: T.DataType, path: str, left: int) -> list[Column]:
        if isinstance(t, T.StructType) and left > 0:
            return [x for f in t.fields for x in leaves(c.getField(f.name), f.dataType, f"{path}{separator}{f.name}" if path else f.name, left - 1)]
        if isinstance(t, T.ArrayType) and arrays and left > 0 and path:
            n = sizes.get(path, 0)
            if n:
                return [x for i in range(n) for x in leaves(F.try_element_at(c, F.lit(i + 1)), t.elementType, f"{path}{separator}{i}", left - 1)]
        return [c.alias(path)]

    sizes: dict[str, int] = {}
    if arrays:
        found = {f.name: F.max(F.size(quoted(f.name))).alias(f.name) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
        if found:
            sizes = {k: v or 0 for k, v in df.agg(*found.values()).first().asDict().items()}
    return df.select([x for f in df.schema.fields for x in leaves(quoted(f.name), f.dataType, f.name, depth)])


def _mask(rule: str, s: Column, salt: str) -> Column:
    if rule == "email":
        return F.when(F.locate("@", s) > 1, F.concat(F.substring(s, 1, 1), F.lit("***@"), F.regexp_extract(s, "@(.*)$", 1))).otherwise(F.lit("***"))
    digits = F.regexp_replace(s, r"\D", "")
    if rule == "phone":
        return F.when(F.length(digits) >= 4, F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))).otherwise(F.lit("***"))
    if rule == "card":
        return F.when(F.length(digits) >= 4, F.concat(F.lit("**** **** **** "), F.right(digits, F.lit(4)))).otherwise(F.lit("****"))
    if rule == "ip":
        return F.when(s.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.regexp_extract(s, r"^(\d+\.\d+)\.", 1), F.lit(".***.***"))).otherwise(F.lit("***"))
    if rule == "name":
        words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
        return F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("***"))), " ")
    if rule == "hash":
        return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), s), 256), 1, 16)
    if rule == "redact":
        return F.lit("[REDACTED]")
    raise ArgumentError(f"unknown mask {rule!r}")


def mask(df: DataFrame, rules: Mapping[str, str], salt: str = "") -> DataFrame:
    """Column -> email, phone, card, ip, name, hash or redact; null passes."""
    return df.withColumns({k: F.when(quoted(k).isNotNull(), _mask(v, quoted(k).cast("string"), salt)) for k, v in rules.items() if k in df.columns})
