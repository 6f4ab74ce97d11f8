"""Describing and checking data: statistics, schema inference, semantic types, profiles, validation, data tests, histograms, quantiles."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, ValidationError
from ..functions import coerce as co
from ..functions.expression import EMAIL, URL, UUID, compile_value, quoted
from .ordering import order_statistics

#: Patterns and code lists of the semantic types, in order of detection. Fixed values.
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
IPV6 = r"(?i)^(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}$"
PHONE = r"^\+?[0-9\s\-().]{7,20}$"
COUNTRIES = "US GB DE FR TR CA AU JP CN IN BR IT ES NL SE CH PL MX KR RU ZA EG SA AE SG NZ IE NO DK FI PT GR AT BE IL AR CL CO PE TH MY ID PH VN PK NG KE".split()
CURRENCIES = "USD EUR GBP TRY JPY CAD AUD CHF CNY INR BRL RUB KRW SEK NOK MXN SGD NZD HKD PLN ZAR AED SAR THB IDR".split()
DATE, DATETIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
BOOLS = ("true", "false", "TRUE", "FALSE", "True", "False")


def semantic_type(c: Column) -> Column:
    """uuid, email, url, ipv4, ipv6, country-code, currency, phone or null."""
    s = F.trim(c)
    out = F.when(s.rlike(UUID), "uuid").when(s.rlike(EMAIL), "email").when(s.rlike(URL), "url").when(s.rlike(IPV4), "ipv4").when(s.rlike(IPV6), "ipv6")
    return out.when(s.isin(*COUNTRIES), "country-code").when(s.isin(*CURRENCIES), "currency").when(s.rlike(PHONE) & (F.length(F.regexp_replace(s, r"\D", "")) >= 7), "phone")


def logical_type(c: Column, kind: str) -> Column:
    """integer, number, boolean, date, datetime, string or json; null for blank."""
    if kind == "num":
        return F.when(c.isNotNull(), F.when(c.cast("double") == F.floor(c.cast("double")), "integer").otherwise("number"))
    if kind in ("bool", "time", "any"):
        return F.when(c.isNotNull(), {"bool": "boolean", "time": "datetime", "any": "json"}[kind])
    s = F.trim(c)
    made = F.when(s.isin(*BOOLS), "boolean").when(s.rlike(r"^[+-]?\d+$"), "integer").when(co.num(s, "str").isNotNull(), "number")
    made = made.when(s.rlike(DATE) & s.try_cast("date").isNotNull(), "date").when(s.rlike(DATETIME) & s.try_cast("timestamp").isNotNull(), "datetime").otherwise("string")
    return F.when(c != "", made)


def numeric_stats(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """count, nulls (with what is not numeric), min, max, sum, mean, variance, stddev, distinct."""
    c = quoted(column)
    n = co.num(c, co.kind_of(df.schema[column].dataType)) if co.kind_of(df.schema[column].dataType) != "bool" else F.lit(None).cast("double")
    one = F.count(n) == 1
    return df.agg(
        F.count(n).alias("count"), (F.count(F.lit(1)) - F.count(n)).alias("nulls"), F.min(n).alias("min"), F.max(n).alias("max"), F.coalesce(F.sum(n), F.lit(0.0)).alias("sum"), F.avg(n).alias("mean"),
        F.when(one, 0.0).otherwise(F.var_samp(n)).alias("variance"), F.when(one, 0.0).otherwise(F.stddev_samp(n)).alias("stddev"), (F.count_distinct(n) if exact else F.approx_count_distinct(n, 0.01625)).alias("distinct"),
    )


def string_stats(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    c = quoted(column).cast("string")
    full = F.when(c != "", c)
    return df.agg(
        F.count(full).alias("count"), F.sum(c.isNull().cast("long")).alias("nulls"), F.sum(F.coalesce(c == "", F.lit(False)).cast("long")).alias("empty"),
        F.min(F.length(full)).cast("long").alias("min_length"), F.max(F.length(full)).cast("long").alias("max_length"), F.avg(F.length(full)).alias("avg_length"), (F.count_distinct(full) if exact else F.approx_count_distinct(full, 0.01625)).alias("distinct"),
    )


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    c = quoted(column).cast("string").alias("value")
    return df.select(c).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(n)


def _long(df: DataFrame, columns: Iterable[str], *parts) -> DataFrame:
    """One row per cell: column and the given functions of it; a narrow explode, no shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), *(p(quoted(c), co.kind_of(df.schema[c].dataType)).alias(n) for n, p in parts)) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def infer_schema(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column, type, confidence, nullable, nulls, semantic. The dominant type wins; integers and numbers together make numbers; under 90 % it is mixed."""
    columns = list(columns or df.columns)
    cells = _long(df, columns, ("type", logical_type), ("semantic", lambda c, k: semantic_type(c) if k == "str" else F.lit(None).cast("string")))
    votes = cells.groupBy("column", "type", "semantic").agg(F.count(F.lit(1)).alias("n"))
    by = votes.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("type").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        *(F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(f"t_{t}") for t in TYPES), *(F.coalesce(F.sum(F.when(F.col("semantic") == t, F.col("n"))), F.lit(0)).alias(f"s_{t}") for t in SEMANTIC),
    )
    full = F.col("rows") - F.col("nulls")
    best = F.greatest(*(F.struct(F.col(f"t_{t}").alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)))
    numbers = (F.col("t_integer") + F.col("t_number")) / full
    kinds = sum(((F.col(f"t_{t}") > 0).cast("int") for t in TYPES), F.lit(0))
    share = best["n"] / full
    made = F.when(full == 0, "null").when((F.col("t_number") > 0) & (numbers >= 0.95), "number").when((share < 0.9) & (kinds > 1), "mixed").otherwise(best["t"])
    said = F.coalesce(*(F.when(F.col(f"s_{t}") / full >= 0.8, t) for t in SEMANTIC))
    confidence = F.when(full == 0, 0.0).when((F.col("t_number") > 0) & (numbers >= 0.95), numbers).otherwise(share)
    return by.select("column", made.alias("type"), co.half_up(confidence, 4).alias("confidence"), (F.col("nulls") > 0).alias("nullable"), "nulls", F.when(full > 0, said).alias("semantic"))


TYPES = ("string", "integer", "number", "boolean", "date", "datetime", "json")
SEMANTIC = ("uuid", "email", "url", "ipv4", "ipv6", "country-code", "currency", "phone")


def profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column: type, confidence, nulls, empties, distinct values (estimated), moments, zeros, negatives, lengths, commonest values. Two passes."""
    columns = list(columns or df.columns)
    cells = _long(df, columns, ("value", lambda c, k: co.text(c, k)), ("n", lambda c, k: co.num(c, k) if k != "bool" else F.lit(None).cast("double")))
    figures = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("value") == "").cast("long")).alias("empty"), F.approx_count_distinct(F.when(F.col("value") != "", F.col("value")), 0.01625).alias("distinct"),
        F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("stddev"), F.sum((F.col("n") == 0).cast("long")).alias("zeros"), F.sum((F.col("n") < 0).cast("long")).alias("negatives"),
        F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"), F.avg(F.length("value")).alias("avg_length"),
    )
    tops = reduce(DataFrame.unionByName, [top_values(df, c).withColumn("column", F.lit(c)) for c in columns]).groupBy("column").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("m"), "value"))).alias("t"))
    tops = tops.select("column", F.transform("t", lambda x: F.struct(x["value"].alias("value"), (-x["m"]).alias("count"))).alias("top"))  # five a column
    return infer_schema(df, columns).join(figures, "column").join(tops, "column", "left")


RULES = {"email": EMAIL, "url": URL, "uuid": UUID, "ipv4": IPV4, "ipv6": IPV6, "phone": PHONE}


def _violations(df: DataFrame, rules: Mapping[str, Mapping]) -> list[tuple[str, str, Column]]:
    out = []
    for c, rule in rules.items():
        if c not in df.columns:
            out.append((c, "nullable", F.lit(rule.get("nullable", True) is False)))
            continue
        v, k = quoted(c), co.kind_of(df.schema[c].dataType)
        blank = co.is_blank(v, k)
        if rule.get("nullable") is False:
            out.append((c, "nullable", blank))
        if want := rule.get("type"):
            have = logical_type(v, k)
            fits = {"number": ("integer", "number"), "date": ("date", "datetime"), "string": TYPES}.get(want, (want,))
            out.append((c, "type", ~blank & ~F.coalesce(have.isin(*fits), F.lit(False))))
        if form := rule.get("format"):
            out.append((c, "format", ~blank & ~co.text(v, k).rlike(RULES.get(form, form))))
    return out


def validate(df: DataFrame, rules: Mapping[str, Mapping], samples: int = 5) -> DataFrame:
    """column, rule, violations, samples for each rule, and a row (null, null) with the number of invalid rows. One pass for the counts."""
    checks = _violations(df, rules)
    if not checks:
        raise ArgumentError("no rules")
    bad = reduce(lambda a, b: a | b, (x for *_, x in checks))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.coalesce(x, F.lit(False)).alias("bad"), (co.text(quoted(c), co.kind_of(df.schema[c].dataType)) if c in df.columns else F.lit(None).cast("string")).alias("value")) for c, r, x in checks), F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("rule"), F.coalesce(bad, F.lit(False)).alias("bad"), F.lit(None).cast("string").alias("value")))
    long = df.select(F.explode(cells).alias("x")).select("x.*")
    counts = long.groupBy("column", "rule").agg(F.sum(F.col("bad").cast("long")).alias("violations"))
    # the smallest few values of each rule; one row per value and task is kept before the shuffle
    shown = long.filter("bad and column is not null").select("column", "rule", F.coalesce("value", F.lit("<null>")).alias("value")).distinct()
    place = F.row_number().over(Window.partitionBy("column", "rule").orderBy("value"))
    shown = shown.withColumn("place", place).filter(F.col("place") <= samples).groupBy("column", "rule").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return counts.join(shown, ["column", "rule"], "left")


def require_valid(df: DataFrame, rules: Mapping[str, Mapping]) -> None:
    bad = reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for *_, x in _violations(df, rules)))
    if not df.filter(bad).isEmpty():
        raise ValidationError("rows break the schema")


def data_tests(df: DataFrame, rules: Iterable[str], min_rows: int | None = None, max_rows: int | None = None) -> DataFrame:
    """rule, violations, passed. Rules: not_null(c), unique(c) (every row after the first of a value) or an expression that must hold."""
    made, names = [], []
    for rule in rules:
        head, _, arg = rule.strip().partition("(")
        arg = arg.rstrip(") ")
        if head == "not_null":
            v = compile_value(arg, df.schema)
            made.append(F.sum(v.blank.cast("long")))
        elif head == "unique":
            v = compile_value(arg, df.schema)
            shown = F.when(~v.blank, v.col)
            made.append(F.count(shown) - F.count_distinct(shown))
        else:
            try:
                made.append(F.sum((~compile_value(rule, df.schema).truth).cast("long")))
            except ValueError:  # an expression that cannot be read never holds
                made.append(F.count(F.lit(1)))
        names.append(rule)
    made.append(F.count(F.lit(1)))
    row = df.agg(*(F.coalesce(m, F.lit(0)).alias(f"v{i}") for i, m in enumerate(made)))
    cells = [F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").cast("long").alias("violations")) for i, n in enumerate(names)]
    rows = F.col(f"v{len(names)}")
    if min_rows is not None:
        cells.append(F.struct(F.lit(f"min_rows({min_rows})").alias("rule"), (rows < min_rows).cast("long").alias("violations")))
    if max_rows is not None:
        cells.append(F.struct(F.lit(f"max_rows({max_rows})").alias("rule"), (rows > max_rows).cast("long").alias("violations")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*").withColumn("passed", F.col("violations") == 0)


def quantiles(df: DataFrame, columns: Iterable[str], percents: Iterable[float] = (90, 95, 99), approx: bool = False) -> DataFrame:
    """column, count, min, q1, median, q3, iqr, max and p.. for each percentage; exact ones interpolate between neighbours."""
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75, **{f"p{p:g}".replace(".", "_"): p / 100 for p in percents}}
    names, out = list(shares), None
    for c in columns:
        rows = df.select(co.parse_float(quoted(c), co.kind_of(df.schema[c].dataType)).alias("v"))
        ends = rows.agg(F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), *([F.percentile_approx("v", list(shares.values()), 100_000).alias("q")] if approx else [])).first()
        if approx or not ends["count"]:
            found = dict(zip(names, (ends["q"] if approx else None) or [None] * len(names), strict=True))
        else:
            at = {k: share * (ends["count"] - 1) for k, share in shares.items()}
            value = order_statistics(rows, "v", [f(x) for x in at.values() for f in (math.floor, math.ceil)])
            found = {k: value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)]) * (x - math.floor(x)) for k, x in at.items()}
        number = lambda k, found=found: F.lit(found[k]).cast("double")
        made = df.sparkSession.range(1).select(F.lit(c).alias("column"), F.lit(ends["count"]).cast("long").alias("count"), F.lit(ends["min"]).cast("double").alias("min"), *(co.half_up(number(k), 4).alias(k) for k in names[:3]), co.half_up(number("q3") - number("q1"), 4).alias("iqr"), F.lit(ends["max"]).cast("double").alias("max"), *(co.half_up(number(k), 4).alias(k) for k in names[3:]))
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ArgumentError("no columns")
    return out


def histogram(df: DataFrame, column: str, bins: int = 10, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, low, high, count, percent; equal widths, the last bin closed. One pass for the range unless given, one for the counts."""
    bins = max(2, min(50, bins))
    n = co.num(quoted(column), co.kind_of(df.schema[column].dataType))
    rows = df.select(n.alias("v")).filter("v is not null and not isnan(v)")
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("v").alias("n"))
    ends = ends.withColumns({k: F.lit(v) for k, v in (("a", low), ("b", high)) if v is not None}).withColumn("w", (F.col("b") - F.col("a")) / bins)
    at = F.least(F.greatest(F.floor((F.col("v") - F.col("a")) / F.col("w")), F.lit(0)), F.lit(bins - 1))
    found = rows.crossJoin(F.broadcast(ends)).select(F.when(F.col("w") == 0, 0).otherwise(at).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))  # one row
    spine = ends.filter("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("w") == 0, 0).otherwise(bins - 1).cast("long"))).alias("bin"), "a", "w", "n")
    start = F.col("a") + F.col("bin") * F.col("w")
    return spine.join(found, "bin", "left").select("bin", start.alias("low"), (start + F.col("w")).alias("high"), F.coalesce("count", F.lit(0)).alias("count"), co.half_up(F.coalesce("count", F.lit(0)) * 100.0 / F.col("n"), 1).alias("percent"))
