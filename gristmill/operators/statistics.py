"""Correlation, regression, outliers, crosstabs and entropy."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import quoted
from .ordering import order_statistics


def _floats(df: DataFrame, columns: Iterable[str]) -> dict:
    return {c: co.parse_float(quoted(c), co.kind_of(df.schema[c].dataType)) for c in columns}


def correlation(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """a, b, r for every pair of columns (both ways, and itself), over rows in which all of them are numbers; one aggregation."""
    columns = list(columns)
    rows = df.select(*(v.alias(f"c{i}") for i, v in enumerate(_floats(df, columns).values()))).dropna()
    pairs = list(combinations(range(len(columns)), 2))
    row = rows.agg(*(F.corr(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs), *(F.min(F.lit(1)).alias("one") for _ in "x"))
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            k = f"r{min(i, j)}_{max(i, j)}"
            r = F.lit(1.0) if i == j else co.half_up(F.when(F.isnan(k) | F.col(k).isNull(), 0.0).otherwise(F.col(k)), 4)
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept, r, r2, std_error of y on x."""
    v = _floats(df, [x, y])
    row = df.select(v[x].alias("x"), v[y].alias("y")).dropna().agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("r"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    error = F.when(F.col("n") > 2, F.sqrt(rest / (F.col("n") - 2))).otherwise(0.0)
    good = (F.col("n") >= 2) & (F.col("sxx") > 0)
    slope = F.when(good, F.col("slope")).otherwise(F.raise_error(F.lit("regression needs two rows and some variance")).cast("double"))
    r = F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0))
    return row.select("n", co.half_up(slope, 6).alias("slope"), co.half_up(F.col("intercept"), 6).alias("intercept"), co.half_up(r, 4).alias("r"), co.half_up(r * r, 4).alias("r2"), co.half_up(error, 4).alias("std_error"))


def _at(rows: DataFrame, column: str, n: int, places: Iterable[int]) -> list[float]:
    """Exact order statistics at the given places (from 0)."""
    places = list(places)
    found = order_statistics(rows, column, places)
    return [found[p] for p in places]


def outliers(df: DataFrame, column: str, method: str = "zscore", threshold: float | None = None, only: bool = False, invert: bool = False, annotate: bool = True) -> DataFrame:
    """zscore (sample deviation, 3), iqr (quartiles at floor places, 1.5) or mad (upper median, 3.5); adds _is_outlier and _outlier_score."""
    v = co.parse_float(quoted(column), co.kind_of(df.schema[column].dataType))
    rows = df.select(v.alias("v")).filter("v is not null and not isnan(v)")
    limit = threshold if threshold is not None else {"zscore": 3.0, "iqr": 1.5, "mad": 3.5}.get(method, 3.0)
    if method == "zscore":
        s = rows.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
        z = (v - (s["m"] or 0.0)) / s["s"] if s["s"] else F.lit(0.0)
        out, score = F.abs(z) > limit, z
    elif method in ("iqr", "mad"):
        n = rows.count()
        if not n:
            return df
        if method == "iqr":
            q1, q3 = _at(rows, "v", n, [int(0.25 * (n - 1)), int(0.75 * (n - 1))])
            wide = q3 - q1
            low, high = q1 - limit * wide, q3 + limit * wide
            out = (v < low) | (v > high)
            score = F.greatest(F.lit(low) - v, v - high, F.lit(0.0)) / wide if wide > 0 else F.lit(0.0)
        else:
            (mid,) = _at(rows, "v", n, [n // 2])
            (mad,) = _at(rows.select(F.abs(F.col("v") - mid).alias("d")), "d", n, [n // 2])
            score = F.abs(v - mid) * 0.6745 / (mad or 0.0001)
            out = score > limit
    else:
        raise ArgumentError(f"unknown method {method!r}")
    known = v.isNotNull()
    out, score = F.coalesce(known & out, F.lit(False)), F.round(F.when(known, score).otherwise(0.0), 3)
    if only:
        made = df.filter(out)
    elif invert:
        return df.filter(~out)
    else:
        made = df
    return made.withColumns({"_is_outlier": out, "_outlier_score": score}) if annotate else made


def crosstab(df: DataFrame, row: str, col: str, top_rows: int | None = None, top_cols: int | None = None, normalise: str | None = None) -> DataFrame:
    """Long table: row, col, count, share (of the row, column or all). The categories kept are the most frequent ones."""
    pairs = df.select(F.coalesce(quoted(row).cast("string"), F.lit("null")).alias("row"), F.coalesce(quoted(col).cast("string"), F.lit("null")).alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("count"))
    for name, most in (("row", top_rows), ("col", top_cols)):
        if most:
            kept = pairs.groupBy(name).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), name).limit(most).select(name)
            pairs = pairs.join(kept, name, "left_semi")
    grid = pairs.select("row").distinct().crossJoin(pairs.select("col").distinct())  # category names, after aggregation
    cells = grid.join(pairs, ["row", "col"], "left").fillna(0, ["count"])
    if not normalise:
        return cells.select("row", "col", "count")
    by = {"row": ["row"], "col": ["col"], "all": []}[normalise]
    total = pairs.groupBy(*by).agg(F.sum("count").alias("n")) if by else pairs.agg(F.sum("count").alias("n"))
    cells = cells.join(total, by, "left") if by else cells.crossJoin(F.broadcast(total))
    return cells.select("row", "col", "count", F.when(F.col("n") > 0, co.half_up(F.col("count") * 100.0 / F.col("n"), 1)).otherwise(0.0).alias("share"))


def crosstab_wide(cells: DataFrame, value: str = "count") -> DataFrame:
    """The crosstab as a table with totals."""
    heads = sorted(r[0] for r in cells.select("col").distinct().collect())  # they become columns
    wide = cells.groupBy("row").pivot("col", heads).agg(F.first(value))
    wide = wide.withColumn("Total", sum((F.coalesce(quoted(h), F.lit(0)) for h in heads), F.lit(0)))
    total = wide.agg(*(F.sum(quoted(h)).alias(h) for h in [*heads, "Total"])).select(F.lit("Total").alias("row"), "*")
    return wide.unionByName(total)


def chi_square(cells: DataFrame) -> DataFrame:
    """chi_square, dof and n of a crosstab's counts."""
    r = cells.groupBy("row").agg(F.sum("count").alias("r"))
    c = cells.groupBy("col").agg(F.sum("count").alias("c"))
    n = cells.agg(F.sum("count").alias("n"))
    every = cells.join(r, "row").join(c, "col").crossJoin(F.broadcast(n))  # one row
    expected = F.col("r") * F.col("c") / F.col("n")
    made = every.agg(F.sum(F.when(expected > 0, F.pow(F.col("count") - expected, F.lit(2.0)) / expected)).alias("x"), ((F.count_distinct("row") - 1) * (F.count_distinct("col") - 1)).alias("dof"), F.first("n").alias("n"))
    return made.select(co.half_up(F.coalesce("x", F.lit(0.0)), 4).alias("chi_square"), F.greatest("dof", F.lit(0)).alias("dof"), "n")


def entropy(df: DataFrame, columns: Iterable[str], target: str | None = None, bins: int = 10) -> DataFrame:
    """feature, entropy, and with a target its information_gain and gain_ratio. Numbers are cut into equal bins between their least and largest value."""
    columns = list(columns)
    names = [*columns, *([target] if target else [])]
    numeric = [c for c in names if co.kind_of(df.schema[c].dataType) == "num"]
    ends = df.agg(*(f(quoted(c)).cast("double").alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("a", F.min), ("b", F.max)))).first() if numeric else {}

    def label(c: str):
        if c not in numeric:
            return F.coalesce(quoted(c).cast("string"), F.lit("null"))
        i = numeric.index(c)
        a, b = ends[f"a{i}"], ends[f"b{i}"]
        if a is None or a == b:
            return F.when(quoted(c).isNull(), "null").otherwise("bin_0")
        at = F.floor(F.least(F.greatest((quoted(c).cast("double") - a) / (b - a), F.lit(0.0)), F.lit(0.9999)) * bins)
        return F.coalesce(F.concat(F.lit("bin_"), at.cast("string")), F.lit("null"))

    y = label(target) if target else F.lit("")
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), label(c).alias("x"), y.alias("y")) for c in columns))).alias("z")).select("z.*")
    joint = cells.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def bits(counts: DataFrame, by: list[str]) -> DataFrame:
        """log2(N) - sum n log2 n / N by group."""
        s = counts.groupBy(*by).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log2("n")).alias("t"))
        return s.withColumn("h", F.log2("s") - F.col("t") / F.col("s"))

    hx = bits(joint.groupBy("feature", "x").agg(F.sum("n").alias("n")), ["feature"]).select("feature", F.col("h").alias("hx"))
    if not target:
        return hx.select("feature", co.half_up(F.abs("hx"), 4).alias("entropy")).orderBy(F.desc("entropy"), "feature")
    hy = bits(joint.groupBy("feature", "y").agg(F.sum("n").alias("n")), ["feature"]).select("feature", F.col("h").alias("hy"))
    inside = bits(joint, ["feature", "x"]).groupBy("feature").agg((F.sum(F.col("s") * F.col("h")) / F.sum("s")).alias("rest"))
    out = hx.join(hy, "feature").join(inside, "feature")
    gain = F.greatest(F.col("hy") - F.col("rest"), F.lit(0.0))
    return out.select("feature", co.half_up(F.abs("hx"), 4).alias("entropy"), co.half_up(gain, 4).alias("information_gain"), co.half_up(F.when(F.col("hx") > 1e-12, gain / F.col("hx")).otherwise(0.0), 4).alias("gain_ratio")).orderBy(F.desc("information_gain"), "feature")
