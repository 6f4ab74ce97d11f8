"""Sort, limit, offset, tail, top-k and sampling. A DataFrame has no order of arrival, so each takes the order that it needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import quoted


def parse_keys(keys: str | Iterable[str], default: str = "asc") -> list[tuple[str, str]]:
    """"a,b:desc" -> [("a", "asc"), ("b", "desc")]."""
    items = keys.split(",") if isinstance(keys, str) else list(keys)
    out = []
    for item in items:
        name, _, way = item.strip().partition(":")
        if way and way not in ("asc", "desc"):
            raise ArgumentError(f"unknown direction {way!r}")
        out.append((name, way or default))
    return out


def natural(c: Column) -> Column:
    """A sort key in which runs of digits compare as numbers: by their length without zeros in front, then digit by digit."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    bare = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(x))


def sort_columns(df: DataFrame, keys: str | Iterable[str], nulls: str = "last", ignore_case: bool = False, natural_order: bool = False, nulls_absolute: bool = False, default: str = "asc") -> list[Column]:
    """Sort orders. Strings that look like numbers sort as numbers and before others. With a descending key ``nulls`` is turned round too, unless ``nulls_absolute``."""
    out = []
    for name, way in parse_keys(keys, default):
        c, k = quoted(name), co.kind_of(df.schema[name].dataType)
        last = nulls == "last"
        if way == "desc" and not nulls_absolute:
            last = not last
        parts = [c]
        if k == "str":
            c = co.blank_to_null(c, k)
            if natural_order:
                parts = [natural(c)]
            else:
                n = co.num(c, k)
                parts = [F.when(c.isNotNull(), n.isNull()), n, F.lower(c) if ignore_case else c]
        for p in parts:
            out.append({("asc", True): p.asc_nulls_last, ("asc", False): p.asc_nulls_first, ("desc", True): p.desc_nulls_last, ("desc", False): p.desc_nulls_first}[way, last]())
    return out


def sort(df: DataFrame, keys: str | Iterable[str], **how) -> DataFrame:
    return df.orderBy(*sort_columns(df, keys, **how))


def ranked(df: DataFrame, keys: str | Iterable[str], name: str = "place", **how) -> DataFrame:
    """All rows with their place in the order, from 1; counted by partition, so no task holds the whole table."""
    out = sort(df, keys, **how)
    rows = out.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return df.sparkSession.createDataFrame(rows, StructType([*out.schema.fields, StructField(name, LongType())]))


def placed(df: DataFrame, order: Iterable[Column], name: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with each row's place in the order, from 1, and running sums (name -> column) up to it.

    A range sort numbers the rows of each partition by themselves; what comes
    before a partition is one row for each. The sorted rows are kept (persisted)
    because both must see the same partitions, so no task holds the whole table.
    """
    sums = sums or {}
    rows = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).persist()
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(quoted(c)).alias(f"_s{i}") for i, c in enumerate(sums.values())))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.select("_p", zero("_n").alias("_n"), *(zero(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))))
    made = rows.withColumns({name: F.row_number().over(Window.partitionBy("_part").orderBy("_at")).cast("long"), **{k: F.sum(quoted(c)).over(within) for k, c in sums.items()}})
    made = made.join(parts, F.col("_part") == F.col("_p"))
    added = {name: F.col(name) + F.col("_n"), **{k: F.col(k) + F.col(f"_s{i}") for i, k in enumerate(sums)}}
    return made.select(*(quoted(c) for c in df.columns), *(v.alias(k) for k, v in added.items()))


def order_statistics(df: DataFrame, column: str, places: Iterable[int]) -> dict[int, float]:
    """The values at the given places (from 0) of the order of a column's values, exactly: equal values are counted first."""
    places = sorted(set(places))
    counts = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = placed(counts, [F.col("v")], sums={"upto": "n"})
    row = run.agg(*(F.min(F.when(F.col("upto") > p, F.col("v"))).alias(f"p{i}") for i, p in enumerate(places))).first()
    return {p: row[f"p{i}"] for i, p in enumerate(places)}


def top(df: DataFrame, keys: str | Iterable[str], k: int, smallest: bool = False, tie: str | Iterable[str] = (), **how) -> DataFrame:
    """The k rows that a sort would put first, descending unless told; ``tie`` are further keys, ascending. Plans as a distributed top-k."""
    order = sort_columns(df, keys, default="asc" if smallest else "desc", **how)
    return df.orderBy(*order, *(sort_columns(df, tie) if tie else [])).limit(k)


def limit(df: DataFrame, n: int, order_by: str | Iterable[str] | None = None) -> DataFrame:
    return (sort(df, order_by) if order_by else df).limit(n)


def offset(df: DataFrame, n: int, order_by: str | Iterable[str] | None = None) -> DataFrame:
    return (sort(df, order_by) if order_by else df).offset(n)


def tail(df: DataFrame, n: int, order_by: str | Iterable[str]) -> DataFrame:
    """The last n rows of the order, in that order: a top-k of the reverse, then a sort of n rows."""
    keys = parse_keys(order_by)
    turned = [f"{name}:{'asc' if way == 'desc' else 'desc'}" for name, way in keys]
    return sort(df.orderBy(*sort_columns(df, turned)).limit(n), order_by)


def sample(df: DataFrame, k: int, seed: int = 0, keys: Iterable[str] | None = None) -> DataFrame:
    """k rows by the smallest seeded hashes: repeatable and distributed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *(quoted(c) for c in keys or df.columns))).limit(k)
