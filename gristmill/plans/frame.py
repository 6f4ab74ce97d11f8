"""A fluent wrapper of one DataFrame with every operator as a method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.expression import compile_value
from ..operators import aggregate, business, cluster, diff, finance, joins, ordering, profile, rows, setops, statistics, text, timeseries, windows
from ..sources import readers, writers

#: Method -> operator whose first argument is the DataFrame and whose result is one.
OPERATORS: dict[str, Callable] = {
    "filter": rows.filter_rows, "select": rows.select_columns, "map": rows.derive, "map_rows": rows.map_rows, "rename": rows.rename, "cast": rows.cast, "clean": rows.clean, "explode": rows.explode, "flatten": rows.flatten, "mask": rows.mask,
    "sort": ordering.sort, "top": ordering.top, "limit": ordering.limit, "offset": ordering.offset, "tail": ordering.tail, "sample": ordering.sample,
    "reduce": aggregate.reduce_rows, "group": aggregate.group, "count_rows": aggregate.count, "frequencies": aggregate.frequencies, "unique": aggregate.unique, "pivot": aggregate.pivot, "unpivot": aggregate.unpivot,
    "window": windows.window, "resample": timeseries.resample, "stats": profile.numeric_stats, "string_stats": profile.string_stats, "infer_schema": profile.infer_schema, "profile": profile.profile, "validate": profile.validate, "data_tests": profile.data_tests,
    "quantiles": profile.quantiles, "histogram": profile.histogram, "correlation": statistics.correlation, "regression": statistics.regression, "outliers": statistics.outliers, "crosstab": statistics.crosstab, "entropy": statistics.entropy,
    "rfm": business.rfm, "cohorts": business.cohorts, "funnel": business.funnel, "ab_test": business.ab_test, "pareto": business.pareto, "indicators": finance.indicators, "ngrams": text.ngrams, "assign_clusters": cluster.assign,
}
#: What needs all rows, and so cannot run on a stream.
GLOBAL = {"sort", "top", "tail", "sample", "pivot", "offset", "limit"}
MEMORY = {"sort": "spillable", "unique": "spillable", "group": "spillable", "reduce": "spillable", "join": "spillable", "diff": "spillable", "pivot": "spillable", "top": "bounded", "tail": "bounded", "sample": "bounded", "window": "spillable"}


class Frame:
    def __init__(self, df: DataFrame, steps: tuple[tuple[str, tuple, dict], ...] = ()):
        self.df, self.steps = df, steps

    @classmethod
    def read(cls, spark: SparkSession, path, **options) -> Frame:
        return cls(readers.read(spark, path, **options))

    @classmethod
    def rows(cls, spark: SparkSession, data, schema=None) -> Frame:
        return cls(spark.createDataFrame(data, schema))

    def _next(self, name: str, df: DataFrame, args: tuple = (), how: dict | None = None) -> Frame:
        return Frame(df, (*self.steps, (name, args, how or {})))

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in OPERATORS:
            raise AttributeError(name)

        def run(*args, **how) -> Frame:
            if self.df.isStreaming and name in GLOBAL:
                raise ValueError(f"{name} needs all rows and cannot run on a stream")
            return self._next(name, OPERATORS[name](self.df, *args, **how), args, how)

        return run

    def join(self, other: Frame | DataFrame, *args, **how) -> Frame:
        return self._next("join", joins.join(self.df, getattr(other, "df", other), *args, **how), args, how)

    def fuzzy_join(self, other: Frame | DataFrame, *args, **how) -> Frame:
        return self._next("fuzzy_join", joins.fuzzy_join(self.df, getattr(other, "df", other), *args, **how), args, how)

    def concat(self, *others: Frame | DataFrame, **how) -> Frame:
        return self._next("concat", setops.concat([self.df, *(getattr(o, "df", o) for o in others)], **how), (), how)

    def diff(self, other: Frame | DataFrame, *args, **how) -> Frame:
        return self._next("diff", diff.diff(self.df, getattr(other, "df", other), *args, **how), args, how)

    def pipe(self, f: Callable, *args, **how) -> Frame:
        return self._next(getattr(f, "__name__", "pipe"), self.df.transform(f, *args, **how), args, how)

    def observed(self, specs: str = "rows = count()"):
        """The frame and an observation: aggregates of the rows that passed this point, known once an action has run. Costs no pass of its own."""
        from pyspark.sql import Observation

        seen = Observation()
        made = [aggregate.aggregate(fn, compile_value(arg, self.df.schema) if arg else None).alias(alias) for alias, fn, arg in aggregate.parse_specs(specs)]
        return self._next("observed", self.df.observe(seen, *made), (specs,)), seen

    def to(self, path: str, **options) -> None:
        writers.write(self.df, path, **options)

    def to_list(self, most: int = 10_000) -> list[dict]:
        return writers.collect(self.df, most)

    def count(self) -> int:
        return self.df.count()

    def preview(self, n: int = 5) -> dict:
        return writers.preview(self.df, n)

    def explain(self, physical: bool = True) -> str:
        """The steps with what each needs to hold, and Spark's plan."""
        lines = [f"{i}. {name}({', '.join([*map(repr, a), *(f'{k}={v!r}' for k, v in h.items())])})  [{MEMORY.get(name, 'streaming')}]" for i, (name, a, h) in enumerate(self.steps, 1)]
        if physical:
            lines.append(self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(lines)


#: Order in which the one-shot pipeline applies its options, whatever order they are given in.
ORDER = ("flatten", "explode", "filter", "map", "window", "rename", "cast", "select", "unique", "group", "sort", "top", "offset", "limit", "tail")


def pipeline(frame: Frame, **options) -> Frame:
    """Apply options in the fixed order; each value is the operator's first argument, a dict of named ones, or a list of positional ones."""
    unknown = set(options) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown step {sorted(unknown)[0]!r}")
    for name in ORDER:
        if name in options and options[name] is not None:
            v = options[name]
            f = getattr(frame, name)
            frame = f() if v is True else f(*v) if isinstance(v, list) and name in ("offset", "limit", "tail", "top") else f(**v) if isinstance(v, dict) and name not in ("map", "rename", "cast", "window") else f(v)
    return frame
