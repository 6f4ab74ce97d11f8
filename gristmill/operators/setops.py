"""Union of data sets with different columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.expression import quoted


def concat(frames: list[DataFrame], align: str = "union", source_col: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """All rows of all frames by column name; ``align``: union (missing columns are null) or intersect (common columns)."""
    if not frames:
        raise ArgumentError("nothing to concatenate")
    if align not in ("union", "intersect"):
        raise ArgumentError(f"unknown alignment {align!r}")
    if align == "intersect":
        common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
        frames = [f.select(*(quoted(c) for c in common)) for f in frames]
    if source_col:
        names = labels or [f"source_{i + 1}" for i in range(len(frames))]
        frames = [f.withColumn(source_col, F.lit(n)) for f, n in zip(frames, names, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: list[DataFrame], align: str = "union") -> DataFrame:
    return concat(frames, align).distinct()
