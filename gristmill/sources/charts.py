"""Bars, histograms and sparklines as text, from small aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.profile import histogram

BLOCKS = "▁▂▃▄▅▆▇█"


def bar_chart(items: list[tuple[str, float]], width: int = 30) -> str:
    most = max((v for _, v in items), default=0) or 1
    label = max((len(str(k)) for k, _ in items), default=0)
    return "\n".join(f"{str(k).rjust(label)}  {'█' * round(width * max(v, 0) / most)}  {v:g}" for k, v in items)


def sparkline(values: list[float]) -> str:
    low, high = min(values, default=0), max(values, default=0)
    return "".join(BLOCKS[int((v - low) / (high - low) * 7)] if high > low else BLOCKS[0] for v in values)


def histogram_chart(df: DataFrame, column: str, bins: int = 10, width: int = 30) -> str:
    rows = histogram(df, column, bins).orderBy("bin").collect()  # at most 50 bins
    return bar_chart([(f"{r.low:.1f} - {r.high:.1f}", r["count"]) for r in rows], width) if rows else "no numbers"
