"""Technical indicators. Windowed ones are window expressions; recurrences are smoothed a whole batch of ordered series at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..functions import coerce as co
from ..functions.expression import quoted

SPEC = re.compile(r"^\s*(sma|ema|rsi|macd|bb|bollinger|vwap|atr)\s*(?:\(?\s*([\d\s,.]*)\)?)?\s*$", re.I)


def parse_indicator(text: str) -> tuple[str, list[float]]:
    m = SPEC.match(text.replace("_", "("))
    if not m:
        raise ArgumentError(f"not an indicator: {text!r}")
    name = {"bollinger": "bb"}.get(m[1].lower(), m[1].lower())
    return name, [float(x) for x in (m[2] or "").split(",") if x.strip()]


def rounded(x: np.ndarray, digits: int = 4) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def smoothed(x: np.ndarray, series: np.ndarray, n: int, alpha: float, carry: tuple[int, float]) -> tuple[np.ndarray, tuple[int, float]]:
    """y = alpha * x + (1 - alpha) * y before, in each series, begun by the mean of its first ``n`` values; NaN before that.

    ``series`` numbers the rows' series in order; ``carry`` says of series 0 how
    many values came in batches before, and their sum (or, from the nth on, the
    last y). The carry of the last series is returned.
    """
    if not len(x):
        return x, carry
    grouped = pd.Series(x).groupby(series, sort=False)
    before, value = carry
    goes_on = series == 0
    place = grouped.cumcount().to_numpy() + np.where(goes_on, before, 0)
    total = grouped.cumsum().to_numpy() + np.where(goes_on & (before < n), value, 0.0)
    y = np.full(len(x), np.nan)
    live = place >= n - 1
    fed, of = np.where(place == n - 1, total / n, x)[live], series[live]
    head = [value] if before >= n and series[0] == 0 else []
    if len(fed):
        fed = pd.Series(np.r_[head, fed]).groupby(np.r_[[0] * len(head), of].astype(np.int64), sort=False)
        y[live] = fed.ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(head) :]
    return y, (int(place[-1]) + 1, float(y[-1] if live[-1] else total[-1]))


def shifted(x: np.ndarray, series: np.ndarray, last: float) -> np.ndarray:
    """The value before in each series, NaN for its first; ``last``: what series 0 ended with in the batch before."""
    out = np.r_[last, x[:-1]] if len(x) else x
    out[np.r_[series[:1] != 0, series[1:] != series[:-1]]] = np.nan
    return out


START = (0, 0.0)


def ema(price, high, low, series, n, held):
    y, held["e"] = smoothed(price, series, n, 2 / (n + 1), held.get("e", START))
    return [rounded(y)]


def macd(price, high, low, series, n, held):
    fast, slow, signal = n
    one, held["fast"] = smoothed(price, series, fast, 2 / (fast + 1), held.get("fast", START))
    two, held["slow"] = smoothed(price, series, slow, 2 / (slow + 1), held.get("slow", START))
    gap = rounded(one) - rounded(two)
    warm = ~np.isnan(gap)
    line = np.full(len(gap), np.nan)
    line[warm], carry = smoothed(gap[warm], series[warm], signal, 2 / (signal + 1), held.get("signal", START) if len(series) and series[0] == 0 else START)
    # a series that is still warming up has no signal yet
    held["signal"] = carry if warm.any() and series[warm][-1] == series[-1] else held.get("signal", START) if len(series) and series[-1] == 0 else START
    line = rounded(line)
    return [rounded(gap), line, rounded(gap - line)]


def rsi(price, high, low, series, n, held):
    change = price - shifted(price, series, held.get("price", np.nan))
    moved = ~np.isnan(change)
    out = np.full(len(price), np.nan)
    up, down = np.maximum(change[moved], 0), np.maximum(-change[moved], 0)
    of = series[moved]
    alone = len(series) > 0 and (not moved.any() or of[-1] != series[-1])  # the last series has one value so far
    sides = []
    for k, side in (("up", up), ("down", down)):
        y, carry = smoothed(side, of, n, 1 / n, held.get(k, START))
        held[k] = START if alone and series[-1] != 0 else carry
        sides.append(y)
    up, down = sides
    with np.errstate(divide="ignore", invalid="ignore"):
        out[moved] = np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, rounded(100 - 100 / (1 + up / down), 2)))
    if len(price):
        held["price"] = price[-1]
    return [out]


def atr(price, high, low, series, n, held):
    before = shifted(price, series, held.get("price", np.nan))
    reach = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    y, held["a"] = smoothed(reach, series, n, 1 / n, held.get("a", START))
    if len(price):
        held["price"] = price[-1]
    return [rounded(y)]


def indicators(df: DataFrame, specs: Iterable[str], price: str, order_by: str, by: Iterable[str] = (), volume: str | None = None, high: str | None = None, low: str | None = None) -> DataFrame:
    """Adds sma_n, ema_n, rsi_n, macd, macd_signal, macd_hist, bb_middle, bb_upper, bb_lower, bb_bandwidth, vwap, atr_n; null while warming up.

    A series (``by``) is read in order by one task, one batch at a time, so its
    length does not matter for memory.
    """
    by = [by] if isinstance(by, str) else list(by)
    number = lambda c: co.parse_float(quoted(c), co.kind_of(df.schema[c].dataType))
    w = Window.partitionBy(*(quoted(c) for c in by)).orderBy(order_by)
    p, out, recurrent = number(price), df, []
    for name, args in map(parse_indicator, specs):
        if name == "sma":
            n = int(args[0]) if args else 20
            f = w.rowsBetween(1 - n, 0)
            out = out.withColumn(f"sma_{n}", F.when(F.count(p).over(f) == n, co.half_up(F.avg(p).over(f), 4)))
        elif name == "bb":
            n, k = (int(args[0]) if args else 20), (args[1] if len(args) > 1 else 2.0)
            f = w.rowsBetween(1 - n, 0)
            full, mean, sd = F.count(p).over(f) == n, F.avg(p).over(f), F.stddev_pop(p).over(f)
            out = out.withColumns({"bb_middle": F.when(full, co.half_up(mean, 4)), "bb_upper": F.when(full, co.half_up(mean + sd * k, 4)), "bb_lower": F.when(full, co.half_up(mean - sd * k, 4)), "bb_bandwidth": F.when(full, F.when(mean != 0, co.half_up(sd * 2 * k / mean * 100, 2)).otherwise(0.0))})
        elif name == "vwap":
            if volume is None:
                raise ArgumentError("vwap needs a volume column")
            v = F.greatest(F.coalesce(number(volume), F.lit(0.0)), F.lit(0.0))
            f = w.rowsBetween(Window.unboundedPreceding, 0)
            total = F.sum(v).over(f)
            out = out.withColumn("vwap", F.when(total > 0, co.half_up(F.sum(p * v).over(f) / total, 4)).otherwise(p))
        else:
            recurrent.append((name, [int(x) for x in args]))
    return _recurrent(out, recurrent, price, order_by, by, high, low) if recurrent else out


def _recurrent(df: DataFrame, specs: list[tuple[str, list[int]]], price: str, order_by: str, by: list[str], high: str | None, low: str | None) -> DataFrame:
    names, parts = [], []
    for name, args in specs:
        if name == "macd":
            names += ["macd", "macd_signal", "macd_hist"]
            parts.append((macd, [*args, *(12, 26, 9)[len(args) :]]))
        else:
            n = args[0] if args else {"ema": 20}.get(name, 14)
            names.append(f"{name}_{n}")
            parts.append(({"ema": ema, "rsi": rsi, "atr": atr}[name], n))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, [{} for _ in parts]
        for b in batches:
            made = np.full((len(b), len(names)), np.nan)
            prices = pd.to_numeric(b[price], errors="coerce").to_numpy(np.float64)
            good = ~np.isnan(prices)
            if good.any():
                rows = b[good]
                highs, lows = (pd.to_numeric(rows[c], errors="coerce").to_numpy(np.float64) if c else prices[good] for c in (high, low))
                new = np.zeros(len(rows), bool)
                for c in by:
                    new[1:] |= ~((rows[c].to_numpy()[1:] == rows[c].to_numpy()[:-1]) | (rows[c].isna().to_numpy()[1:] & rows[c].isna().to_numpy()[:-1]))
                key = [None if pd.isna(v) else v for v in rows[by].iloc[0]] if by else []
                # series 0 is the one that the batch before ended with
                series = np.cumsum(new) + (last is not None and key != last)
                if last is None or key != last:
                    held = [{} for _ in parts]
                series = series if last is not None else series + 1
                at = 0
                for (f, n), state in zip(parts, held, strict=True):
                    for y in f(prices[good], highs, lows, series, n, state):
                        made[good, at] = y
                        at += 1
                last = [None if pd.isna(v) else v for v in rows[by].iloc[-1]] if by else []
            yield pd.concat([b, pd.DataFrame(made, columns=names, index=b.index)], axis=1)

    dealt = df.repartition(*(quoted(c) for c in by)) if by else df.coalesce(1)
    return dealt.sortWithinPartitions(*(quoted(c) for c in by), order_by).mapInPandas(run, schema)
