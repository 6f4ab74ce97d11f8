"""What the classifiers share: folds, a bounded sample of labelled rows, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on; they are chosen by a hash of the id, so the sample does not depend on order.
MOST_LABELLED = 20_000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def sampled(df: DataFrame, id_col: str, most: int = MOST_LABELLED) -> DataFrame:
    """At most about ``most`` rows, those with the smallest hashes of their ids; all of them if there are no more."""
    total = df.count()
    if total <= most:
        return df
    share = int(most / total * 2**32)
    return df.filter(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(2**32)) < share)


def calibration(score: np.ndarray, label: np.ndarray, favour: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns a score into a probability (Platt's smoothed targets, Newton steps). ``favour``: how much more a positive row weighs."""
    pos, neg = label.sum(), (1 - label).sum()
    share = np.where(label > 0, favour, 1.0)
    t = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mid, wide = float(np.median(score)), float(np.std(score)) or 1.0
    x = np.stack([(score - mid) / wide, np.ones(len(score))], axis=1)
    w = np.array([1.0, np.log((pos + 1) / (neg + 1))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((share * (np.logaddexp(0, z) - t * z)).sum() + 5e-3 * w[0] ** 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - t)) + [1e-2 * w[0], 0]
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(float(w[0]) / wide, 1e-3)
    return slope, float(w[1]) - slope * mid
