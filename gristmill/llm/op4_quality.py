"""Quality scores by a generalised additive model with pairwise interactions.

Features are statistics of the text's bytes. Each is cut into bins, and cyclic
boosting visits the features in turn: a shallow tree over one feature's bins
adds a small step to that feature's table. Then the pairs of features whose
residuals interact most get two-dimensional tables in the same way. A score is
the sum of the tables' entries, which are looked up for all rows at once.

One pass reads the texts and writes the features; the model is fitted on a
bounded sample of labelled rows of the training folds, by default at most
20,000 (``labelled.MOST_LABELLED``), and is a few hundred kilobytes.

Defined results: null and empty texts have all features zero and a score like
any other; a row whose id has several labels is fitted with each; repeated rows
get equal scores; without labels of both classes every score is their share
(0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MOST_LABELLED, fold, sampled
from .store import materialize, tidy
from .textops import buffers, chunks, word_hashes, spans

FOLDS, CUT, BINS = 5, 0.3, 32
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "lower", "upper", "digit", "blank", "line_ends", "ascii_marks", "wide",
    "marks_run", "distinct_words", "distinct_pairs", "top_word", "line_repeats", "short_words", "long_words", "no_letter_words",
    "stops", "commas", "bars", "bangs", "symbols", "brackets", "capitals", "upper_words", "mark_ends", "log_lines", "line_words", "links",
]

_kind = np.zeros(256, np.uint8)  # 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 mark, 6 part of a wide character
_kind[0x61:0x7B], _kind[0x41:0x5B], _kind[0x30:0x3A], _kind[0x80:] = 1, 2, 3, 6
_kind[[0x20, *range(9, 14)]] = 4
for _a, _b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
    _kind[_a:_b] = 5
LINE_END = np.ones(256, bool)
LINE_END[:] = False
LINE_END[0x0A] = True


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, len(FEATURES)) of the texts data[off[i]:off[i + 1]]."""
    out = np.zeros((len(off) - 1, len(FEATURES)), np.float32)
    s, e, first = spans(data, off)
    h, _ = word_hashes(data, off, fold=True)
    line_hash, line_first = word_hashes(data, off, sep=LINE_END)
    seg = data[off[0] : off[-1]]
    kind = _kind[seg]
    for r in range(len(out)):
        a, b = off[r] - off[0], off[r + 1] - off[0]
        if a == b:
            continue
        n, x, k = b - a, seg[a:b], kind[a:b]
        count = np.bincount(k, minlength=7)
        byte = np.bincount(x, minlength=256)
        i, j = first[r], first[r + 1]
        words, size, own = j - i, (e - s)[i:j], h[i:j]
        lines = line_first[r + 1] - line_first[r]
        if words:
            head, tail = kind[s[i:j]], kind[e[i:j] - 1]
            uniq, times = np.unique(own, return_counts=True)
            letters = np.add.reduceat(np.r_[np.isin(k, (1, 2, 6)), False], s[i:j] - a)
            capitals = np.add.reduceat(np.r_[k == 2, False], s[i:j] - a)
            pair = own[:-1] * np.uint64(3) + own[1:] if words > 1 else own
            out[r, [1, 2, 11, 12, 13, 15, 16, 17, 24, 25, 26, 28]] = (
                np.log1p(words), size.mean(), len(uniq) / words, len(np.unique(pair)) / len(pair), times.max() / words, (size <= 3).mean(), (size > 14).mean(), (letters == 0).mean(),
                (head == 2).mean(), ((capitals == size) & (size > 1)).mean() + ((capitals > 1) & (capitals >= letters)).mean(), ((tail == 5) & (size > 1)).mean(), words / max(1, lines),
            )
        out[r, [0, 3, 4, 5, 6, 7, 8, 9, 10, 14]] = (
            np.log1p(n), count[1] / n, count[2] / n, count[3] / n, count[4] / n, byte[0x0A] / n, count[5] / n, count[6] / n,
            ((k[1:] == 5) & (k[:-1] == 5)).mean() if n > 1 else 0, 1 - _share(len(np.unique(line_hash[line_first[r] : line_first[r + 1]])), lines) if lines else 0,
        )
        out[r, [18, 19, 20, 21, 22, 23, 27, 29]] = (
            _share(byte[0x2E], words), _share(byte[0x2C], words), _share(byte[0x7C], words), _share(byte[0x21], words), _share(byte[[0x23, 0x24, 0x25, 0x26, 0x2A, 0x7E, 0x5E, 0x40]].sum(), words),
            _share(byte[[0x28, 0x29, 0x3C, 0x3E, 0x5B, 0x5D, 0x7B, 0x7D]].sum(), words), np.log1p(lines), _share(byte[0x2F], words),
        )
    return out


class Additive:
    """Lookup tables of single features and of pairs; ``decision`` adds their entries."""

    def __init__(self, bins: int = BINS, coarse: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 10, rate: float = 0.1, leaves: int = 4, smooth: float = 4.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs = bins, coarse, rounds, pair_rounds, pairs
        self.rate, self.leaves, self.smooth = rate, leaves, smooth

    def _cells(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(edges)], axis=1)

    def _step(self, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A shallow tree over the ordered bins: the best cuts, greedily; its values are shrunken Newton steps."""
        cuts, size = [0, len(g)], len(g)
        G, W = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(w)]
        gain = lambda a, b: (G[b] - G[a]) ** 2 / (W[b] - W[a] + self.smooth)
        for _ in range(self.leaves - 1):
            best = (1e-9, None)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    c = np.arange(a + 1, b)
                    v = gain(a, c) + gain(c, b) - gain(a, b)
                    k = int(np.argmax(v))
                    best = max(best, (float(v[k]), int(c[k])), key=lambda z: z[0])
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(size)
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = (G[b] - G[a]) / (W[b] - W[a] + self.smooth)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        share = float(y.mean()) if len(y) else 0.5
        self.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        d = x.shape[1]
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], q)) if len(x) else np.zeros(0) for j in range(d)]
        self.edges2 = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.coarse + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
        self.tables, self.pairs, self.tables2 = np.zeros((d, self.bins)), [], []
        if not len(y) or y.min() == y.max():
            return self
        cell, f = self._cells(x, self.edges), np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * self._step(np.bincount(cell[:, j], y - p, self.bins), np.bincount(cell[:, j], p * (1 - p), self.bins))
                self.tables[j] += step
                f += step[cell[:, j]]
        cell2, n = self._cells(x, self.edges2), self.coarse
        p = 1 / (1 + np.exp(-f))
        gains = []
        for a, b in combinations(range(d), 2):
            both = cell2[:, a] * n + cell2[:, b]
            gains.append(((np.bincount(both, y - p, n * n) ** 2 / (np.bincount(both, p * (1 - p), n * n) + self.smooth)).sum(), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[: self.n_pairs]]
        self.tables2 = [np.zeros(n * n) for _ in self.pairs]
        both = [cell2[:, a] * n + cell2[:, b] for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for t, c in zip(self.tables2, both, strict=True):
                p = 1 / (1 + np.exp(-f))
                step = self.rate * np.bincount(c, y - p, n * n) / (np.bincount(c, p * (1 - p), n * n) + self.smooth)
                t += step
                f += step[c]
        return self

    def decision(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        cell = self._cells(x, self.edges)
        for j in range(x.shape[1]):
            out += self.tables[j][cell[:, j]]
        if self.pairs:
            cell2 = self._cells(x, self.edges2)
            for (a, b), t in zip(self.pairs, self.tables2, strict=True):
                out += t[cell2[:, a] * self.coarse + cell2[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.decision(x), -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b["text"])
        rows = [features(data, off[i : j + 1]) for i, j in chunks(off)]
        raw = [x.tobytes() for part in rows for x in part]
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(raw, pa.binary())], names=["id", "x"])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(own.mapInArrow(_features, "id long, x binary"), "quality-features")


def fit(table: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS, most: int = MOST_LABELLED) -> Additive:
    """Fit on labelled rows of the folds other than 0; ``labels`` has doc_id and ``label_col``."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null").distinct()
    known = sampled(known.filter(fold("id", folds) != 0), "id", most)
    rows = table.join(known, "id").groupBy("id", "y").agg(F.min("x").alias("x")).toPandas().sort_values(["id", "y"])  # at most about `most` rows
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    return Additive().fit(x, rows["y"].to_numpy(np.float64))


@tidy
def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, cut: float = CUT, most: int = MOST_LABELLED) -> DataFrame:
    """id, held_out, score, predicted; one row per row of ``docs``."""
    table = feature_table(docs, id_col, text_col)
    model = fit(table, labels, label_col, folds, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b["x"].to_pylist()), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(model.score(x))], names=["id", "score"])

    scored = table.mapInArrow(run, "id long, score double")
    held = F.coalesce(fold("id", folds) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


@tidy
def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, cut: float = CUT, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, with all their columns; rows are scored where they are read."""
    # features of all rows, joined with the labels, are far smaller than the labelled rows' texts
    model = fit(feature_table(docs, id_col, text_col), labels, label_col, folds, most)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(at))
            x = [features(data, off[i : j + 1]) for i, j in chunks(off)]
            if x:
                yield b.filter(pa.array(model.score(np.concatenate(x).astype(np.float64)) >= cut))

    return docs.mapInArrow(run, docs.schema)
