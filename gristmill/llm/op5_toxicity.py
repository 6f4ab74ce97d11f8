"""Toxicity scores by a convolutional text classifier.

Words (runs of letters, A-Z as a-z) are hashed into a table of embeddings; a
word's embedding is the sum of its own and those of its stems, its first four to
eight bytes where it is longer, so that inflected forms share what was learned.
Filters of several widths slide over the embedded words, each keeps its largest
response in the text, and a logistic unit adds these up. The network is trained
in numpy with Adam; one channel of the embeddings starts from the words' shrunk
log odds in the training rows.

The scores are calibrated by language on training rows that the network was
not fitted on: a logistic curve each, whose threshold is 0.5. Language here is
a guess from the text's own words, so that no column but the text enters a
score.

The fit uses at most MOST labelled rows of the training folds (whole texts);
everything else covers all rows. Defined results: null and empty texts have no
words and a score like any other text; without labels of both classes every
score is their share (0 without any); repeated rows get equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import calibration, fold, sampled
from .textops import NO_LETTER, buffers, chunks, word_hashes

FOLDS, CUT, MOST, FAVOUR = 5, 0.5, 12_000, 3.0
BUCKETS, WIDTH, FILTERS, WIDTHS, STEMS = 1 << 18, 8, 8, (1, 2, 3), (4, 5, 6, 7, 8)
PAD = BUCKETS  # zeros: between texts, and for stems that a word does not have


def _bucket(h: np.ndarray) -> np.ndarray:
    return np.where(h == 0, PAD, (h >> np.uint64(40)).astype(np.int64) % BUCKETS)


def word_ids(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    h, first = word_hashes(data, off, fold=True, sep=NO_LETTER, stems=STEMS)
    ids = _bucket(h)
    return [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


class Words(Sequence):
    """The word ids of many texts, held as places in a table of distinct words: four bytes a word instead of eight for each of its ids."""

    def __init__(self, table: np.ndarray | None = None, places: list[np.ndarray] | None = None):
        self.table = np.zeros((0, 1 + len(STEMS)), np.int32) if table is None else table
        self.places, self.known = places or [], {}

    def add(self, data: np.ndarray, off: np.ndarray) -> None:
        h, first = word_hashes(data, off, fold=True, sep=NO_LETTER, stems=STEMS)
        if len(h):
            keys, at, of = np.unique(h[:, 0], return_index=True, return_inverse=True)
            new = [i for i, k in enumerate(keys.tolist()) if k not in self.known]
            self.known.update(zip(keys[new].tolist(), range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, _bucket(h[at[new]]).astype(np.int32)])
            places = np.array([self.known[k] for k in keys.tolist()], np.int32)[of]
        else:
            places = np.zeros(0, np.int32)
        self.places += [places[a:b].copy() for a, b in zip(first[:-1], first[1:], strict=True)]

    def take(self, which: np.ndarray) -> Words:
        return Words(self.table, [self.places[i] for i in which])

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i):
        return [self.table[p] for p in self.places[i]] if isinstance(i, slice) else self.table[self.places[i]]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words with pads after each, and where each text begins."""
    gap = np.full((max(WIDTHS), 1 + len(STEMS)), PAD, np.int32)
    start = np.cumsum([0, *(len(t) + len(gap) for t in texts[:-1])])
    return np.concatenate([x for t in texts for x in (t, gap)]), start


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.05, (BUCKETS + 1, WIDTH)), "out": np.full(len(WIDTHS) * FILTERS, 0.3), "bias": np.zeros(1)}
        self.p["e"][PAD] = 0
        for w in WIDTHS:
            k = r.normal(0, 0.3 / np.sqrt(w), (w, WIDTH, FILTERS))
            k[:, 0, :] = np.abs(k[:, 0, :]) + 0.5 / w
            self.p[f"k{w}"], self.p[f"b{w}"] = k, np.full(FILTERS, -0.2)
        self.base, self.fitted = None, False
        self.curve: dict[int, tuple[float, float]] = {}
        self.lang = np.zeros((BUCKETS + 1, 0), np.float32)

    def forward(self, ids: np.ndarray, start: np.ndarray, keep: bool = False):
        x = self.p["e"][ids[:, 0]]
        for c in range(1, ids.shape[1]):
            x = x + self.p["e"][ids[:, c]]
        pooled, where = [], []
        for w in WIDTHS:
            y = x @ self.p[f"k{w}"][0]
            for j in range(1, w):
                y[:-j] += (x @ self.p[f"k{w}"][j])[j:]
            y += self.p[f"b{w}"]
            top = np.maximum.reduceat(y, start, axis=0)
            if keep:
                size = np.diff(np.r_[start, len(ids)])
                row, col = np.nonzero(y == np.repeat(top, size, axis=0))
                doc = np.repeat(np.arange(len(start)), size)[row]
                at = np.zeros(top.shape, np.int64)
                at[doc[::-1], col[::-1]] = row[::-1]  # the first place
                where.append(at)
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["out"] + self.p["bias"][0]
        return (z, h, where, x) if keep else z

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        share = float(y.mean()) if len(y) else 0.0
        if share in (0.0, 1.0):
            self.base = share
            return
        self.fitted = True
        self.start(texts, y)
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros(x.shape, np.float32) for k, x in self.p.items()}, {k: np.zeros(x.shape, np.float32) for k, x in self.p.items()}, 0
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(max(epochs, min(30, 30_000 // len(y)))):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                ids, start = _joined([texts[i] for i in pick])
                z, h, where, x = self.forward(ids, start, keep=True)
                dz = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                g, used, ge = self.gradient(ids, dz, h, where, x)
                t += 1
                scale = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k, a in g.items():
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.001 * (a * a - v[k])
                    self.p[k] -= scale * m[k] / (np.sqrt(v[k]) + 1e-8)
                m["e"][used] += 0.1 * (ge - m["e"][used])
                v["e"][used] += 0.001 * (ge * ge - v["e"][used])
                self.p["e"][used] -= 0.3 * scale * m["e"][used] / (np.sqrt(v["e"][used]) + 1e-8)
                self.p["e"][PAD] = 0

    def gradient(self, ids: np.ndarray, dz: np.ndarray, h: np.ndarray, where: list[np.ndarray], x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of all parameters but the embeddings, then the rows of these that are used and their gradients; ``dz``: the loss's for each text."""
        g = {k: np.zeros_like(a) for k, a in self.p.items() if k != "e"}
        g["out"], g["bias"] = h.T @ dz + 1e-4 * self.p["out"], dz.sum(keepdims=True)
        rows, grads = [], []
        for n, w in enumerate(WIDTHS):
            own = slice(n * FILTERS, (n + 1) * FILTERS)
            dh = dz[:, None] * self.p["out"][own] * (h[:, own] > 0)
            g[f"b{w}"] = dh.sum(axis=0)
            for j in range(w):
                place = np.minimum(where[n] + j, len(ids) - 1)  # (texts, filters)
                g[f"k{w}"][j] = np.einsum("df,dfe->ef", dh, x[place])
                back = (dh[:, :, None] * self.p[f"k{w}"][j].T[None]).reshape(-1, WIDTH)
                for c in range(ids.shape[1]):
                    rows.append(ids[place, c].reshape(-1))
                    grads.append(back)
        used, at = np.unique(np.concatenate(rows), return_inverse=True)
        ge = np.zeros((len(used), WIDTH))
        np.add.at(ge, at, np.concatenate(grads))
        return g, used, ge

    def start(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """The first channel: each word's and stem's log odds between the classes, shrunk by how few texts have it."""
        n = np.zeros((2, BUCKETS + 1))
        for t, label in zip(texts, y, strict=True):
            n[int(label), np.unique(t)] += 1
        n = n[:, :BUCKETS]
        rate = (n + 0.5) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 1)
        seen = n.sum(axis=0)
        self.p["e"][:BUCKETS, 0] = np.log(rate[1] / rate[0]) * seen / (seen + 8) / (1 + len(STEMS)) * 2

    def learn_languages(self, texts: list[np.ndarray], langs: list[str | None]) -> None:
        names = sorted({x for x in langs if x is not None})
        n = np.full((BUCKETS + 1, len(names)), 0.1)
        for t, lang in zip(texts, langs, strict=True):
            if lang is not None:
                np.add.at(n[:, names.index(lang)], t[:, 0], 1)
        n = np.log(n / n.sum(axis=0))
        n[PAD] = 0
        self.lang = n.astype(np.float32)

    def guesses(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        if not self.lang.shape[1]:
            return np.zeros(len(start), np.int64)
        return np.add.reduceat(self.lang[ids[:, 0]], start, axis=0).argmax(axis=1)

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray, least: int = 15) -> None:
        """A curve for each guessed language with enough rows of both classes; one for all others."""
        if not self.fitted or not len(y) or y.min() == y.max():
            return
        parts = (_joined(texts[at : at + 64]) for at in range(0, len(texts), 64))
        z, guess = map(np.concatenate, zip(*((self.forward(*p), self.guesses(*p)) for p in parts), strict=True))
        self.curve = {-1: calibration(z, y, FAVOUR)}
        for lang in np.unique(guess):
            own = guess == lang
            if min(y[own].sum(), (1 - y[own]).sum()) >= least:
                self.curve[int(lang)] = calibration(z[own], y[own], FAVOUR)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.base or 0.0)
        ids, start = _joined(texts)
        z = self.forward(ids, start)
        if self.curve:
            slope, offset = np.array([self.curve.get(int(k), self.curve[-1]) for k in self.guesses(ids, start)]).T
            z = slope * z + offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def packed(self) -> Network:
        """32-bit, for scoring."""
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", folds: int = FOLDS, most: int = MOST) -> Network:
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null").distinct()
    known = sampled(known.filter(fold("id", folds) != 0), "id", most)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))

    # the join keeps at most about `most` rows; their texts are smaller than their words' numbers
    rows = own.join(known, "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("x")).select("id", "x.lang", "y", "x.text").toPandas().sort_values(["id", "y"])
    data, off = buffers(pa.array(rows.pop("text"), pa.string()))
    texts = Words()
    for i, j in chunks(off):
        texts.add(data, off[i : j + 1])
    del data, off
    y, langs = rows["y"].to_numpy(np.float64), [x if isinstance(x, str) else None for x in rows["lang"]]
    model = Network()
    aside = np.random.default_rng(2).random(len(y)) < 0.25
    fitted = np.flatnonzero(~aside) if len(set(y[~aside])) == 2 else np.arange(len(y))
    model.learn_languages(texts, langs)
    model.fit(texts.take(fitted), y[fitted])
    model.calibrate(texts.take(np.flatnonzero(aside)), y[aside])
    return model.packed()


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", folds: int = FOLDS, cut: float = CUT, most: int = MOST) -> DataFrame:
    """id, held_out, score, predicted; one row per row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, label_col, lang_col, folds, most)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            data, off = buffers(b["text"])
            score = [model.score(word_ids(data, off[i : j + 1])) for i, j in chunks(off, 1 << 18)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.concatenate(score or [np.zeros(0)]).astype(np.float64))], names=["id", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = own.mapInArrow(run, "id long, score double")
    out = F.coalesce(fold("id", folds) == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
