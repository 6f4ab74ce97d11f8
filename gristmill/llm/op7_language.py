"""Language identification with hyperdimensional profiles.

Each letter (code point, in lower case) has a random vector of +1 and -1, made
from the code point and a seed. A trigram's vector binds the vectors of its
letters, the first rotated twice and the second once; a text's vector bundles
(adds) those of all its trigrams, and a language's prototype those of all texts
of the language. A text gets the language whose prototype has the largest cosine
with its vector.

Prototypes are bundled where the texts are and added up per language in Spark:
WIDTH numbers a language reach the driver.

Defined results: null texts and texts without a letter are `und` with score 0;
a text whose letters make no known profile gets the first language; without any
training row every text is `und`; repeated rows get equal results; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, classes
from .labelled import fold
from .textops import chunks, mix

WIDTH, SEED, FOLDS, HELD = 1024, 7, 4, 2
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BATCH = 128

_symbols: np.ndarray | None = None
_rows = np.full(0x110000, -1, np.int32)  # where a code point's vector is
_letters = np.zeros((0, WIDTH), np.int8)


def symbols() -> np.ndarray:
    """A symbol for each code point: 0 for what is no letter, and the lower case's code point for letters."""
    global _symbols
    if _symbols is None:
        table = np.zeros(0x110000, np.int32)
        letters = np.flatnonzero(classes() == LETTER)
        table[letters] = [ord(chr(c).lower()[0]) for c in letters]
        _symbols = table
    return _symbols


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """(len, WIDTH) vectors of code points, made when first used."""
    global _letters
    new = np.unique(points[_rows[points] < 0])
    if len(new):
        with np.errstate(over="ignore"):
            words = mix((new.astype(np.uint64)[:, None] * np.uint64(WIDTH // 64) + np.arange(WIDTH // 64, dtype=np.uint64)) * SPREAD + np.uint64(SEED))
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        _rows[new] = len(_letters) + np.arange(len(new))
        _letters = np.concatenate([_letters, bits.astype(np.int8) * 2 - 1])
    return _letters[_rows[points]]


def vectors(trigrams: np.ndarray) -> np.ndarray:
    """(len, WIDTH) bound vectors of trigrams."""
    a, b, c = (letter_vectors(trigrams >> shift & 0x1FFFFF) for shift in (42, 21, 0))
    return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c


def trigrams(texts: list[str]) -> list[np.ndarray]:
    """Trigrams of each text, three code points in a number; runs of other characters are one boundary."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    every, cut = symbols()[cp], np.cumsum([0, *map(len, texts)])
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        s = every[a:b]
        if not s.any():
            out.append(np.zeros(0, np.int64))
            continue
        s = np.r_[0, s, 0]
        s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]].astype(np.int64)
        out.append(s[:-2] << 42 | s[1:-1] << 21 | s[2:])
    return out


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, [t or "" for t in part["text"].to_pylist()]


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of all texts of each language, one row each."""
    total: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["lang", "sum"])
        total.clear()

    for part, texts in _pieces(batches, 256):
        by: dict[str, list[np.ndarray]] = {}
        for lang, t in zip(part["lang"].to_pylist(), trigrams(texts), strict=True):
            by.setdefault(lang, []).append(t)
        for lang, found in by.items():
            own = total.setdefault(lang, np.zeros(WIDTH, np.int64))
            used, n = np.unique(np.concatenate(found), return_counts=True)
            for at in range(0, len(used), 8192):
                # whole numbers far below 2 ** 53
                own += (n[at : at + 8192].astype(np.float64) @ vectors(used[at : at + 8192]).astype(np.float64)).astype(np.int64)
        if len(total) > 256:
            yield from flush()
    yield from flush()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by language -> one row for each."""
    at, total = None, np.zeros(WIDTH, np.int64)
    out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "sum"])
    for b in batches:
        for lang, raw in zip(b["lang"].to_pylist(), b["sum"].to_pylist(), strict=True):
            if lang != at:
                if at is not None:
                    yield out()
                at, total = lang, np.zeros(WIDTH, np.int64)
            total = total + np.frombuffer(raw, np.int64)
    if at is not None:
        yield out()


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit vectors, learned from all rows of ``docs`` with a language."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(_bundled, "lang string, sum binary").repartition("lang").sortWithinPartitions("lang").mapInArrow(_added, "lang string, sum array<long>")
    found = sorted((r["lang"], r["sum"]) for r in sums.collect())  # one row a language
    out = np.array([x for _, x in found], np.float64).reshape(-1, WIDTH)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return [lang for lang, _ in found], out / np.where(norm > 0, norm, 1)


def bundle(found: list[np.ndarray]) -> np.ndarray:
    """(texts, WIDTH) bundled vectors: a product of the texts' trigram counts with the trigrams' vectors."""
    used, at = np.unique(np.concatenate(found), return_inverse=True)
    row = np.repeat(np.arange(len(found)), [len(t) for t in found])
    out = np.zeros((len(found), WIDTH), np.float32)
    for a in range(0, len(used), 8192):
        b = min(a + 8192, len(used))
        here = (at >= a) & (at < b)
        n = np.bincount(row[here] * (b - a) + at[here] - a, minlength=len(found) * (b - a)).reshape(len(found), b - a).astype(np.float32)
        out += n @ vectors(used[a:b]).astype(np.float32)
    return out


def _predicted(langs: list[str], profile: np.ndarray):
    profile = profile.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _pieces(batches, BATCH):
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            size = np.cumsum([0, *map(len, texts)])
            for i, j in chunks(size, 1 << 20):
                found = trigrams(texts[i:j])
                full = [k for k, t in enumerate(found) if len(t)]
                if not full or not langs:
                    continue
                v = bundle([found[k] for k in full])
                cos = v @ profile.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(axis=1)
                at = np.array(full) + i
                lang[at] = [langs[k] for k in best]
                score[at] = np.clip(cos[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """id, held_out, lang_pred, score; one row per row of ``docs``."""
    out = F.coalesce(fold(id_col, folds) == held, F.lit(False))
    langs, profile = prototypes(docs.filter(~out), text_col, lang_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = own.mapInArrow(_predicted(langs, profile), "id long, lang_pred string, score double")
    return made.select(F.col("id").alias(id_col), F.coalesce(fold("id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
