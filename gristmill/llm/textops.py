"""Vectorised text primitives over Arrow string columns.

Words are maximal runs of bytes that are not separators. All separators used
here are ASCII, so cutting UTF-8 at byte level is the same as cutting code
points. Hashes are 64-bit polynomial hashes over randomised byte values,
finished with a mixing step; they depend on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = np.uint32(0xFFFFFFFF)

_rng = np.random.default_rng(20240501)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.ones(1, np.uint64)

#: The separators of `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is neither an ASCII letter nor part of a multi-byte character.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _values(fold: bool) -> np.ndarray:
    v = _BYTES.copy()
    if fold:
        v[0x41:0x5B] = v[0x61:0x7B]
    return v


VALUES = {False: _values(False), True: _values(True)}
#: Of an independent second hash.
OTHER_VALUES = np.random.default_rng(77003).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> np.ndarray:
    global _power
    if n > len(_power):
        size = max(n, 2 * len(_power), 1024)
        with np.errstate(over="ignore"):
            _power = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)])
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (len + 1) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row if that is longer."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word in data[off[0]:off[-1]], and each row's first word (len rows + 1)."""
    inside = ~sep[data[off[0] : off[-1]]]
    rel = off - off[0]
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    cut = rel[:-1][rel[:-1] < len(inside)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[rel[1:][rel[1:] > 0] - 1] = False
    s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return s, e, np.searchsorted(s, rel)


def word_hashes(data: np.ndarray, off: np.ndarray, fold: bool = False, sep: np.ndarray = BLANK, stems: tuple[int, ...] = (), other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the rows, and each row's first word (len rows + 1). ``fold``: A-Z count as a-z; ``other``: by other values of the bytes.

    With ``stems`` the hashes have a column for the word and one for each number of its first bytes, 0 for words that are no longer than that.
    """
    s, e, first = spans(data, off, sep)
    if not len(s):
        return np.zeros((0, 1 + len(stems)) if stems else 0, np.uint64), first
    seg = data[off[0] : off[-1]]
    value = (OTHER_VALUES if other else VALUES[fold]).copy()
    value[sep] = 0
    size = e - s
    pos = np.arange(len(seg)) - np.repeat(s, np.diff(np.r_[s, len(seg)])) if not s[0] else np.r_[np.zeros(s[0], np.int64), np.arange(s[0], len(seg)) - np.repeat(s, np.diff(np.r_[s, len(seg)]))]
    table = powers(int(size.max()) + 1)
    np.minimum(pos, size.max(), out=pos)
    with np.errstate(over="ignore"):
        v = value[seg] * table[pos]
        h = mix(np.add.reduceat(v, s) + size.astype(np.uint64))
        if stems:
            h = np.stack([h, *(np.where(size > k, mix(np.add.reduceat(np.where(pos < k, v, np.uint64(0)), s) + np.uint64(k << 32)), np.uint64(0)) for k in stems)], axis=1)
        return h, first


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * _STEP[0]
        for j in range(1, k):
            out += h[j : j + n] * _STEP[j]
        return mix(out)


def doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows twice as long as those of ``k`` words hashed in ``h``."""
    n = len(h) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(h[:n] * _STEP[62] + h[k:] * _STEP[63])


def whole(h: np.ndarray) -> np.ndarray:
    """One hash for a short sequence of hashes, kept apart from any window's."""
    with np.errstate(over="ignore"):
        return mix((h * _STEP[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _STEP[40 + len(h)])


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words are one shingle; no words, none."""
    if not len(h):
        return h
    return whole(h) if len(h) < k else np.unique(windows(h, k))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` universal hash permutations of 32-bit integers."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def signatures(sets: list[np.ndarray], perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash signatures (len(sets), permutations) as 32-bit minima; an empty set has all ones."""
    a, b = perms
    out = np.full((len(sets), len(a)), EMPTY, np.uint32)
    full = [i for i, x in enumerate(sets) if len(x)]
    at = 0
    while at < len(full):  # in pieces that stay in the processor's cache
        end, n = at, 0
        while end < len(full) and (n == 0 or n + len(sets[full[end]]) <= 65536):
            n += len(sets[full[end]])
            end += 1
        rows = full[at:end]
        x = (np.concatenate([sets[i] for i in rows]) >> np.uint64(32)).astype(np.uint32)
        start = np.cumsum([0, *(len(sets[i]) for i in rows[:-1])])
        with np.errstate(over="ignore"):
            for k in range(len(a)):
                out[rows, k] = np.minimum.reduceat(x * a[k] + b[k], start)
        at = end
    return out
