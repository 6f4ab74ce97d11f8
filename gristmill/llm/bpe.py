"""Byte-level BPE ids for whole batches of texts.

The pre-tokenizer's pattern is evaluated for a whole batch at once on arrays of
code points; each distinct piece is then encoded by the tokenizer once per worker
and looked up by hash afterwards. The ids are those of the tokenizer applied to
whole texts; texts with a special token's string are handed to it whole.
"""

from __future__ import annotations

import re

import numpy as np

from .textops import chunks, mix, powers

SPACE, LETTER, NUMBER, OTHER = range(4)
#: White_Space, as \s has it in the tokenizer's pattern. Fixed values.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a piece of its own. Fixed values.
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
MOST_CACHED = 2_000_000
#: White space other than one leading space.
WHITE_INSIDE = re.compile(f"^[{''.join(map(chr, sorted({*WHITE} - {0x20})))}]|.[{''.join(map(chr, WHITE))}]", re.S)

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        import regex

        every = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        table[WHITE] = SPACE
        _classes = table
    return _classes


def piece_starts(cp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where pieces of `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` begin; ``doc``: where texts begin."""
    n = len(cp)
    kind = classes()[cp]
    new = np.zeros(n + 3, bool)
    new[doc] = True
    new[n:] = True
    start = new[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = start.copy()
    # the last of some white space goes with what follows it if it is a space, and else stands alone
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new[1:n])
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    # an apostrophe alone, with no space before it, takes a short ending with it
    q = np.flatnonzero((cp == 0x27) & run)
    q = q[start[q] & ~new[q + 1]]
    q = q[kind[q + 1] == LETTER]
    padded = np.r_[cp, np.zeros(3, cp.dtype)]
    for word in SHORT:
        hit = padded[q + 1] == ord(word[0])
        if len(word) == 2:
            hit &= (padded[q + 2] == ord(word[1])) & ~new[q + 2]
        at, q = q[hit], q[~hit]
        start[at + 1] = False
        end = at + 1 + len(word)
        start[end[end < n]] = True
    return start


class Encoder:
    """Encodes texts to ids; keeps the ids of pieces that it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Strings with ids of their own; texts that contain one are encoded whole.
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        (self.line,) = self.plain("\n")
        self.reset()

    def plain(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted, with the place of each key's ids
        self.places = np.zeros(0, np.int64)
        self.recent: dict[int, int] = {}  # not yet merged into them
        self.ids = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 12, np.int64)
        self.n = 0

    def learn(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Add pieces not seen before; their places. Pieces with no line end are encoded in one call, with a line end (one id, which none of them has) between them."""
        odd = [i for i, p in enumerate(pieces) if p.isspace() or WHITE_INSIDE.search(p)]
        own = [self.plain(pieces[i]) for i in odd]
        plain = np.ones(len(pieces), bool)
        plain[odd] = False
        ids = np.array(self.plain("\n".join([p for p, x in zip(pieces, plain.tolist(), strict=True) if x])), np.uint32)
        cut = np.flatnonzero(ids == self.line)
        count = np.zeros(len(pieces), np.int64)
        if plain.any():
            count[plain] = np.diff(np.r_[-1, cut, len(ids)]) - 1
        count[odd] = [len(x) for x in own]
        flat = np.concatenate([ids[ids != self.line], *(np.array(x, np.uint32) for x in own)])
        order = np.r_[np.flatnonzero(plain), np.array(odd, np.int64)]  # as the ids lie in flat
        total = int(self.off[self.n]) + len(flat)
        if total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * total)
        if self.n + len(pieces) + 1 > len(self.off):
            self.off = np.resize(self.off, 2 * (self.n + len(pieces) + 1))
        self.ids[total - len(flat) : total] = flat
        self.off[self.n + 1 : self.n + 1 + len(pieces)] = total - len(flat) + np.cumsum(count[order])
        places = np.empty(len(pieces), np.int64)
        places[order] = np.arange(self.n, self.n + len(pieces))
        self.n += len(pieces)
        self.recent.update(zip(keys.tolist(), places.tolist(), strict=True))
        if len(self.recent) > 20_000 + len(self.keys) // 4:
            every, at = np.r_[self.keys, np.array([*self.recent], np.uint64)], np.r_[self.places, np.array([*self.recent.values()], np.int64)]
            by = np.argsort(every)
            self.keys, self.places, self.recent = every[by], at[by], {}
        return places

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys, -1 for those not seen."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.places[at[hit]]
        if self.recent:
            rest = np.flatnonzero(out < 0)
            out[rest] = [self.recent.get(k, -1) for k in keys[rest].tolist()]
        return out

    def encode(self, texts: list[str], most: int = 1 << 19) -> list[np.ndarray]:
        whole = {i: np.array(self.plain(t), np.uint32) for i, t in enumerate(texts) if any(x in t for x in self.special)}
        rest = ["" if i in whole else t for i, t in enumerate(texts)]
        size = np.cumsum([0, *map(len, rest)])
        made = [x for i, j in chunks(size, most) for x in self._encode(rest[i:j])]
        return [whole.get(i, x) for i, x in enumerate(made)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.cumsum([0, *map(len, texts)])
        if not len(cp):
            return [np.zeros(0, np.uint32) for _ in texts]
        if self.n > MOST_CACHED:
            self.reset()
        s = np.flatnonzero(piece_starts(cp, doc[:-1][doc[:-1] < len(cp)]))
        size = np.diff(np.r_[s, len(cp)])
        pos = np.arange(len(cp)) - np.repeat(s, size)
        with np.errstate(over="ignore"):
            h = mix(np.add.reduceat((cp.astype(np.uint64) + np.uint64(0x9E37)) * powers(int(size.max()) + 1)[pos], s) + size.astype(np.uint64))
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        index = self.find(keys)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            at = first[missing]
            index[missing] = self.learn(keys[missing], [joined[a:b] for a, b in zip(s[at].tolist(), (s[at] + size[at]).tolist(), strict=True)])
        piece = index[inverse]
        count = self.off[piece + 1] - self.off[piece]
        end = np.cumsum(count)
        flat = self.ids[np.repeat(self.off[piece] - (end - count), count) + np.arange(end[-1])]
        cut = np.r_[0, end][np.searchsorted(s, doc)]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Encoder:
    """The encoder of a public vocabulary, once per process. ``folder``: where its files are, if not where they are installed."""
    if (key := f"{folder}/{name}") not in _encoders:
        import public_tokenizers

        path = f"{folder}/{name}.json" if folder else public_tokenizers.path(f"{name}.json")
        _encoders[key] = Encoder(path)
    return _encoders[key]
