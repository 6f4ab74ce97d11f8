"""Pairs of alike strings where most strings share their pieces: every left string meets every block of the right ones, exactly, in numpy.

Levenshtein: the rows of the edit matrix go down a trie of the right strings,
all left strings of one length together, and a branch ends where no string
below it can be near enough, so common heads are paid once. Jaccard: shared
bigrams are counted by a product of incidence matrices for the frequent ones and
by lists of their strings for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 4 << 20  # characters (with padding) of a block of right strings
STATES = 100_000  # rows of edit matrices at once
QUERIES, SETS, HOT = 256, 8192, 512  # left strings at once; right sets and frequent bigrams in a product


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus one, padded with zeros, and lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return out, size


class Trie:
    """Sorted distinct strings; nodes of depth d are numbered by the first string below them."""

    def __init__(self, texts: list[str]):
        chars, self.size = codes(texts)
        n, self.depth = chars.shape
        same = np.full(n, -1)
        same[1:] = (chars[1:] != chars[:-1]).argmax(axis=1)
        self.first = [np.flatnonzero((self.size >= d) & (same < d)).astype(np.int32) for d in range(self.depth + 1)]
        self.first[0] = np.zeros(1, np.int32)
        self.char = [None] + [chars[f, d] for d, f in enumerate(self.first[1:])]
        self.leaf = [self.size[f] == d for d, f in enumerate(self.first)]
        self.below = []  # of each node: its first child and the one after its last
        for d in range(self.depth + 1):
            under = self.first[d + 1] if d < self.depth else np.zeros(0, np.int32)
            self.below.append(np.searchsorted(under, np.r_[self.first[d], n]).astype(np.int32))

    def near(self, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row of ``own`` (strings of one length), place of the string and score, for scores from the threshold up."""
        m = own.shape[1]
        least, most = math.ceil(m * threshold - 1e-9), min(self.depth, math.floor(m / threshold + 1e-9))
        edits = math.floor((1 - threshold) * max(m, most) + 1e-9)
        low, high = max(least, int(self.size.min())), most  # lengths of strings that can be alike
        if low > high:
            return
        width, over = 2 * edits + 1, edits + 1
        kind = np.uint8 if edits < 120 else np.int32
        padded = np.zeros((most + width + m, len(own)), np.uint32)
        padded[edits : edits + m] = own.T
        place = np.arange(width) - edits
        start = np.where((place >= 0) & (place <= m), place, over).clip(0, over).astype(kind)
        todo = [(0, np.arange(len(own)), np.zeros(len(own), np.int64), np.repeat(start[:, None], len(own), axis=1))]
        while todo:
            d, who, node, rows = todo.pop()
            at, upto = self.below[d][node], self.below[d][node + 1]
            count = upto - at
            ends = np.cumsum(count)
            if ends[-1] > STATES and len(who) > 1:
                half = int(np.searchsorted(ends, ends[-1] // 2).clip(1, len(who) - 1))
                todo += [(d, who[:half], node[:half], rows[:, :half]), (d, who[half:], node[half:], rows[:, half:])]
                continue
            j = d + 1
            if not ends[-1] or j > most:
                continue
            of = np.repeat(np.arange(len(who)), count)
            child = np.arange(ends[-1]) + np.repeat(at - ends + count, count)
            who, old = who[of], rows[:, of]
            new = old + (padded[j - 1 : j - 1 + width][:, who] != self.char[j][child])
            new = new.astype(kind, copy=False)
            np.minimum(new[:-1], old[1:] + kind(1), out=new[:-1])
            begin, end = max(0, edits - j), min(width, m - j + edits + 1)  # the places that exist
            if end <= begin:
                continue
            new[:begin], new[end:] = over, over
            for w in range(begin + 1, end):
                np.minimum(new[w], new[w - 1] + kind(1), out=new[w])
            np.minimum(new, over, out=new)
            w = m - j + edits
            if j >= low and 0 <= w < width:
                hit = np.flatnonzero(self.leaf[j][child] & (new[w] <= edits))
                score = 1 - new[w][hit] / max(m, j)
                hit, score = hit[score >= threshold], score[score >= threshold]
                if len(hit):
                    yield who[hit], self.first[j][child[hit]], score
            may = np.full(len(child), over, kind)  # the fewest edits that any string below needs
            for w in range(begin, end):
                rest = m - (j - edits + w)
                gap = max(0, rest - (high - j), (low - j) - rest)
                if gap <= edits:
                    np.minimum(may, new[w] + kind(gap), out=may)
            keep = np.flatnonzero((may <= edits) & (self.below[j][child + 1] > self.below[j][child]))
            if len(keep):
                todo.append((j, who[keep], child[keep], new[:, keep]))


def bigrams(chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bigram); a string of one character is its own bigram."""
    pair = (chars[:, :-1].astype(np.uint64) << np.uint64(32)) | chars[:, 1:]
    row, at = np.nonzero(chars[:, 1:])
    short = np.flatnonzero(size == 1)
    row, gram = np.r_[row, short], np.r_[pair[row, at], chars[short, 0].astype(np.uint64)]
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])][: len(row)]
    return row[new], gram[new]


class Sets:
    """Bigram sets of strings."""

    def __init__(self, texts: list[str]):
        row, gram = bigrams(*codes(texts))
        self.size = np.bincount(row, minlength=len(texts))
        self.gram, of, often = np.unique(gram, return_inverse=True, return_counts=True)
        hot = np.argsort(-often, kind="stable")[:HOT]
        self.place = np.full(len(self.gram), -1)
        self.place[hot] = np.arange(len(hot))
        self.table = np.zeros((len(hot), len(texts)), np.float32)
        dense = self.place[of] >= 0
        self.table[self.place[of[dense]], row[dense]] = 1
        order = np.argsort(of, kind="stable")
        self.rows, self.start = row[order], np.r_[0, np.cumsum(often)]

    def near(self, chars: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, place of the string and score, for scores from the threshold up."""
        row, gram = bigrams(chars, size)
        own = np.bincount(row, minlength=len(chars))
        if not len(self.gram):
            return
        at = np.searchsorted(self.gram, gram).clip(0, len(self.gram) - 1)
        known = self.gram[at] == gram
        row, at = row[known], at[known]
        hot = self.place[at] >= 0
        mine = np.zeros((len(chars), len(self.table)), np.float32)
        mine[row[hot], self.place[at[hot]]] = 1
        shared = mine @ self.table
        for r, g in zip(row[~hot], at[~hot], strict=True):
            shared[r, self.rows[self.start[g] : self.start[g + 1]]] += 1
        part = threshold / (1 + threshold)
        one, two = np.nonzero(shared >= np.maximum((part * own - 1e-3)[:, None] + part * self.size, 0.5).astype(np.float32))
        both = shared[one, two].astype(np.int64)
        score = both / (own[one] + self.size[two] - both)
        good = score >= threshold
        yield one[good], two[good], score[good]


def _meet(method: str, threshold: float, best: bool):
    """Rows of one task by side and text, the right strings first: (a, b, s)."""

    def found(own: list[str], blocks: list[tuple[int, Trie | Sets]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        chars, size = codes(own)
        for first, block in blocks:
            if method == "jaccard":
                for one, two, s in block.near(chars, size, threshold):
                    yield one, two + first, s
                continue
            for m in np.unique(size):
                rows = np.flatnonzero(size == m)
                for one, two, s in block.near(chars[rows, :m], threshold):
                    yield rows[one], two + first, s

    def likeliest(one: np.ndarray, two: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((two, -s, one))
        first = order[np.r_[True, one[order][1:] != one[order][:-1]][: len(order)]]
        return one[first], two[first], s[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        blocks: list | None = None
        right = None
        for b in batches:
            side = b["side"].to_numpy(zero_copy_only=False)
            rows = b["text"].to_pylist()
            cut = int(np.searchsorted(side, 1))
            texts += rows[:cut]
            if cut == len(rows) or not texts:
                continue
            if blocks is None:
                right = pa.array(texts, pa.string())
                step = SETS if method == "jaccard" else len(texts)
                blocks = [(i, (Sets if method == "jaccard" else Trie)(texts[i : i + step])) for i in range(0, len(texts), step)]
            for i in range(cut, len(rows), QUERIES):
                own = rows[i : i + QUERIES]
                left = pa.array(own, pa.string())
                held = []
                for x in found(own, blocks):
                    if best:
                        held = [likeliest(*(np.concatenate(c) for c in zip(*held, x, strict=True)))]
                        x = None
                    if x is not None and len(x[0]):
                        yield pa.RecordBatch.from_arrays([left.take(pa.array(x[0])), right.take(pa.array(x[1])), pa.array(x[2], pa.float64())], names=["_a", "_b", "_s"])
                for x in held:
                    yield pa.RecordBatch.from_arrays([left.take(pa.array(x[0])), right.take(pa.array(x[1])), pa.array(x[2], pa.float64())], names=["_a", "_b", "_s"])

    return run


def all_pairs(a: DataFrame, b: DataFrame, method: str, threshold: float, best: bool) -> DataFrame:
    """(_a, _b, _s) of the distinct strings ``a._a`` and ``b._b`` whose score reaches the threshold; with ``best`` at least each left string's best pair."""
    count, longest = b.agg(F.count(F.lit(1)), F.max(F.length("_b"))).first()
    blocks = max(1, math.ceil(count * (longest or 1) / CELLS))
    shares = max(1, min(math.ceil(2 * a.sparkSession.sparkContext.defaultParallelism / blocks), math.ceil(a.count() / QUERIES)))
    block, share = F.pmod(F.xxhash64("_b"), F.lit(blocks)), F.pmod(F.xxhash64("_a"), F.lit(shares))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    right = b.select(F.lit(0).alias("side"), F.col("_b").alias("text"), block.alias("block"), every(shares).alias("share"))
    left = a.select(F.lit(1).alias("side"), F.col("_a").alias("text"), every(blocks).alias("block"), share.alias("share"))
    task = (F.col("block") * shares + F.col("share")).cast("int")
    rows = right.unionByName(left).select("side", "text", task.alias("task")).repartitionById(blocks * shares, F.col("task")).sortWithinPartitions("side", "text")
    return rows.select("side", "text").mapInArrow(_meet(method, threshold, best), "_a string, _b string, _s double")
