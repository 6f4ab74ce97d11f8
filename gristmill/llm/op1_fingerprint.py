"""MinHash fingerprints of documents.

A fingerprint is the minimum of each of LANES universal hash permutations over
a text's distinct five-word shingles, of which 16 bits are kept; two
fingerprints agree in a lane about as often as the texts' shingle sets overlap.

``fingerprint_documents`` compares every text with the next one and with an
edited text made of both. Rows are dealt once by ranges of the id; the first
row of a range also goes to the range before it, so that no window over the
whole table is needed. ``near_duplicates`` joins bands of fingerprints (A-Z as
a-z) and confirms the Jaccard similarity on the full sets; links among members
of crowded bands are found by their rare shingles, as in op8_forest.

Defined results: null text is empty; an empty text's fingerprint has all bits
set and is like another empty text's only; null ids come last; rows that share
an id are ordered by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op8_forest
from .graph import components
from .linkage import confirmed, shingle_sets
from .store import materialize, partitions, tidy
from .textops import EMPTY, mix, permutations, signatures

LANES, WORDS, SEED, BANDS, BAND = 128, 5, 1, 24, 4
#: Members up to which all pairs of a band are candidates; in larger ones, of those that follow, the first and so many before each.
ALL, NEAR = 32, 8
BATCH = 256
SPREAD = np.uint32(0x9E3779B1)


def lanes(col: pa.Array) -> np.ndarray:
    """(rows, LANES) 16-bit lanes of the fingerprints of a column of texts."""
    return _lanes(shingle_sets(col, WORDS, False))


def _lanes(sets: list[np.ndarray]) -> np.ndarray:
    sig = signatures(sets, permutations(LANES, SEED))
    with np.errstate(over="ignore"):  # a minimum's own upper bits are mostly zeros
        return np.where(sig == EMPTY, 0xFFFF, (sig * SPREAD) >> np.uint32(16)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row, less what agrees by chance."""
    chance = 2.0**-16
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _dealt(bounds: np.ndarray, firsts: dict[int, int], before: dict[int, int], last: int):
    """Adds the range of each row (descending ids, null last); a range's first rows once more for the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b["id"].is_null().to_numpy(zero_copy_only=False)
            ids = b["id"].fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(null, last, len(bounds) - np.searchsorted(bounds, ids, "left"))
            ghost = [i for i, (p, x, z) in enumerate(zip(part.tolist(), ids.tolist(), null.tolist(), strict=True)) if firsts[p] == (None if z else x)]
            take = np.r_[np.arange(b.num_rows), np.array(ghost, np.int64)]
            out = b.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([out["id"], out["text"], pa.array(np.r_[part, [before[int(part[i])] for i in ghost]].astype(np.int32)), pa.array(np.r_[np.zeros(b.num_rows, bool), np.ones(len(ghost), bool)])], names=["id", "text", "part", "ghost"])

    return run


def _ranges(bounds: np.ndarray, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b["id"].is_null().to_numpy(zero_copy_only=False)
            part = np.where(null, last, len(bounds) - np.searchsorted(bounds, b["id"].fill_null(0).to_numpy(zero_copy_only=False), "left"))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b["id"]], names=["part", "id"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range, own rows before the ghost, ids descending: each own row with what follows it."""
    held: tuple | None = None  # the last row so far
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            texts = [t or "" for t in part["text"].to_pylist()]
            rows = list(zip(part["part"].to_pylist(), part["ghost"].to_pylist(), part["id"].to_pylist(), texts, lanes(part["text"]), strict=True))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
            if not pairs:
                continue
            edited = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in pairs]
            own, follows, made = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs]), lanes(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([x.tobytes().hex() for x in own]),
                    pa.array([x.tobytes().hex() for x in made]),
                    pa.array(likeness(own, made)),
                    pa.array(likeness(own, follows)),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row of ``docs``."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = partitions(docs.sparkSession)
    bounds = np.array(sorted(set(own.approxQuantile("id", [i / n for i in range(1, n)], min(0.01, 0.2 / n)))), np.float64).astype(np.int64) if n > 1 else np.zeros(0, np.int64)
    last = len(bounds) + 1
    # one row for each range
    firsts = dict(own.select("id").mapInArrow(_ranges(bounds, last), "part int, id long").groupBy("part").agg(F.max("id")).collect())
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    dealt = own.mapInArrow(_dealt(bounds, firsts, before, last), "id long, text string, part int, ghost boolean")
    rows = dealt.repartitionById(max(1, last + 1), F.col("part")).sortWithinPartitions("part", "ghost", F.desc_nulls_last("id"), "text")
    made = rows.mapInArrow(_compared, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("id", id_col)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(991))
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                sets = shingle_sets(part["text"], WORDS, True)
                sig = _lanes(sets).astype(np.uint64)
                full = (sig != 0xFFFF).any(axis=1)
                quad = sig[:, : BANDS * BAND].reshape(len(sig), BANDS, BAND)
                key = mix((quad << np.array([0, 16, 32, 48], np.uint64)).sum(axis=2, dtype=np.uint64) + salt)[full]
                ids = part["id"].to_numpy(zero_copy_only=False)[full]
                raw = [x.astype(np.uint8).tobytes() for x in sig[full]]
                whole = [[int(mix(x ^ np.uint64(y)).sum(dtype=np.uint64).astype(np.int64)) for x, z in zip(sets, full, strict=True) if z] for y in (0x51ED, 0xA3C7)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key.astype(np.int64).tolist(), pa.list_(pa.int64())), pa.array(raw, pa.binary()), *(pa.array(x, pa.int64()) for x in whole)], names=["id", "keys", "low", "one", "two"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id -> pairs (a, b): all of a key's first ALL rows, those after them with the first and with the NEAR before each. The members of a key with more than ALL are pairs with themselves."""
    at, seen, hub, before = None, 0, None, []
    for b in batches:
        one, two = [], []
        for key, i in zip(b["key"].to_pylist(), b["id"].to_pylist(), strict=True):
            if key != at:
                at, seen, hub, before = key, 0, i, []
            others = {hub, *before} - {i}
            one += others
            two += [i] * len(others)
            before.append(i)
            seen += 1
            if seen > ALL:
                crowd = before if seen == ALL + 1 else [i]
                one += crowd
                two += crowd
                before = before[-NEAR:]
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one = np.frombuffer(b"".join(b["low"].to_pylist()), np.uint8).reshape(-1, LANES)
            two = np.frombuffer(b"".join(b["other"].to_pylist()), np.uint8).reshape(-1, LANES)
            good = (one == two).mean(axis=1) >= least
            yield b.select(["a", "b"]).filter(pa.array(good))

    return run


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """(id, component): documents linked by ``den`` * intersection >= ``num`` * union of their shingle sets; only those that are linked.

    Documents that share a band are candidates: all pairs of up to ALL. Pairs whose
    fingerprints agree often enough are decided on the full sets. In larger bands
    that is done for some pairs of each member, and what these leave apart is
    found by rare shingles and decided on the full sets too (see op8_forest).
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    banded = materialize(own.mapInArrow(_banded, "id long, keys array<long>, low binary, one long, two long"), "bands")
    # documents with equal sets enter the bands once, so a group of copies costs each band one row
    first = materialize(banded.groupBy("one", "two").agg(F.min("id").alias("first")), "band-first")
    same = banded.select("id", "one", "two").join(first, ["one", "two"]).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    banded = banded.join(first.select(F.col("first").alias("id")), "id", "left_semi")
    keys = banded.select(F.explode("keys").alias("key"), "id").repartition("key").sortWithinPartitions("key", "id")
    met = materialize(keys.mapInArrow(_met, "a long, b long").distinct(), "band-met")
    pairs, crowded = met.filter("a <> b"), materialize(met.filter("a = b").select(F.col("a").alias("id")), "band-crowded")
    low = banded.select("id", "low").join(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    low = materialize(low, "band-low")
    pairs = pairs.join(low.withColumnRenamed("id", "a"), "a").join(low.select(F.col("id").alias("b"), F.col("low").alias("other")), "b").select("a", "b", "low", "other")
    pairs = materialize(pairs.mapInArrow(_alike(num / den - 0.2), "a long, b long").unionByName(same), "band-pairs")
    label = components(confirmed(own, pairs, num, den, WORDS, True))
    if not crowded.isEmpty():
        nodes = low.select("id", F.substring("low", 1, op8_forest.LANES).alias("low"))
        label = op8_forest.apart(own, nodes, crowded, label, num, den, WORDS, True)
    return label.select(F.col("node").alias(id_col), "component")


@tidy
def fingerprints_with_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprint_documents`` with each row's ``component``: the smallest id among its near-duplicates, its own if it has none."""
    linked = near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("linked"), "component")
    made = fingerprint_documents(docs, id_col, text_col)
    joined = made.join(linked, made[id_col] == linked["linked"], "left")
    return joined.drop("linked").withColumn("component", F.coalesce("component", F.col(id_col)))
