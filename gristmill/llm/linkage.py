"""Exact links among candidates, on whole shingle sets.

A small group of candidates is compared completely: intersection sizes of all
its sets come from one product of the incidence matrix with itself. A larger
component of candidates is dealt into blocks of a fixed size, and candidate
pairs that these leave apart are decided one by one on the two sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import materialize, narrow, tidy
from .textops import buffers, chunks, shingles, word_hashes

BLOCK = 256
#: Pairs of one document that a task decides; its set is sent again for as many more.
PAIRS = 512


def shingle_sets(col: pa.Array, k: int, fold: bool) -> list[np.ndarray]:
    data, off = buffers(col)
    out = []
    for i, j in chunks(off):
        h, first = word_hashes(data, off[i : j + 1], fold)
        out += [shingles(h[a:b], k) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, exactly."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # the others meet nothing
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)
    width = 1 << 14
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _linked(num: int, den: int):
    """Rows (grp, id, items) sorted by grp -> (grp, id, label, degree); the label is the smallest id linked with it in its group."""

    def settle(grp, ids: list, items: list[np.ndarray]) -> pa.RecordBatch:
        size = np.array([len(x) for x in items])
        common = intersections(items)
        link = (den * common >= num * (size[:, None] + size[None, :] - common)) & (common > 0)
        degree = link.sum(axis=1)
        label = np.array(ids)
        same = {}
        for i, x in enumerate(ids):  # rows that share an id are one document
            if x in same:
                link[i, same[x]] = link[same[x], i] = True
            same.setdefault(x, i)
        while True:
            low = np.where(link | np.eye(len(ids), dtype=bool), label[None, :], np.iinfo(np.int64).max).min(axis=1)
            if (low == label).all():
                break
            label = low
        return pa.RecordBatch.from_arrays([pa.array([grp] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(label, pa.int64()), pa.array(degree, pa.int64())], names=["grp", "id", "label", "degree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, items = None, [], []
        for b in batches:
            for grp, i, raw in zip(b["grp"].to_pylist(), b["id"].to_pylist(), b["items"], strict=True):
                if grp != at and ids:
                    yield settle(at, ids, items)
                    ids, items = [], []
                at = grp
                ids.append(i)
                items.append(np.frombuffer(raw.as_buffer(), np.uint64))
        if ids:
            yield settle(at, ids, items)

    return run


def settle_groups(sets: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """``sets`` (id, items) in the groups of ``groups`` (id, grp): (grp, id, label, degree)."""
    rows = sets.join(groups, "id").select("grp", "id", "items")
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_linked(num, den), "grp long, id long, label long, degree long")


def _to_sets(k: int, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                items = [x.tobytes() for x in shingle_sets(part["text"], k, fold)]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(items, pa.binary())], names=["id", "items"])

    return run


def sets_of(own: DataFrame, ids: DataFrame, k: int, fold: bool) -> DataFrame:
    """(id, items): the shingle sets of the rows of ``own`` whose id is in ``ids``."""
    sets = own.join(ids, "id").select("id", "text").mapInArrow(_to_sets(k, fold), "id long, items binary")
    return materialize(sets.filter(F.length("items") > 0), "link-sets")


def _decided(num: int, den: int):
    """Rows (a, salt, b, items) sorted, the rows of a itself (b null) first -> the pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, salt, b, raw in zip(batch["a"].to_pylist(), batch["salt"].to_pylist(), batch["b"].to_pylist(), batch["items"], strict=True):
                if (a, salt) != at:
                    at, lead = (a, salt), []
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    lead.append(x.copy())
                    continue
                for y in lead:  # rows that share an id are one document
                    where = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[where] == x).sum())
                    if den * common >= num * (len(x) + len(y) - common):
                        found.append((a, b))
                        break
            made = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    return run


@tidy
def verified(own: DataFrame, pairs: DataFrame, num: int, den: int, k: int = 5, fold: bool = True) -> DataFrame:
    """Those of the ``pairs`` (a, b) that are linked, each decided on the two whole sets.

    The end with more pairs leads: its set is sent once for PAIRS of its pairs.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ends = materialize(narrow(ends), "link-ends")
    sets = sets_of(own, ends.select("id"), k, fold)
    turned = pairs.join(ends.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    turned = turned.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("na", "nb").alias("n"))
    turned = materialize(turned.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIRS)).alias("salt")), "link-turned")
    lead = turned.select("a", "salt").distinct().join(sets, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "items")
    rows = lead.unionByName(turned.join(sets, F.col("b") == F.col("id")).select("a", "salt", "b", "items"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(rows.mapInArrow(_decided(num, den), "a long, b long"), "link-verified")


@tidy
def confirmed(own: DataFrame, pairs: DataFrame, num: int, den: int, k: int = 5, fold: bool = True) -> DataFrame:
    """Links among the candidate ``pairs`` (a, b), confirmed on the full sets: edges (a, b) that connect what is linked.

    ``own``: (id long, text). Components of at most BLOCK candidates are
    compared completely, each set sent once. Larger ones are dealt into blocks
    of that size, and then those pairs are decided one by one that no link has
    brought together, so the sets sent grow with the pairs.
    """
    candidates = components(pairs)
    size = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    member = materialize(candidates.join(size, "component").select(F.col("node").alias("id"), "component", "members"), "link-members")
    sets = sets_of(own, member.select("id"), k, fold)

    blocks = F.ceil(F.col("members") / BLOCK)
    block = F.pmod(F.xxhash64("id"), blocks)
    groups = member.select("id", "component", F.when(F.col("members") <= BLOCK, F.col("component")).otherwise(F.xxhash64("component", block)).alias("grp"), F.col("members"))
    first = materialize(settle_groups(sets, groups.select("id", "grp"), num, den), "link-first")
    edges = first.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    large = materialize(groups.filter(F.col("members") > BLOCK), "link-large")
    if large.isEmpty():
        return edges

    # of each block the best linked document stands for its largest part
    part = first.join(large.select("id", "grp", "component", "members"), ["id", "grp"])
    parts = part.groupBy("component", "members", "grp", "label").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "id")).alias("hub"))
    hubs = parts.groupBy("component", "members", "grp").agg(F.max(F.struct("n", "hub")).alias("x"))
    hubs = hubs.select(F.col("x.hub.id").alias("id"), F.xxhash64("component", F.lit("hubs"), F.pmod(F.xxhash64("grp"), F.ceil(F.col("members") / BLOCK / BLOCK))).alias("grp"))
    hubs = materialize(hubs, "link-hubs")  # of known size, so that the sets need not be dealt by id to meet it
    second = settle_groups(sets, hubs, num, den).filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    edges = materialize(edges.unionByName(second), "link-edges")

    label = components(edges).select("node", "component")
    here = pairs.join(large.select(F.col("id").alias("a")), "a", "left_semi")
    for end in ("a", "b"):
        here = here.join(label.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    left = materialize(here.filter("of_a <> of_b").select("a", "b"), "link-left")
    return edges if left.isEmpty() else edges.unionByName(verified(own, left, num, den, k, fold))
