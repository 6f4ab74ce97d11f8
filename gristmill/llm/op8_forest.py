"""Near-duplicates by an LSH forest of MinHash signatures.

Each tree orders the documents by the same signature read from another place
on. Documents that share a tree's first DEPTH values form a region. In a small
region all pairs are candidates; a crowded one is read deeper, the more so the
more documents it has, and only neighbours in the sorted order, with the longest
common prefixes, are candidates there. Candidate pairs are decided exactly on
full shingle sets (see linkage).

What that leaves apart among the members of crowded regions is found by their
rare shingles, exactly: with all sets in one order, rarest shingles first, two
linked sets share a shingle so early in both that what follows can still make
up the overlap. Documents that merely share a template meet nowhere, as their
own words come first. Such meetings between documents that are still in
different components are compared by longer signatures, the likeliest first,
and those that may be linked are decided on full sets again.

Documents with equal sets enter the forest once, so groups of exact copies cost
what one document costs.

Defined results: null text is empty; a document without words has no shingles
and is linked with nothing; repeated rows, and rows that share an id, are one
document; null ids are not linked and are their own (null) component; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .linkage import confirmed, shingle_sets, verified
from .store import dropped, materialize, narrow, tidy
from .textops import mix, permutations, signatures

TREES, DEPTH, LANES, SEED = 16, 4, 64, 8
#: Candidates' estimated likeness may be this much below the threshold: four and a half standard errors of 64 lanes at 0.85.
MARGIN = 0.20
SMALL, CROWDED, NEIGHBOURS = 32, 512, 2
#: The same for neighbours in crowded regions, where rare shingles find what this leaves.
CLOSE = 0.06
#: For meetings by rare shingles: further lanes, and the margin of all lanes together (at least 4.4 standard errors at 0.80).
MORE, FINE = 192, 0.11
#: Cells of the table by which shingles are ordered. It has a fixed size; the order only decides how much is compared.
CELL_BITS = 22
#: Members that a task compares with as many others, how many of them at a time, and how many partners of each come first.
BLOCK, STRIPE, FIRST = 8192, 128, 4


def _scanned(k: int, fold: bool):
    perms = permutations(LANES, SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = shingle_sets(part["text"], k, fold)
                sig = signatures(sets, perms)
                with np.errstate(over="ignore"):
                    one = [int(mix(s ^ np.uint64(0x51ED)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                    two = [int(mix(s ^ np.uint64(0xA3C7)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "n", "one", "two", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's region in each tree."""
    with np.errstate(over="ignore"):
        steps = mix(np.arange(1, DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        salt = mix(np.arange(TREES, dtype=np.uint64) + np.uint64(77))
        for b in batches:
            sig = np.array([np.frombuffer(x.as_buffer(), np.uint32) for x in b["sig"]], np.uint64).reshape(-1, LANES)
            key = mix((sig[:, : TREES * DEPTH].reshape(-1, TREES, DEPTH) * steps).sum(axis=2, dtype=np.uint64) + salt)
            ids = b["id"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, TREES), pa.int64()), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(ids))), pa.array(key.reshape(-1).astype(np.int64))], names=["id", "tree", "key"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The order of a region's members in its tree, and the part of a crowded region that a member belongs to."""
    for b in batches:
        order, sub = [], []
        for tree, members, raw in zip(b["tree"].to_pylist(), b["members"].to_pylist(), b["low"].to_pylist(), strict=True):
            at = (tree * DEPTH + DEPTH) % LANES
            turned = raw[at:] + raw[:at]
            order.append(turned)
            deeper = min(LANES - DEPTH, int(np.ceil(4.6 * np.log2(members / CROWDED)))) if members > CROWDED else 0
            sub.append(turned[:deeper])
        yield pa.RecordBatch.from_arrays([b["key"], b["id"], b["members"], b["low"], pa.array(order, pa.binary()), pa.array(sub, pa.binary())], names=["key", "id", "members", "low", "order", "sub"])


def _neighbours(least: float, close: float):
    """Rows sorted by key, part and order -> candidate pairs (a, b) whose signatures agree often enough."""

    def settle(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = np.array([r[0] for r in rows])
        low = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), LANES)
        small = rows[0][2] <= SMALL
        for step in range(1, min(SMALL if small else NEIGHBOURS, len(rows) - 1) + 1):
            good = (low[:-step] == low[step:]).mean(axis=1) >= (least if small else close)
            yield ids[:-step][good], ids[step:][good]

    def out(pairs: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in pairs] or [np.zeros(0, np.int64)])
        b = np.concatenate([x for _, x in pairs] or [np.zeros(0, np.int64)])
        made = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(made[0]), pa.array(made[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, pairs = None, [], []
        for b in batches:
            cols = [b[c].to_pylist() for c in ("key", "sub", "id", "low", "members")]
            for key, sub, *row in zip(*cols, strict=True):
                if (key, sub) != at or len(rows) >= 4096:
                    if rows:
                        pairs += settle(rows)
                    # a very long part is read in stretches that overlap
                    rows = rows[-NEIGHBOURS:] if (key, sub) == at else []
                    at = (key, sub)
                rows.append(tuple(row))
            if len(pairs) > 4096:
                yield out(pairs)
                pairs = []
        if rows:
            pairs += settle(rows)
        yield out(pairs)

    return run


def region_members(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, sig) -> (key, id, tree, members), one row per node and region of at least two."""
    keys = nodes.select("id", "sig").mapInArrow(_keys, "id long, tree int, key long")
    regions = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return materialize(keys.join(regions, "key"), "forest-members")


def candidate_pairs(nodes: DataFrame, member: DataFrame, least: float, close: float) -> DataFrame:
    """Candidate pairs (a, b): all of small regions, neighbours of crowded ones."""
    placed = member.join(nodes.select("id", "low"), "id").select("key", "tree", "id", "members", "low").mapInArrow(_placed, "key long, id long, members long, low binary, order binary, sub binary")
    rows = placed.repartition("key", "sub").sortWithinPartitions("key", "sub", "order", "id")
    return narrow(rows.mapInArrow(_neighbours(least, close), "a long, b long").filter("a <> b").distinct())


def _cells(k: int, fold: bool):
    """How many sets of a partition have a shingle in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = shingle_sets(b.slice(at, 512)["text"], k, fold)
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["cell", "n"])

    return run


def _rare(held, num: int, den: int, k: int, fold: bool):
    """Each set's first shingles, rarest first, as far as a linked set must share one of them; those met once are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys, rows, size, places = [], [], [], []
                for row, x in enumerate(shingle_sets(part["text"], k, fold)):
                    n = len(x)
                    own = level[(x >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    once = int((own == 0).sum())
                    # a set at least as large needs num / den of it, one of any size at least as much as a smaller one
                    most = n + (-num * n) // den + 1
                    if once >= most:
                        continue
                    some = np.flatnonzero(own)
                    some = some[np.lexsort((x[some], own[some]))][: most - once]
                    keys.append(x[some])
                    rows.append(np.full(len(some), row))
                    size.append(np.full(len(some), n))
                    places.append(np.arange(once, once + len(some)))
                if not keys:
                    continue
                rows, size, places = np.concatenate(rows), np.concatenate(size), np.concatenate(places)
                short = places < size + (-2 * num * size) // (num + den) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), part["id"].take(pa.array(rows)), pa.array(size.astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(short.astype(np.int32))], names=["key", "id", "n", "place", "short"])

    return run


def meetings(own: DataFrame, crowded: DataFrame, num: int, den: int, k: int, fold: bool) -> DataFrame:
    """(key, id, n, place, short): where sets of ``crowded`` (id) may meet. Of two linked sets one is there with ``short``."""
    sc = own.sparkSession.sparkContext
    texts = own.join(crowded, "id").select("id", "text")
    cells = texts.select("text").mapInArrow(_cells(k, fold), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    found = cells.select("cell", F.least(F.lit(127), F.floor(F.log2("n") * 4)).cast("tinyint").alias("level")).toPandas()  # at most 2 ** CELL_BITS small rows
    level = np.zeros(1 << CELL_BITS, np.uint8)
    level[found["cell"].to_numpy()] = found["level"].to_numpy()
    met = texts.mapInArrow(_rare(sc.broadcast(level), num, den, k, fold), "key long, id long, n int, place int, short int")
    return materialize(met, "forest-met")


def _more(k: int, fold: bool):
    """One byte of each further lane's minimum."""
    perms = permutations(MORE, SEED + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sig = signatures(shingle_sets(part["text"], k, fold), perms).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "more"])

    return run


def _planes(low: np.ndarray) -> np.ndarray:
    """(rows, 64) bytes -> (3, rows) words, each of one bit of every lane."""
    bits = (low[None] >> np.arange(3, dtype=np.uint8)[:, None, None]) & 1
    return np.packbits(bits, axis=2).view(np.uint64)[..., 0]


def _best(one: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Whether a pair is among the ``most`` with the highest scores of those with the same ``one``."""
    order = np.lexsort((-score, one))
    new = np.r_[True, one[order][1:] != one[order][:-1]]
    rank = np.arange(len(one)) - np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
    out = np.zeros(len(one), bool)
    out[order] = rank < most
    return out


def _between(least: float, fine: float, num: int, den: int, first: int | None):
    """Rows sorted by key, i and j -> pairs (a, b) with different labels that may be linked; chunk i of the key is compared with chunk j.

    ``first``: only the likeliest partners of each.
    """

    def settle(i: int, j: int, ids: np.ndarray, chunk: np.ndarray, label: np.ndarray, n: np.ndarray, place: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        planes = _planes(np.ascontiguousarray(sig[:, :LANES]))
        rest = n - place
        for s in range(0, len(left), STRIPE):
            rows = left[s : s + STRIPE]
            # lanes whose low bits differ: never more than lanes that differ
            differ = planes[0][rows][:, None] ^ planes[0][right][None]
            for p in planes[1:]:
                differ |= p[rows][:, None] ^ p[right][None]
            may = (LANES - np.bitwise_count(differ).astype(np.int16) >= least * LANES) & (label[rows][:, None] != label[right][None])
            # what follows the place of meeting can still make up the overlap
            may &= np.minimum(rest[rows][:, None], rest[right][None]) * (num + den) >= num * (n[rows][:, None] + n[right][None])
            a, b = np.nonzero(may)
            a, b = rows[a], right[b]
            for t in range(0, len(a), 1 << 16):
                u, v = a[t : t + (1 << 16)], b[t : t + (1 << 16)]
                score = (sig[u] == sig[v]).mean(axis=1)
                good = score >= fine
                u, v, score = u[good], v[good], score[good]
                if first is not None:
                    good = _best(u, score, first) | _best(v, score, first)
                    u, v = u[good], v[good]
                if len(u):
                    yield ids[u], ids[v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, made = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            ids, chunk, label, n, place, low, more = zip(*rows, strict=True)
            sig = np.concatenate([np.frombuffer(b"".join(low), np.uint8).reshape(-1, LANES), np.frombuffer(b"".join(more), np.uint8).reshape(-1, MORE)], axis=1)
            yield from settle(*at[1:], *(np.array(x, np.int64) for x in (ids, chunk, label, n, place)), sig)

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*made, strict=True))
            made.clear()
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        def closed() -> Iterator[pa.RecordBatch]:
            held = 0
            for x in out():
                made.append(x)
                held += len(x[0])
                if held > 1 << 18:
                    yield batch()
                    held = 0
            if len(made) > 4096:
                yield batch()

        for b in batches:
            for key, i, j, *row in zip(*(b[c].to_pylist() for c in ("key", "i", "j", "id", "chunk", "label", "n", "place", "low", "more")), strict=True):
                if (key, i, j) != at and rows:
                    yield from closed()
                    rows = []
                at = (key, i, j)
                rows.append(row)
        if rows:
            yield from closed()
        if made:
            yield batch()

    return run


@tidy
def apart_members(met: DataFrame, label: DataFrame) -> DataFrame:
    """``met`` with label, main, outer, inner: the keys where members of different components ``label`` (node, component) meet.

    main: the label of a key's largest component; outer, inner: chunks of about
    BLOCK rows for the members outside it and in it.
    """
    where = met.join(label.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    where = materialize(where, "forest-where")
    part = where.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short")).groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("x"), F.max("short").alias("any"))
    outer, inner = F.ceil((F.col("members") - F.col("x.n")) / BLOCK), F.ceil(F.col("x.n") / BLOCK)
    part = part.filter("any = 1 and members > x.n").select("key", F.col("x.label").alias("main"), outer.alias("outer"), inner.alias("inner"))
    return materialize(where.join(part, "key"), "forest-dealt")


def longer_signatures(own: DataFrame, dealt: DataFrame, k: int, fold: bool) -> DataFrame:
    """(id, more): further lanes of the documents in ``dealt``."""
    return materialize(narrow(own.join(dealt.select("id").distinct(), "id").mapInArrow(_more(k, fold), "id long, more binary").distinct()), "forest-more")


def met_pairs(nodes: DataFrame, dealt: DataFrame, more: DataFrame, num: int, den: int, first: int | None) -> DataFrame:
    """Pairs (a, b) of different components that meet in ``dealt`` and may be linked.

    Of each key's members every one outside its largest component is compared
    with every member.
    """
    outside, hash_ = F.col("label") != F.col("main"), F.xxhash64("id")
    dealt = dealt.withColumn("chunk", F.when(outside, F.pmod(hash_, F.col("outer"))).otherwise(F.col("outer") + F.pmod(hash_, F.col("inner"))))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1))
    cols = ("key", "id", "label", "n", "place", "chunk")
    rows = dealt.select(*cols, others.alias("o")).select(*cols, F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"))
    rows = rows.join(nodes.select("id", "low"), "id").join(more, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    least, fine = num / den - MARGIN, num / den - FINE
    pairs = rows.select("key", "i", "j", "id", "chunk", "label", "n", "place", "low", "more").mapInArrow(_between(least, fine, num, den, first), "a long, b long")
    return materialize(narrow(pairs.filter("a <> b").distinct()), "forest-met-pairs")


def apart(own: DataFrame, nodes: DataFrame, crowded: DataFrame, label: DataFrame, num: int, den: int, k: int, fold: bool) -> DataFrame:
    """``label`` (node, component) with the links among ``crowded`` (id) that it leaves apart. ``nodes`` (id, low): a byte of each of LANES signature values."""
    met = meetings(own, crowded, num, den, k, fold)
    decided, more = None, None
    for first in (FIRST, None):  # the likeliest partners first: then hardly any pairs are left
        dealt = apart_members(met, label)
        if dealt.isEmpty():
            break
        if more is None:  # components only grow together, so that later members are among the first
            more = longer_signatures(own, dealt, k, fold)
        further = met_pairs(nodes, dealt, more, num, den, first)
        dropped(dealt)
        if decided is not None:
            further = materialize(further.join(decided, ["a", "b"], "left_anti"), "forest-further")
        if further.isEmpty():
            break
        decided = further
        found = verified(own, further, num, den, k, fold)
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    return label


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each signature value, for estimates."""
    for b in batches:
        low = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint8).tobytes() for x in b["sig"]]
        yield pa.RecordBatch.from_arrays([b["id"], b["sig"], pa.array(low, pa.binary())], names=["id", "sig", "low"])


@tidy
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100, k: int = 5, fold: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept. Linked: den * intersection >= num * union."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialize(own.mapInArrow(_scanned(k, fold), "id long, n long, one long, two long, sig binary"), "forest-scan")
    sets = scanned.filter("n > 0 and id is not null").groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    sets = materialize(narrow(sets), "forest-sets")
    nodes = materialize(sets.select(F.col("rep").alias("id"), "sig").mapInArrow(_low, "id long, sig binary, low binary"), "forest-nodes")
    # rows that share an id but not a set
    shared = scanned.filter("n > 0 and id is not null").select("id", "n", "one", "two").distinct().join(sets.select("n", "one", "two", "rep"), ["n", "one", "two"]).filter("id <> rep").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    member = region_members(nodes)
    pairs = materialize(candidate_pairs(nodes, member, num / den - MARGIN, num / den - CLOSE), "forest-pairs")
    links = confirmed(own, pairs, num, den, k, fold)
    label = components(links.unionByName(shared))
    crowded = materialize(member.filter(F.col("members") > SMALL).select("id").distinct(), "forest-crowded")
    if not crowded.isEmpty():
        label = apart(own, nodes, crowded, label, num, den, k, fold)
    of_set = sets.join(label, F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("component", "rep").alias("component_id"))
    empty = scanned.filter("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    rest = scanned.filter("n > 0 and id is not null").join(of_set, ["n", "one", "two"]).select("id", F.col("n").alias("n_shingles"), "component_id")
    return rest.unionByName(empty).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
