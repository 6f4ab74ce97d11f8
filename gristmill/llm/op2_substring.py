"""Removal of repeated word sequences, by level-wise doubling of windows.

The first level looks at windows of half the final length (or a quarter, an
eighth: ``base``), each further one at windows twice as long, and only at those
places whose window was repeated at the level before. The doubling ends when no
candidates survive or the final length is reached.

Not every place is looked at. Each full window is represented at the first level
by the one of its ``base``-word windows that has the smallest hash, and then by
the window of twice the length around it. Representatives are chosen by content,
so equal full windows have equal ones, and about one place in six is sent.

A level has two steps. Blocks of rows send each distinct hash once, to the
bucket that owns it; buckets answer with the places whose window also occurs
elsewhere. At the last level the representative is the full window itself: of
equal ones the first by (document, start) stays and the others are answered.
Lower levels send 48 bits of a hash, since a false match there only costs work.
The last one identifies a window by 96 bits: 64 that are built from one hash of
each word and 32 from another, independent one.

Equal windows of one block are settled in the block, which sends the first of
them, so a passage that fills the corpus costs each block one entry. Buckets are
as many as the text asks for, and are settled one at a time. Texts travel
compressed.

Defined results: null text has no words; repeated rows (same id, same text) are
one document and have the same result; rows that share an id but not the text
are told apart by a hash of the text, as if it followed the id; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, tidy
from .textops import buffers, chunks, doubled, mix, windows, word_hashes

BLOCK_BYTES = 4 << 20
#: Characters of text for each bucket of hashes, and the most buckets.
BUCKET_CHARS, MOST_BUCKETS = 32 << 20, 1 << 14
#: Bytes of a hash that are sent at the lower levels and at the last one.
SHORT, LONG = 6, 12
ENTRY = np.dtype([("hash", "<u8"), ("extra", "<u8"), ("row", "<u4"), ("start", "<u4")])


def anchors(half: np.ndarray, reach: int) -> np.ndarray:
    """For each full window the place of its smallest shorter window (the first of equal ones); ``reach`` of these lie in a full one."""
    n = len(half) - reach + 1
    low, at = half[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, reach):
        new = half[j : j + n]
        less = new < low
        low[less], at[less] = new[less], j
    return at + np.arange(n)


def lengths(size: int, base: int) -> list[int]:
    """The levels' window lengths."""
    out = [base]
    while out[-1] < size:
        out.append(2 * out[-1])
    if base < 1 or out[-1] != size:
        raise ValueError("the window must be the first level's length, doubled some times")
    return out


def representatives(first: np.ndarray, size: int, base: int, length: int) -> list[np.ndarray]:
    """Where each full window's representatives of the levels up to ``length`` begin; ``first``: hashes of a text's ``base``-word windows."""
    out = [anchors(first, size - base + 1)]
    start = np.arange(len(out[0]))
    for long in lengths(length, base)[1:]:
        out.append(np.clip(out[-1] - long // 4, start, start + size - long))
    return out


def _hashed(data: np.ndarray, off: np.ndarray, upto: int, base: int, word_bits: int, other: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Each row's first word, and hashes of its windows of each length up to ``upto``; with ``other``, of the last by the words' other hash."""
    h, first = word_hashes(data, off)
    h = h & np.uint64((1 << word_bits) - 1)
    levels = [windows(h, base)]
    for k in lengths(upto, base)[:-1]:
        levels.append(doubled(levels[-1], k))
    extra = windows(word_hashes(data, off, other=True)[0], upto) if other else np.zeros(0, np.uint64)
    return first, levels, extra


def _entries(data: np.ndarray, off: np.ndarray, size: int, base: int, length: int, known: list[np.ndarray] | None, word_bits: int) -> np.ndarray:
    """The rows' distinct representatives of ``length`` words, where those half as long are at places ``known`` to be repeated."""
    out = []
    for i, j in chunks(off):
        first, levels, other = _hashed(data, off[i : j + 1], length, base, word_bits, length == size)
        for r in range(i, j):
            a, b = int(first[r - i]), int(first[r - i + 1])
            if b - a < size:
                continue
            least = levels[0][a : b - base + 1]
            *_, at = every = representatives(least, size, base, length)
            if known is not None:
                again = np.zeros(b - a, bool)
                again[known[r]] = True
                at = at[again[every[-2]]]
            at = np.unique(at)
            e = np.zeros(len(at), ENTRY)
            e["hash"], e["row"], e["start"] = levels[-1][a + at], r, at
            if length == size:
                e["extra"] = other[a + at] & np.uint64(0xFFFFFFFF)
            out.append(e)
    return np.concatenate(out) if out else np.zeros(0, ENTRY)


def _runs(e: np.ndarray) -> np.ndarray:
    """Whether each entry begins a run of equal windows (sorted by hash)."""
    new = np.ones(len(e), bool)
    new[1:] = (e["hash"][1:] != e["hash"][:-1]) | (e["extra"][1:] != e["extra"][:-1])
    return new


def part_of(ids: np.ndarray, text: np.ndarray, parts: int) -> np.ndarray:
    """The part of the documents that (id, hash of the text) belongs to."""
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.uint64) ^ mix(text.astype(np.uint64) + np.uint64(1))) % np.uint64(parts)).astype(np.int64)


def _flags(ids: np.ndarray, text: np.ndarray, row: np.ndarray, start: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Places by part of the documents, packed."""
    part = part_of(ids, text, parts)
    order = np.lexsort((start, row, part[row]))
    row, start = row[order], np.ascontiguousarray(start[order].astype("<u4"))
    cut = np.flatnonzero(np.r_[True, part[row][1:] != part[row][:-1]]).tolist()
    for a, b in zip(cut, [*cut[1:], len(row)], strict=True):
        used, count = np.unique(row[a:b], return_counts=True)
        yield int(part[row[a]]), np.uint32(len(used)).tobytes() + _steps(ids[used].astype("<u8")) + text[used].astype("<u4").tobytes() + count.astype("<u4").tobytes() + _steps(start[a:b])


def _unflagged(raw: list[bytes]) -> dict[tuple[int, int], np.ndarray]:
    """Places of each document (id, hash of the text) of a part."""
    keys, count, places = [], [], []
    for x in raw:
        m = int.from_bytes(x[:4], "little")
        ids, text = _unstepped(x, "<u8", m, 4).astype(np.int64), np.frombuffer(x, "<u4", m, 4 + 8 * m).astype(np.int64)
        keys.append(np.stack([ids, text]))
        count.append(np.frombuffer(x, "<u4", m, 4 + 12 * m))
        places.append(_unstepped(x, "<u4", (len(x) - 4) // 4 - 4 * m, 4 + 16 * m))
    if not keys:
        return {}
    keys, count, places = np.concatenate(keys, axis=1), np.concatenate(count), np.concatenate(places)
    both, of = np.unique(keys, axis=1, return_inverse=True)
    of = np.repeat(of.reshape(-1), count)
    places = places[np.argsort(of, kind="stable")].astype(np.int64)
    return dict(zip(map(tuple, both.T.tolist()), np.split(places, np.cumsum(np.bincount(of))[:-1]), strict=True))


MESSAGE = "bucket long, part long, ids binary, body binary"


def _message(bucket: int, part: int | None, ids: bytes | None, body: bytes) -> pa.RecordBatch:
    """A block's hashes for a bucket, or (with a part) places that it found itself."""
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([part], pa.int64()), pa.array([ids], pa.binary()), pa.array([body], pa.binary())], names=["bucket", "part", "ids", "body"])


def _steps(x: np.ndarray) -> bytes:
    """Differences, wrapping round, byte by byte: most upper bytes are zeros."""
    out = x.copy()
    out[1:] -= x[:-1]
    return np.ascontiguousarray(out.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unstepped(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    parts = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n)
    return np.cumsum(np.ascontiguousarray(parts.T).view(kind).reshape(-1), dtype=kind)


def _short(e: np.ndarray, last: bool) -> np.ndarray:
    """(entries, bytes) of a hash that are sent."""
    both = np.stack([e["hash"], e["extra"]], axis=1) if last else e["hash"][:, None]
    return np.ascontiguousarray(np.ascontiguousarray(both.astype("<u8")).view(np.uint8).reshape(len(e), -1)[:, : LONG if last else SHORT])


def _sent(size: int, base: int, length: int, buckets: int, word_bits: int):
    """Blocks of rows -> hashes packed for each bucket, and what is repeated inside the block."""
    last = length == size

    def block(ids: np.ndarray, text: np.ndarray, data: np.ndarray, off: np.ndarray, known: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        rank = np.lexsort((text, ids))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        same = np.r_[False, (ids[rank][1:] == ids[rank][:-1]) & (text[rank][1:] == text[rank][:-1])]
        e = _entries(data, off, size, base, length, known, word_bits)
        only = np.zeros(len(ids), bool)  # repeated rows: the first one's place
        only[rank[~same]] = True
        e = e[only[e["row"]]]
        if not len(e):
            return
        e = e[np.lexsort((e["start"], place[e["row"]], e["extra"], e["hash"]))]
        new = _runs(e)
        several = np.diff(np.r_[np.flatnonzero(new), len(e)]) > 1
        again = e[~new] if last else e[several[np.cumsum(new) - 1]]
        if len(again):
            for part, body in _flags(ids, text, again["row"], again["start"], buckets):
                yield _message(part, part, None, body)
        e = e[new]
        bucket = (mix(e["hash"]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((e["start"], e["row"], bucket))
        e, several = e[order], several[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            part = e[cut[b] : cut[b + 1]]
            used, row = np.unique(part["row"], return_inverse=True)
            body = _short(part, last).tobytes() + several[cut[b] : cut[b + 1]].tobytes() + _steps(row.astype("<u4")) + _steps(np.ascontiguousarray(part["start"]))
            yield _message(b, None, _steps(ids[used].astype("<u8")) + text[used].astype("<u4").tobytes(), body)

    def blocks(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """``rows``: id, hash of the text, text, places known."""
        held, size_held = [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            ids, text, body, known = zip(*held, strict=True)
            off = np.cumsum([0, *map(len, body)])
            yield from block(np.array(ids, np.int64), np.array(text, np.int64), np.frombuffer(b"".join(body), np.uint8), off, None if length == base else list(known))

        for row in rows:
            held.append(row)
            size_held += len(row[2])
            if size_held >= BLOCK_BYTES:
                yield from settle()
                held, size_held = [], 0
        if held:
            yield from settle()

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i, h, t in zip(b["id"].to_pylist(), b["text_hash"].to_pylist(), b["text"].cast(pa.large_binary()), strict=True):
                    yield i, h, t.as_py() or b"", None

        yield from blocks(rows())

    def next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from blocks((i, h, text, known) for i, h, text, known in _with_places(batches) if known is not None)

    return first_level if length == base else next_level


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows by part, places before texts -> id, hash of the text, text, the places or None."""
    at, raw, places, unpack = None, [], None, zstandard.ZstdDecompressor()
    for b in batches:
        for part, i, h, body, z in zip(*(b[c].to_pylist() for c in ("part", "id", "text_hash", "body", "z")), strict=True):
            if part != at:
                at, raw, places = part, [], None
            if body is not None:
                raw.append(body)
                continue
            if places is None:
                places, raw = _unflagged(raw), []
            yield i, h, unpack.decompress(z), places.get((i, h))


def _received(last: bool, parts: int):
    """All entries of some buckets, bucket by bucket -> (part, body): places of windows that occur elsewhere (at the last level: earlier)."""
    wide = LONG if last else SHORT
    n_parts = parts

    def settle(parts: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        hashes, several, doc, start, docs, base = [], [], [], [], [], 0
        for ids, body in parts:
            n = len(body) // (wide + 9)
            hashes.append(np.frombuffer(body, np.uint8, n * wide).reshape(n, wide))
            several.append(np.frombuffer(body, bool, n, n * wide))
            doc.append(_unstepped(body, "<u4", n, n * (wide + 1)).astype(np.int64) + base)
            start.append(_unstepped(body, "<u4", n, n * (wide + 5)))
            m = len(ids) // 12
            docs.append(np.stack([_unstepped(ids, "<u8", m, 0).astype(np.int64), np.frombuffer(ids, "<u4", m, m * 8).astype(np.int64)], axis=1))
            base += m
        full = np.zeros((sum(map(len, hashes)), 16), np.uint8)
        full[:, :wide] = np.concatenate(hashes)
        e = np.zeros(len(full), ENTRY)
        e["hash"], e["extra"] = full.view("<u8").T
        # of the many windows that are met once nothing further is needed
        order = np.argsort(e["hash"], kind="stable")
        equal = e["hash"][order][1:] == e["hash"][order][:-1]
        keep = order[np.r_[False, equal] | np.r_[equal, False]]
        if not len(keep):
            return
        table = np.concatenate(docs)
        rank = np.lexsort((table[:, 1], table[:, 0]))
        new = np.r_[True, (table[rank][1:] != table[rank][:-1]).any(axis=1)]
        place = np.empty(len(table), np.int64)
        place[rank] = np.cumsum(new) - 1
        table = table[rank[new]]
        e, several, doc, start = e[keep], np.concatenate(several)[keep], place[np.concatenate(doc)[keep]], np.concatenate(start)[keep]
        order = np.lexsort((start, doc, e["extra"], e["hash"]))
        e, several, doc, start = e[order], several[order], doc[order], start[order]
        fresh = _runs(e)
        # the same place sent twice (a repeated row in two blocks) is the first one too
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        later = (doc != doc[first]) | (start != start[first])
        if not last:
            run = np.cumsum(fresh) - 1
            later = (np.bincount(run, later | several) > 0)[run]
        found = list(_flags(table[:, 0], table[:, 1], doc[later], start[later], n_parts)) if later.any() else []
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["part", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for b in batches:
            local = b.filter(pa.compute.is_valid(b["part"]))
            if local.num_rows:
                yield local.select(["part", "body"])
            rest = b.filter(pa.compute.is_null(b["part"]))
            for bucket, *x in zip(*(rest[c].to_pylist() for c in ("bucket", "ids", "body")), strict=True):
                if bucket != at and parts:
                    yield from settle(parts)
                    parts = []
                at = bucket
                parts.append(tuple(x))
        if parts:
            yield from settle(parts)

    return run


def _packed(parts: int):
    """Texts compressed one by one, with their part; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [pack.compress(t.as_py() or b"") for t in b["text"].cast(pa.large_binary())]
            part = part_of(b["id"].to_numpy(), b["text_hash"].to_numpy(), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part), b["id"], b["text_hash"], pa.array(z, pa.binary())], names=["part", "id", "text_hash", "z"])

    return run


def _cleaned(size: int):
    """A document's places and its text -> counts and the words that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 5
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

        held = 0
        for i, _, text, where in _with_places(batches):
            words = text.split()  # bytes.split() parts at exactly 0x20 and 0x09-0x0D
            gone = 0
            if where is not None:
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, where, 1)
                np.add.at(cover, where + size, -1)
                keep = np.cumsum(cover)[:-1] == 0
                gone = int(len(words) - keep.sum())
                words, n = [w for w, k in zip(words, keep.tolist(), strict=True) if k], len(words)
            else:
                n = len(words)
            left = b" ".join(words)
            rows.append((i, n, gone, left.decode(), hashlib.sha256(left).hexdigest()))
            held += len(left)
            if held > BLOCK_BYTES:
                yield out()
                held = 0
        yield out()

    return run


@tidy
def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, base: int | None = None, word_bits: int = 64) -> DataFrame:
    """id, n_words, n_removed, kept_text, kept_sha256; one row per row of ``docs``.

    ``size``: words of a window; ``base``: those of the first level's, ``size``
    halved once or several times; ``word_bits``: of a word's first hash.
    """
    base = base or size // 2
    least = -(2**63)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(2**32)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    # as many parts of the documents as buckets of hashes
    buckets = int(min(MOST_BUCKETS, max(16, chars // BUCKET_CHARS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))

    def texts_with(found: DataFrame) -> DataFrame:
        packed = own.mapInArrow(_packed(buckets), "part long, id long, text_hash long, z binary")
        both = packed.unionByName(found, allowMissingColumns=True)
        return both.repartition("part").sortWithinPartitions("part", F.col("body").isNull()).select("part", "id", "text_hash", "body", "z")

    found = None
    for length in lengths(size, base):
        sent = (own if found is None else texts_with(found)).mapInArrow(_sent(size, base, length, buckets, word_bits), MESSAGE)
        found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_received(length == size, buckets), "part long, body binary")
        found = materialize(found, f"repeats-{length}")
        if found.isEmpty():  # no candidates survive
            break
    made = texts_with(found).mapInArrow(_cleaned(size), "id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return made.withColumn("id", F.when(F.col("id") != least, F.col("id"))).withColumnRenamed("id", id_col)
