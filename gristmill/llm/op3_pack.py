"""Vector bin packing of tokenised examples into fixed-length sequences.

An example asks for tokens, one segment and loss-bearing tokens (its last
ones); a sequence has a limit on each. Among the examples of a bounded pool
that still fit, the one whose demand has the largest dot product with what is
left of the sequence goes in next. When none fits, one may be cut so that it
fills the rest exactly. What a partition has left at its end is laid out in
sequences whose lengths are powers of two, which need no padding.

Each partition of the input is packed by itself: no state beyond the pool, and
the same result when a task runs again. Documents need no shuffle.

Defined results: null text is empty and has the end id alone; repeated rows are
packed each time; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder

END_ID = 1
#: Documents of one sequence, at most, and turns of a conversation that are dealt together.
SEGMENTS, BLOCK = 64, 256
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, doc_loss long, sequence_id long, offset long"


class Packer:
    """Places examples (key, tokens, loss-bearing tokens) under limits on tokens, segments and loss-bearing tokens.

    ``add`` and ``finish`` yield sequences: lists of (key, start, length).
    """

    def __init__(self, tokens: int = 2048, segments: int = 256, loss: int | None = None, pool: int = 512, cut: bool = True):
        self.limit = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.pool, self.cut, self.n = pool, cut, 0
        self.keys: list = [None] * (pool + 1)
        self.left = np.zeros((pool + 1, 3))  # tokens, segments, loss-bearing tokens still to place
        self.start = np.zeros(pool + 1, np.int64)

    def add(self, key, tokens: int, loss: int) -> Iterator[list]:
        if tokens <= 0:
            return
        if not self.cut and (tokens > self.limit[0] or loss > self.limit[2]):
            raise ValueError("an example that may not be cut is larger than a sequence")
        n = self.n
        self.keys[n], self.left[n], self.start[n] = key, (tokens, 1, loss), 0
        self.n += 1
        while self.n and self.left[self.n - 1, 0] >= self.limit[0] and self.cut:  # whole sequences of one long example
            take = self._most(self.n - 1, self.limit)
            if take < self.limit[0]:
                break
            yield [self._take(self.n - 1, take)]
        if self.n >= self.pool:
            while self.n > self.pool // 2:
                yield from self._sequence()

    def finish(self) -> Iterator[list]:
        while self.n:
            yield from self._sequence()

    def _most(self, i: int, room: np.ndarray) -> int:
        """Tokens of example i that fit: those without loss first, then as many with loss as there is room for."""
        t, _, loss = self.left[i]
        return int(min(t, room[0], t - loss + room[2]))

    def _take(self, i: int, length: int) -> tuple:
        piece = (self.keys[i], int(self.start[i]), length)
        self.start[i] += length
        self.left[i, 0] -= length
        self.left[i, 2] = min(self.left[i, 2], self.left[i, 0])
        if self.left[i, 0] <= 0:
            self.n -= 1
            j = self.n
            self.keys[i], self.left[i], self.start[i] = self.keys[j], self.left[j], self.start[j]
            self.keys[j] = None
        return piece

    def _sequence(self) -> Iterator[list]:
        room, pieces = self.limit.copy(), []
        while self.n and room[0] > 0 and room[1] > 0:
            left = self.left[: self.n]
            fits = (left <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, left @ (room / self.limit**2), -1.0)))
                take = int(left[i, 0])
            elif self.cut:
                i = int(np.argmax(left[:, 0] - left[:, 2] * (room[2] <= 0)))
                if (take := self._most(i, room)) <= 0:
                    break
            else:
                break
            room -= (take, 1, max(0, left[i, 2] - (left[i, 0] - take)))
            pieces.append(self._take(i, take))
        total = int(self.limit[0] - room[0])
        if not self.cut or total == self.limit[0]:
            yield pieces
        else:
            yield from in_powers(pieces, total)


def in_powers(pieces: list[tuple], total: int) -> Iterator[list]:
    """Cut one sequence into sequences whose lengths are the powers of two that add up to it."""
    for bit in range(total.bit_length() - 1, -1, -1):
        want, out = total & (1 << bit), []
        while want:
            key, start, length = pieces.pop(0)
            use = min(want, length)
            out.append((key, start, use))
            if use < length:
                pieces.insert(0, (key, start + use, length - use))
            want -= use
        if out:
            yield out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048, segments: int = SEGMENTS, vocabulary: str = "byte_bpe_50k", folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole texts, add ``end_id``, pack; every token bears loss. One row per piece."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("answer"))
    return _packed(own, tokens, segments, None, vocabulary, folder, end_id).drop("doc_loss").withColumnRenamed("id", id_col)


def _exchanges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered rows by conversation and turn -> exchanges: what comes before an answer, and the answer; what no answer follows has none."""
    at, said, number = None, [], 0
    made: list[tuple] = []

    def closed(answer: str) -> None:
        nonlocal said, number
        if said or answer:
            made.append((at[0], at[1] * BLOCK + number, "".join(said), answer))
            said, number = [], number + 1

    def out() -> pa.RecordBatch:
        cols = list(zip(*made, strict=True)) or [()] * 4
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "exchange", "text", "answer"])

    for b in batches:
        for conv, block, role, text in zip(*(b[c].to_pylist() for c in ("conv", "block", "role_pred", "rendered")), strict=True):
            if (conv, block) != at:
                if at is not None:
                    closed("")
                at, number = (conv, block), 0
            if role == "assistant":
                closed(f"{text or ''}\n")
            else:
                said.append(f"{text or ''}\n")
        if len(made) > 1024:
            yield out()
    if at is not None:
        closed("")
    yield out()


def pack_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", tokens: int = 2048, segments: int = 16, loss: int = 1024, vocabulary: str = "byte_bpe_50k", folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack instruction data under limits on tokens, segments and loss-bearing tokens: ``turns`` as ``parse_transcripts`` returns them.

    An example is an exchange: what was said since the last answer, and the
    answer with ``end_id``, whose ids alone bear loss. One row per piece:
    conv_id, exchange, then as for documents, and ``loss``, the piece's
    loss-bearing ids. Conversations are dealt in blocks of BLOCK turns, at which
    an exchange ends. Null text is empty; null turns come first; equal turns are
    ordered by their text.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), "role_pred", "rendered").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)))
    rows = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "rendered").select("conv", "block", "role_pred", "rendered")
    own = rows.mapInArrow(_exchanges, "id long, exchange long, text string, answer string")
    own = own.select(F.struct("id", "exchange").alias("id"), "text", "answer")
    made = _packed(own, tokens, segments, loss, vocabulary, folder, end_id)
    bears = F.col("doc_tokens") - F.col("doc_loss")
    return made.select(F.col("id.id").alias(conv_col), "id.exchange", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", bears)).alias("loss"))


def _packed(own: DataFrame, tokens: int, segments: int, loss: int | None, vocabulary: str, folder: str | None, end_id: int) -> DataFrame:
    """Pack rows (id, text, answer); without an answer all ids bear loss if there is no limit on loss, and none if there is."""
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = encoder(vocabulary, folder), Packer(tokens, segments, loss)
        sequence = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # by arrival: id, ids, tokens not yet placed
        arrived, id_type = 0, None
        rows: list[tuple] = []

        def placed(sequences: Iterator[list]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for key, start, length in pieces:
                    doc = held[key]
                    rows.append((doc[0], start, length, zlib.crc32(doc[1][start : start + length].tobytes()), len(doc[1]), doc[3], sequence, offset))
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[key]
                sequence += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["id", "start", "length", "ids_crc32", "doc_tokens", "doc_loss", "sequence_id", "offset"])

        for b in batches:
            id_type = b["id"].type
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                answers = part["answer"].to_pylist()
                told = model.encode([t or "" for t in part["text"].to_pylist()])
                said = model.encode([t or "" for t in answers])
                for doc, ids, answer, text in zip(part["id"].to_pylist(), told, said, answers, strict=True):
                    ids = np.concatenate([ids, answer, [end_id]]).astype("<u4")
                    bears = len(ids) if loss is None else len(answer) + 1 if text else 0
                    held[arrived] = [doc, ids, len(ids), bears]
                    placed(packer.add(arrived, len(ids), bears))
                    arrived += 1
                if len(rows) > 4096:
                    yield batch()
        placed(packer.finish())
        if rows:
            yield batch()

    return own.mapInArrow(run, f"id {kind}, {PIECES}")
