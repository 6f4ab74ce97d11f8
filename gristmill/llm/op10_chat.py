"""Chat formatting: roles recovered from transcripts, and canonical turns.

A transcript is a sequence of lines. Hidden states are the roles; a line is
observed through the speaker marker that it begins with, if any, and through
features of the line (length, marks at its end, bullets, place in its row and
in the conversation). Emissions and the transitions from row to row are
estimated from labelled rows of the training folds, and so are how often a
marker tells the truth and how rarely the speaker changes without one inside a
row. Viterbi finds the most likely roles, and consecutive
lines of one speaker are rendered as one turn without their marker:
``<|role|>``, line end, text, line end, ``<|end|>``.

The recursion runs over blocks of BLOCK turns. For a conversation of several
blocks a first pass reduces each block to the best score between each state
before it and each state at its end (a product in the max-plus semiring); these
small matrices are chained forwards and backwards, and each block is decoded
with what the rest of the conversation says about its two ends. No task holds
more than one block.

Defined results: null text is one empty line; null turns come first; rows with
equal turns are ordered by their text; repeated rows are turns of their own;
a null conversation id is one conversation; ``role`` is never an input of the
decoding, only a label in training, and roles outside ROLES are not learned
from; without training rows emissions are uniform; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold
from .store import materialize, tidy

ROLES = ("system", "user", "assistant")
BLOCK, FOLDS = 256, 5
#: Speaker names as transcripts have them. Fixed values.
SPEAKERS = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "agent": 2, "a": 2, "answer": 2}
MARKER = re.compile(r"^\s*(?:<\|im_start\|>\s*(\w+)\s*$|<\|(?!im_)(\w+)\|>|\[(\w+)\]:?|#{1,6}\s*(\w+)\s*:?\s*$|\**(\w+)\**\s*:\**(?=\s|$))[ \t]?", re.I)
CLOSER = re.compile(r"^\s*(?:<\|im_end\|>|<\|end\|>|<\|eot_id\|>)\s*$")
FEATURES = (10, 6, 3, 5, 4)  # values of: length, last mark, bullet or quote, lines in the row, place of the row
#: Before anything is counted: lines that did not change the speaker without a marker, and markers that told the truth and that did not.
STAYED, TRUE, FALSE = 10_000, 49.0, 0.5
#: Kinds of counts beside those of FEATURES.
BEGIN, MOVE, TOLD, KEPT = -2, -1, -3, -4


def marker(line: str) -> tuple[int, str]:
    """The state that the line's speaker marker names (-1: no marker), and the line without it."""
    m = MARKER.match(line)
    if not m:
        return -1, line
    name = next(g for g in m.groups() if g).lower()
    return (SPEAKERS[name], line[m.end() :]) if name in SPEAKERS else (-1, line)


def observed(text: str, place: int) -> list[tuple]:
    """(marker, line without it, features) of each line of a row; ``place``: 0 for the first row of a conversation."""
    lines = text.split("\n")
    out = []
    for k, line in enumerate(lines):
        said, rest = marker(line)
        end = rest.rstrip()[-1:]
        mark = "?!.:,".find(end) + 1 if end else 0
        bullet = 1 if rest.lstrip()[:1] in ("-", "*", "•") else 2 if rest.lstrip()[:1] in (">", "`") else 0
        out.append((said, rest, (min(9, len(rest).bit_length()), mark, bullet, min(4, len(lines).bit_length() - 1), min(3, place)), k == 0))
    return out


class Model:
    """Log probabilities: where a conversation begins, from row to row, and of each feature's values."""

    def __init__(self, counts: dict[tuple[int, int, int], int]):
        n = len(ROLES)
        begin, move, told, stayed = np.ones(n), np.ones((n, n)), np.full((n, n), FALSE) + np.eye(n) * (TRUE - FALSE), STAYED
        seen = [np.ones((n, v)) for v in FEATURES]
        for (kind, i, j), c in counts.items():
            if kind == BEGIN:
                begin[j] += c
            elif kind == MOVE:
                move[i, j] += c
            elif kind == TOLD:
                told[i, j] += c
            elif kind == KEPT:
                stayed += c
            else:
                seen[kind][i, j] += c
        self.begin = np.log(begin / begin.sum())
        self.move = np.log(move / move.sum(axis=1, keepdims=True))
        self.seen = [np.log(x / x.sum(axis=1, keepdims=True)) for x in seen]
        # labelled rows have one speaker, so a change without a marker has not been seen
        stay = np.full((n, n), 1 / (stayed + 1) / (n - 1))
        np.fill_diagonal(stay, stayed / (stayed + 1))
        self.stay, self.free = np.log(stay), np.zeros((n, n))
        self.told = np.log(told / told.sum(axis=1, keepdims=True))

    def step(self, line: tuple, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Transition into the line and its emission; ``first``: no line of the conversation came before."""
        said, _, values, new_row = line
        emit = sum(t[:, v] for t, v in zip(self.seen, values, strict=True)) if new_row else np.zeros(len(ROLES))
        if said >= 0:
            emit = emit + self.told[:, said]
        move = self.move if new_row else self.free if said >= 0 else self.stay
        return (np.tile(self.begin, (len(ROLES), 1)) if first else move), emit

    def matrix(self, lines: list[tuple], first: bool) -> np.ndarray:
        """Best score from each state before the lines to each state at their end."""
        out = None
        for k, line in enumerate(lines):
            move, emit = self.step(line, first and k == 0)
            m = move + emit
            out = m if out is None else (out[:, :, None] + m[None]).max(axis=1)
        return out

    def viterbi(self, lines: list[tuple], before: np.ndarray | None, after: np.ndarray) -> list[int]:
        """Most likely states, given scores of the states before (None: the conversation begins) and of those after."""
        score, back = np.zeros(len(ROLES)) if before is None else before, []
        for k, line in enumerate(lines):
            move, emit = self.step(line, before is None and k == 0)
            m = score[:, None] + move
            back.append(m.argmax(axis=0))
            score = m.max(axis=0) + emit
        state = int((score + after).argmax())
        path = [state]
        for b in back[:0:-1]:
            state = int(b[state])
            path.append(state)
        return path[::-1]


def render(lines: list[tuple], path: list[int]) -> tuple[str, list[str]]:
    """Canonical turns of a row's lines, and their roles."""
    turns: list[tuple[int, list[str]]] = []
    for (said, rest, _, _), state in zip(lines, path, strict=True):
        if CLOSER.match(rest) and turns:
            continue
        if not turns or said >= 0 or state != turns[-1][0]:
            turns.append((state, []))
        turns[-1][1].append(rest)
    text = "\n".join("<|%s|>\n%s\n<|end|>" % (ROLES[s], "\n".join(x).strip()) for s, x in turns)
    return text, [ROLES[s] for s, _ in turns]


def _blocks(batches: Iterator[pa.RecordBatch], cols: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows with equal (conv, block), which come sorted."""
    at, rows = None, []
    for b in batches:
        for conv, block, *row in zip(*(b[c].to_pylist() for c in ("conv", "block", *cols)), strict=True):
            if (conv, block) != at:
                if rows:
                    yield at, rows
                at, rows = (conv, block), []
            rows.append(tuple(row))
    if rows:
        yield at, rows


def _lines(rows: list[tuple], start: bool) -> list[list[tuple]]:
    return [observed(text or "", k if start else 3) for k, (text, *_) in enumerate(rows)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int, int], int] = {}
    for _, rows in _blocks(batches, ("text", "role", "start")):
        before = None
        for lines, (_, role, start) in zip(_lines(rows, rows[0][2]), rows, strict=True):
            state = ROLES.index(role) if role in ROLES else None
            if state is not None:
                if before is not None or (start and lines[0][2][4] == 0):
                    key = (BEGIN, 0, state) if before is None else (MOVE, before, state)
                    total[key] = total.get(key, 0) + 1
                if lines[0][0] >= 0:
                    total[TOLD, state, lines[0][0]] = total.get((TOLD, state, lines[0][0]), 0) + 1
                if len(lines) > 1 and all(said < 0 for said, *_ in lines[1:]):
                    total[KEPT, 0, 0] = total.get((KEPT, 0, 0), 0) + len(lines) - 1
                for f, v in enumerate(lines[0][2]):
                    total[f, state, v] = total.get((f, state, v), 0) + 1
            before = state
    cols = list(zip(*[(*k, n) for k, n in total.items()], strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["kind", "i", "j", "n"])


def _matrices(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _blocks(batches, ("text", "start")):
            start = rows[0][1]
            m = model.matrix([x for lines in _lines(rows, start) for x in lines], start)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([m.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["conv", "block", "m"])

    return run


def _chained(forward: bool):
    """Scores of the states before each block (or after it, blocks from last to first)."""
    n = len(ROLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, score = None, None
        for b in batches:
            out = []
            for conv, raw in zip(b["conv"].to_pylist(), b["m"].to_pylist(), strict=True):
                if (conv,) != at:
                    at, score = (conv,), np.zeros(n)
                out.append(score.tolist())
                m = np.array(raw).reshape(n, n)
                score = (score[:, None] + m).max(axis=0) if forward else (m + score[None]).max(axis=1)
                score = score - score.max()
            yield pa.RecordBatch.from_arrays([b["conv"], b["block"], pa.array(out, pa.list_(pa.float64()))], names=["conv", "block", "score"])

    return run


def _decoded(model: Model):
    n = len(ROLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            c = list(zip(*held, strict=True)) or [()] * 8
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["conv", "turn", "role", "role_pred", "roles", "n_lines", "n_turns", "rendered"])

        for (conv, _), rows in _blocks(batches, ("text", "start", "turn", "role", "before", "after")):
            start = rows[0][1]
            parts = _lines(rows, start)
            before = None if start else np.array(rows[0][4]) if rows[0][4] else np.zeros(n)
            after = np.array(rows[0][5]) if rows[0][5] else np.zeros(n)
            path = model.viterbi([x for lines in parts for x in lines], before, after)
            at = 0
            for lines, (_, _, turn, role, _, _) in zip(parts, rows, strict=True):
                text, roles = render(lines, path[at : at + len(lines)])
                held.append((conv, turn, role, ROLES[path[at]], roles, len(lines), len(roles), text))
                at += len(lines)
            if len(held) > 1024:
                yield out()
        yield out()

    return run


@tidy
def parse_transcripts(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role", folds: int = FOLDS) -> DataFrame:
    """One row per row: conv_id, turn, role (as given), role_pred, roles, n_lines, n_turns, rendered, held_out."""
    role = F.col(role_col).cast("string") if role_col else F.lit(None).cast("string")
    own = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"), role.alias("role"))
    own = own.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**40))))
    first = materialize(own.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("last")), "chat-ends")
    long = first.filter("first < last")
    # conversations of one block need nothing from others; the few long ones are looked up
    begins = long.select(F.col("conv").alias("c"), F.col("first").alias("f"))
    own = own.join(begins, F.col("conv").eqNullSafe(F.col("c")), "left").withColumn("start", F.col("f").isNull() | (F.col("f") == F.col("block"))).drop("c", "f")
    order = ("conv", "block", "turn", "text")
    dealt = own.repartition("conv", "block").sortWithinPartitions(*order)
    learned = dealt.filter((fold("conv", folds) != 0) & F.col("role").isNotNull()).select("conv", "block", "text", "role", "start")
    found = learned.mapInArrow(_counts, "kind int, i int, j int, n long").groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect()  # one row per kind and value
    model = Model({(r["kind"], r["i"], r["j"]): r["n"] for r in found})

    parts = own.join(long.select(F.col("conv").alias("c")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    m = parts.repartition("conv", "block").sortWithinPartitions(*order).select("conv", "block", "text", "start").mapInArrow(_matrices(model), "conv long, block long, m array<double>")
    m = materialize(m, "chat-blocks").repartition("conv")
    ends = "conv long, block long, score array<double>"
    before = materialize(m.sortWithinPartitions("conv", "block").mapInArrow(_chained(True), ends), "chat-before")
    after = materialize(m.sortWithinPartitions("conv", F.desc("block")).mapInArrow(_chained(False), ends), "chat-after")
    both = before.select(F.col("conv").alias("c"), F.col("block").alias("k"), F.col("score").alias("before")).join(after.select(F.col("conv").alias("c2"), F.col("block").alias("k2"), F.col("score").alias("after")), F.col("c").eqNullSafe(F.col("c2")) & (F.col("k") == F.col("k2"))).select("c", "k", "before", "after")
    told = own.join(both, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")), "left")
    made = told.repartition("conv", "block").sortWithinPartitions(*order).mapInArrow(_decoded(model), "conv long, turn long, role string, role_pred string, roles array<string>, n_lines long, n_turns long, rendered string")
    return made.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "role", "role_pred", "roles", "n_lines", "n_turns", "rendered", F.coalesce(fold("conv", folds) == 0, F.lit(False)).alias("held_out"))
