"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the number of times that the mix repeats it. Among
all rates from 0 to ``cap`` that meet the constraints, entropy balancing takes
those closest (Kullback-Leibler, weighted by words) to taking everything once.
There is a constraint for the words of each source, which is held, and one for
the length of documents, which is held as far as that allows: the mean log
length of the mix's words shall be the corpus's, so that a source that is
raised or lowered does not make texts longer or shorter. The solution is an
exponential tilt, min(cap, exp(lambda_source + theta * length)).

The convex dual is solved by Newton steps. Each step is one aggregate over the
distinct (source, size) pairs, for gradient and Hessian together; the Hessian
couples sources only through the length, so that the sources' duals are
eliminated where they are and a handful of sums reaches the driver. A step that
does not lower the dual is halved. Sums are of whole numbers, so reruns agree to
the last bit.

Rates are rounded to whole copies: every document has the whole part, and one
copy more goes to those whose hashed id, divided by the rest of the rate, lies
below a threshold of their source (near 1), found by refining distributed
histograms. Then single copies are added or taken away, one per source and
round, where that brings the words nearer the target. What is still missing or
too much after that, less than any whole copy can mend, is taken as part of a
copy of one document of the source (``partial``). These changes are a small
table that is joined once.

Defined results: null text has size 0; null is a source of its own, the last
one; a source without words has target 0 and no copies; repeated rows count
each time and get the same copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, narrow, tidy
from .textops import buffers, chunks, spans

CELL_BITS, LEVELS, CORRECTIONS = 12, 3, 4
#: Newton steps at most, the change that ends them, and how soft the constraint on length is.
STEPS, ENOUGH, SOFT = 40, 1e-9, 0.05
#: Sums are of whole multiples of 1 / UNIT.
UNIT = 1 << 20


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b["text"])
        size = [np.diff(spans(data, off[i : j + 1])[2]) for i, j in chunks(off)]
        yield pa.RecordBatch.from_arrays([b["id"], b["source"], pa.array(np.concatenate(size or [np.zeros(0, np.int64)]), pa.int64())], names=["id", "source", "size"])


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_sizes, f"id {own.schema['id'].dataType.simpleString()}, source string, size long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all words by repeating weights, held at ``cap`` times a source's words."""
    every = materialize(narrow(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    # one row per source, after aggregation
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    every = materialize(every.withColumn("weight", weight), "mix-weights")
    total = (every.agg(F.sum("source_size")).first()[0] or 0) * share
    most, level, held = F.col("source_size") * cap, 0.0, -1
    while True:  # the excess over a cap goes to the others, until the number of sources at theirs stays the same
        full = F.col("weight") * F.lit(level) >= most
        got = every.agg(F.sum(F.when(full, most)).alias("a"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.sum(full.cast("long")).alias("n")).first()
        if (got["n"] or 0) == held or not got["w"]:
            break
        held = got["n"] or 0
        level = (total - (got["a"] or 0.0)) / got["w"]
    return every.select("source", "source_size", F.least(most, F.col("weight") * F.lit(level)).alias("target"))


def _sum(x: Column) -> Column:
    """A sum that does not depend on the order of its terms."""
    return F.sum(F.round(x * UNIT).cast("decimal(38,0)")).cast("double") / UNIT


class Dual:
    """The dual of the constraints over ``cells`` (s, size, n): rows with one source and size.

    ``plan``: (s, source_size, target). Sources at ``cap``, or with target 0,
    have a fixed rate and no dual variable.
    """

    def __init__(self, cells: DataFrame, plan: DataFrame, cap: float):
        self.cap = cap
        words, long = F.col("size") * F.col("n"), F.log(F.greatest("size", F.lit(1)).cast("double"))
        w, m, q = cells.agg(_sum(words), _sum(words * long), _sum(words * long * long)).first()
        self.words = w or 0.0
        self.mean = m / w if w else 0.0
        self.wide = float(np.sqrt(max(q / w - self.mean**2, 0.0))) if w else 0.0
        self.cells = cells.withColumn("w", words.cast("double"))
        free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
        self.plan = plan.withColumn("free", free).withColumn("fixed", F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0))

    def length(self) -> Column:
        """A document's log length, less the corpus's mean, in standard deviations."""
        return (F.log(F.greatest("size", F.lit(1)).cast("double")) - self.mean) / (self.wide or 1.0)

    def rate(self, theta: float) -> Column:
        return F.when(F.col("free"), F.least(F.lit(float(self.cap)), F.exp(F.col("lam") + theta * self.length()))).otherwise(F.col("fixed"))

    def evaluated(self, state: DataFrame, theta: float) -> DataFrame:
        """One aggregate: (s, lam, target, free, value, r, h, c, x, q) for each source; the sums of words times 1: dual, rate, curvature; with length: curvature, rate; its square: curvature."""
        rows = self.cells.join(state, self.cells["s"].eqNullSafe(state["s"])).drop(self.cells["s"])
        x, top = self.length(), float(np.log(self.cap))
        eta = F.col("lam") + theta * x
        rows = rows.withColumn("x", x).withColumn("rate", self.rate(theta)).withColumn("bend", F.when(F.col("free") & (eta < top), F.col("rate")).otherwise(0.0))
        value = F.when(~F.col("free"), F.col("fixed") * theta * x).when(eta < top, F.exp(eta) - 1).otherwise(self.cap * (eta - top) + self.cap - 1)
        w = F.col("w")
        sums = {"value": value, "r": F.col("rate"), "h": F.col("bend"), "c": F.col("bend") * F.col("x"), "x": F.col("rate") * F.col("x"), "q": F.col("bend") * F.col("x") * F.col("x")}
        return rows.groupBy("s", "lam", "target", "free").agg(*(_sum(w * v).alias(k) for k, v in sums.items()))

    def solve(self) -> tuple[DataFrame, float]:
        """(s, lam) of all sources, and theta."""
        state = materialize(self.plan.withColumn("lam", F.when(F.col("free"), F.log(F.col("target") / F.col("source_size"))).otherwise(0.0)), "mix-dual")
        theta, size, best = 0.0, 1.0, None
        soft, small = SOFT * self.words, 1e-9
        if not self.words:
            return state, theta
        for _ in range(STEPS):
            here = materialize(narrow(self.evaluated(state, theta)), "mix-newton")
            g, h = F.col("r") - F.col("target"), F.col("h") + small
            free = F.col("free")
            got = here.agg(
                _sum(F.col("value") - F.when(free, F.col("target") * F.col("lam")).otherwise(0.0)).alias("value"), _sum(F.col("x")).alias("x"), _sum(F.col("q")).alias("q"),
                _sum(F.when(free, F.col("c") * F.col("c") / h).otherwise(0.0)).alias("cc"), _sum(F.when(free, F.col("c") * g / h).otherwise(0.0)).alias("cg"), F.max(F.when(free, F.abs(g)).otherwise(0.0)).alias("off"),
            ).first()
            value = got["value"] + 0.5 * soft * theta**2
            if best is not None and value > best[0] + 1e-9 * self.words:
                if size < 1e-4:
                    state, theta = best[1], best[2]
                    break
                size /= 2  # back to half the step
                state, theta = materialize(self._moved(best[3], best[4], size), "mix-dual"), best[2] + size * best[4]
                continue
            grad = got["x"] + soft * theta
            step = float(np.clip(-(grad - got["cg"]) / max(got["q"] - got["cc"] + soft, small), -1, 1))
            best, size = (value, state, theta, here, step), 1.0
            if max(abs(step), got["off"] / self.words) < ENOUGH:
                break
            state, theta = materialize(self._moved(here, step), "mix-dual"), theta + step
        return state, theta

    def _moved(self, here: DataFrame, step: float, size: float = 1.0) -> DataFrame:
        change = -(F.col("r") - F.col("target") + F.col("c") * step) / (F.col("h") + 1e-9)
        lam = F.when(F.col("free"), F.col("lam") + size * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), change))).otherwise(F.col("lam"))
        moved = here.select(F.col("s").alias("m"), lam.alias("lam"))
        return self.plan.join(moved, F.col("s").eqNullSafe(F.col("m"))).drop("m")


def tilted(sized: DataFrame, plan: DataFrame, cap: float) -> tuple[DataFrame, Dual, float]:
    """``plan`` with each source's dual variable, the dual, and that of the length."""
    cells = materialize(narrow(sized.groupBy(F.col("source").alias("s"), "size").agg(F.count(F.lit(1)).alias("n"))), "mix-cells")
    dual = Dual(cells, plan.withColumnRenamed("source", "s"), cap)
    state, theta = dual.solve()
    return state, dual, theta


@tidy
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, partial: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, rate, copies, part, taken = copies * size + part (words of a partial copy)."""
    sized = materialize(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    state, dual, theta = tilted(sized, materialize(targets(sized, weights, share, cap), "mix-plan"), cap)
    bits = CELL_BITS * LEVELS
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "size"), 64 - bits)
    rows = sized.join(state, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", F.round(dual.rate(theta), 9)).withColumn("draw", drawn).drop("s", "free", "fixed", "lam")
    rows = rows.withColumn("base", F.floor(F.col("rate")))
    # a copy more where this lies below the source's threshold; 1 stands at a quarter of the range
    rest = F.col("rate") - F.col("base")
    rows = rows.withColumn("v", F.when(rest > 0, F.least(F.lit(2**bits - 1), F.floor(F.col("draw") / rest / 4))))
    rows = materialize(rows, "mix-rows")

    # for each source: documents with v below `below` get one more copy; `need` words are still missing
    state = rows.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need")).withColumn("below", F.lit(0).cast("long"))
    state = materialize(narrow(state), "mix-state")
    for level in range(1, LEVELS + 1):
        width = bits - CELL_BITS * level
        here = rows.join(state, F.col("source").eqNullSafe(F.col("s"))).filter(F.shiftright("v", width + CELL_BITS) == F.shiftright("below", width + CELL_BITS))
        cells = here.groupBy("s", "below", "need", F.shiftright("v", width).alias("cell")).agg(F.sum("size").alias("words"))
        up_to = F.sum("words").over(Window.partitionBy("s").orderBy("cell"))
        # the first cell that passes what is needed is refined; if none does, all of them are taken
        crossing = cells.withColumn("up_to", up_to).groupBy("s", "below", "need").agg(
            F.min(F.when(F.col("up_to") > F.col("need"), F.struct("cell", F.col("up_to").alias("passed"), F.col("words").alias("over")))).alias("x"), F.sum("words").alias("all"))
        end = F.shiftleft(F.shiftright("below", width + CELL_BITS) + 1, width + CELL_BITS)
        found = crossing.select("s", F.when(F.col("x").isNull(), end).otherwise(F.shiftleft("x.cell", width)).alias("next"), F.when(F.col("x").isNull(), F.col("need") - F.col("all")).otherwise(F.col("need") - F.col("x.passed") + F.col("x.over")).alias("left"))
        found = state.alias("a").join(found.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")), "left")
        # one row per source on both sides
        state = materialize(narrow(found.select("a.s", F.coalesce("next", "below").alias("below"), F.coalesce("left", "need").alias("need"))), "mix-state")
    copies = F.least(F.lit(cap), F.col("base") + F.coalesce(F.col("v") < F.col("below"), F.lit(False)).cast("long"))
    rows = rows.join(state, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.greatest(F.lit(0), copies).cast("long")).drop("s", "below", "need", "base", "v")
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))
    rows = _changed(rows, _corrections(rows, cap, partial))
    # a part is what exceeds whole copies
    whole = F.when((F.col("size") > 0) & (F.col("change") != 0), F.floor(F.col("taken") / F.col("size"))).otherwise(F.col("copies")).cast("long")
    return rows.withColumn("copies", whole).select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("taken") - F.col("copies") * F.col("size")).alias("part"), "taken")


def _changed(rows: DataFrame, changes: DataFrame | None) -> DataFrame:
    """``rows`` with the words that ``changes`` (s, at, d, words) add to or take from single documents."""
    if changes is None:
        return rows.withColumn("change", F.lit(0).cast("long"))
    # one row for each document that is changed
    total = changes.groupBy("s", "at", "d").agg(F.sum("words").alias("change"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("at")) & (F.col("draw") == F.col("d"))
    return rows.join(total, same, "left").drop("s", "at", "d").withColumn("change", F.coalesce("change", F.lit(0).cast("long"))).withColumn("taken", F.col("taken") + F.col("change"))


def _corrections(rows: DataFrame, cap: float, partial: bool) -> DataFrame | None:
    """(s, at, d, words): in each source and round, one copy more or less of the document whose size is nearest what is missing, if that helps; then part of one."""
    changes = None
    for last in [False] * CORRECTIONS + [True] * partial:
        now = _changed(rows, changes)
        missing = now.groupBy("source").agg(F.round(F.first("target") - F.sum("taken")).cast("long").alias("missing")).withColumnRenamed("source", "s")
        missing = materialize(narrow(missing.filter("missing <> 0")), "mix-missing")
        near = now.join(missing, F.col("source").eqNullSafe(F.col("s")))
        sign = F.signum("missing").cast("long")
        if last:
            room = F.when(F.col("missing") > 0, F.col("size") * cap - F.col("taken")).otherwise(F.col("taken"))
            can, first, words = room >= F.abs("missing"), F.col("size"), F.col("missing")
        else:
            off = F.abs(F.abs("missing") - F.col("size"))
            can = (F.col("size") > 0) & (F.col("taken") + sign * F.col("size")).between(0, F.col("size") * cap) & (off < F.abs("missing"))
            first, words = off, sign * F.col("size")
        # of equally good ones, one draw is taken; rows that share id and draw change together
        best = near.filter(can).groupBy("s").agg(F.min(F.struct(first.alias("first"), "draw", F.col("id").alias("at"), words.alias("words"))).alias("best"))
        best = materialize(narrow(best.select("s", "best.at", F.col("best.draw").alias("d"), "best.words")), "mix-best")
        if best.isEmpty():
            continue
        changes = best if changes is None else changes.unionByName(best)
    return changes if changes is None else materialize(changes, "mix-changes")
