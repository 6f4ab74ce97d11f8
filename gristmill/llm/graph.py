"""Connected components of an edge table.

Each round first contracts the edges of every partition by themselves, then
sends every node's neighbours to the smallest of them (large-star and
small-star steps). As soon as at most TASK_EDGES edges are left, one task ends
the work, in memory bounded by that number; with more nodes than that the
rounds go on until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, narrow, tidy

TASK_EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, for edges in memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges -> every node and the smallest node of its component."""
    held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    if held:
        nodes, low = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(low, pa.int64())], names=["node", "component"])


def _contracted(most: int):
    """Edges of a partition -> edges from each node to its smallest, stretch by stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> tuple[np.ndarray, np.ndarray]:
            nodes, low = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return nodes[nodes != low], low[nodes != low]

        def out(x: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], names=["u", "v"])

        for b in batches:
            held.append((b["u"].to_numpy(), b["v"].to_numpy()))
            if sum(len(x) for x, _ in held) > 2 * most:
                held = [settle()]
                if len(held[0][0]) > most:
                    yield out(held[0])
                    held = []
        if held:
            yield out(settle())

    return run


@tidy
def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every endpoint of an edge between two nodes; component is the smallest node that can be reached.

    Minima are aggregated before the shuffle and joined back, so a node with
    very many neighbours is never gathered in one task.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "edges")
    before = None
    while True:
        n = e.count()
        if n <= task_edges:
            return materialize(e.coalesce(1).mapInArrow(_settled, "node long, component long"), "components")
        e = materialize(narrow(e.mapInArrow(_contracted(max(1, task_edges)), "u long, v long").distinct()), "edges")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "components")
