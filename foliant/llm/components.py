"""Connected components of an edge table, by partition-wise union-find and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node of each one's component: labels flow along edges, then jump."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        nodes, root = roots_of(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
        keep = nodes != root
        for k in range(0, int(keep.sum()), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(root[keep][k : k + 100_000]), pa.array(nodes[keep][k : k + 100_000])], ["root", "node"])


#: Edges that one task contracts alone; more are dealt out, and rounds made of it.
TASK_EDGES = 200_000


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that an edge (a, b) has: root is the smallest node of its component, and has a row too.

    Up to TASK_EDGES edges are contracted by one task. Of more, each round deals the edges by their larger end, joins what meets in a partition by union-find, and lets every
    node point at what its root points at. It ends when no root has a root and no node two: stars, whose centres are the answer.
    Nodes with many edges are roots, and edges are never dealt by their root, so a hot component spreads evenly.
    """
    pairs = edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).filter("root < node")
    if (pairs := written(pairs, name)).count() <= TASK_EDGES:
        pairs = written(pairs.coalesce(1).mapInArrow(_contract, "root long, node long"), name)
        return pairs.select("node", "root").unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
    while True:
        pairs = written(pairs.repartition("node").mapInArrow(_contract, "root long, node long"), name)
        up = pairs.groupBy(F.col("node").alias("up")).agg(F.min("root").alias("top"), F.count("*").alias("n"))
        jumped = pairs.join(up, pairs["root"] == up["up"], "left")
        state = jumped.agg(F.count("up").alias("jumps")).first().jumps, up.filter("n > 1").limit(1).count()
        if state == (0, 0):
            break
        pairs = jumped.select(F.coalesce("top", "root").alias("root"), "node").unionByName(pairs)
    return pairs.select("node", "root").unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())
