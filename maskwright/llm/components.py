"""Connected components over an edge list that may be of any size.

Edges are first contracted in blocks of bounded size (a union-find over one block's edges,
which shrinks them to a star per local component; edges that fit one block are settled by
that), then the alternating
large-star / small-star rounds run on what is left until nothing changes. Every round is two
joins that adaptive execution can split at a hub, with minima that combine before the
shuffle, and ends in a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that the contraction holds at once.
BLOCK = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a small graph and the smallest node of each one's component."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def star() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        nodes, roots = local_roots(a, b)
        keep = nodes != roots
        return nodes[keep], roots[keep]

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= 2 * BLOCK:
            held = [star()]
            n = len(held[0][0])
            if n >= BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in star()], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation; edges point from the greater to the smaller node."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is its smallest reachable node.

    Null ends are ignored, self-loops and repeated edges are allowed (a node that has only
    self-loops does not appear). Empty input gives an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b")
    edges = cut(edges)
    # Partitions of a block each: few edges are settled by one task's union-find, which is exact on its own.
    parts = -(-edges.count() // BLOCK)
    edges = cut(edges.coalesce(max(1, parts)).mapInArrow(_contract, "a long, b long"))
    for _ in range(rounds if parts > 1 else 0):
        new = cut(_star(_star(edges, True), False))
        state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("b", "a"))).first()
        done, edges = state(new) == state(edges), new
        if done:
            break
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
