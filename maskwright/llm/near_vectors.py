"""Embedding near-dedup: a random-projection tree forest with spill, exact verification, union.

1. Equal vectors collapse to one node with a weight.
2. *Balls*: groups so dense that every pair in them links by the triangle inequality (all
   within half the link angle of a centre) are found on a bounded sample and counted, not
   compared. Without them a group of copies that holds a third of all rows would need
   all its pairs. Members of one ball link with each other; each ball is one star of edges.
3. Every tree splits its node's vectors by random projections at the median, level by level; vectors
   close to a split go to both sides (spill). Splits come from a bounded sample, every vector
   runs down every tree. The depth follows the number of vectors, not the sample: below the nodes that the sample
   can still be split in, each further level splits at the median that the node's own part of the
   sample has on that level's projection.
4. In each leaf all pairs that do not share a ball are compared in double precision, block by block; a pair
   that meets in several leaves counts in the first of them only. A leaf sends one row per
   linked vector (its count and its local root), never its pairs.
5. Counts add up to ``n_links``, roots are joined to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import components, local_roots

#: Trees, share of a node's vectors on either side of the split that go both ways, vectors of a leaf.
TREES, SPILL, LEAF = 10, 0.05, 1024
#: Vectors that splits and balls are fitted on, and those of a node that is still split in two by them.
SAMPLE, FITTED = 20_000, 64
#: Cells of an array that a leaf's comparison makes at once.
CELLS = 1 << 22
#: A ball is kept if it holds this share of the sample, and at least so many of its vectors.
BALL_SHARE, BALL_LEAST = 0.004, 40


class Forest:
    """Random projections and split points fitted on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int, fitted: int = FITTED):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        # Levels whose nodes hold enough of the sample; those below split each such node by its own medians.
        self.top = top = max(0, min(depth, int(math.log2(max(1, len(sample) / fitted)))))
        self.normals = rng.standard_normal((sample.shape[1] if sample.size else 1, trees * depth))
        # Per tree: lower end, median and upper end of the split of each node of the upper levels, then of each level below for each node above it.
        self.cuts = np.zeros((3, trees, max(1, (1 << top) - 1 + ((depth - top) << top))))
        projected = sample @ self.normals if sample.size else np.zeros((0, trees * depth))
        ends = [0.5 - spill, 0.5, 0.5 + spill]
        for t in range(trees):
            groups = {0: np.arange(len(sample))}
            for level in range(depth):
                down: dict[int, np.ndarray] = {}
                for node in range(1 << min(level, top)):
                    rows = groups.get(node, np.zeros(0, dtype=np.int64))
                    p = projected[rows, t * depth + level]
                    q = np.quantile(p, ends) if len(p) else np.zeros(3)
                    self.cuts[:, t, self._at(level, node << max(0, level - top))] = q
                    if level < top:
                        down[2 * node], down[2 * node + 1] = rows[p < q[1]], rows[p >= q[1]]
                groups = down if level < top else groups

    def _at(self, level: int, node):
        """Place of a node's split."""
        top = self.top
        return (1 << level) - 1 + node if level < top else (1 << top) - 1 + ((level - top) << top) + (node >> (level - top))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf numbers (over all trees) of unit vectors; a row may be in several leaves of a tree."""
        projected = x @ self.normals
        all_rows, all_leaves = [], []
        for t in range(self.trees):
            rows, nodes = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                p = projected[rows, t * self.depth + level]
                lo, mid, hi = self.cuts[:, t, self._at(level, nodes)]
                left, right = p < hi, p >= lo
                neither = ~(left | right)
                left |= neither & (p < mid)
                right |= neither & ~left
                rows = np.concatenate([rows[left], rows[right]])
                nodes = np.concatenate([2 * nodes[left], 2 * nodes[right] + 1])
            all_rows.append(rows)
            all_leaves.append(nodes + (t << self.depth))
        return np.concatenate(all_rows), np.concatenate(all_leaves)


def find_balls(sample: np.ndarray, cosine: float, share: float, least: int, most: int = 256) -> np.ndarray:
    """Centres of dense groups of the sample; any two vectors within the inner angle of one centre link."""
    inner = inner_cosine(cosine)
    left, centres = sample, []
    need = max(least, int(share * len(sample)))
    rng = np.random.default_rng(7)
    tries = 0
    while len(left) >= need and len(centres) < most and tries < 4 * most:
        tries += 1
        leader = left[rng.integers(len(left))]
        near = left[left @ leader >= cosine]
        if len(near) >= need // 2 and len(near) > 1:
            for _ in range(2):
                centre = near.mean(0)
                centre /= np.linalg.norm(centre)
                near = left[left @ centre >= inner]
                if not len(near):
                    break
            if len(near) >= need:
                centres.append(centre)
                left = left[left @ centre < inner]
                tries = 0
    return np.array(centres).reshape(-1, sample.shape[1] if sample.ndim == 2 else 0)


def inner_cosine(cosine: float) -> float:
    """Cosine of half the link angle, with room for rounding."""
    return math.sqrt((1 + cosine) / 2) + 1e-9


def compare_leaf(x: np.ndarray, weight: np.ndarray, ball: np.ndarray, paths: list[np.ndarray], leaf: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each vector that count in this leaf, and the place of its root among them (-1: none).

    x: unit vectors in double precision; paths: the leaves each vector is in; ball: its ball or -1.
    """
    n = len(x)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    earlier = [p[p < leaf] for p in paths]
    wide = max((len(e) for e in earlier), default=0)
    # Leaves before this one, filled up with numbers that no other vector has.
    before = -1 - np.arange(n, dtype=np.int64)[:, None] * np.ones((1, max(1, wide)), dtype=np.int64)
    for k, e in enumerate(earlier):
        before[k, : len(e)] = e
    step = max(1, CELLS // max(1, n))
    for lo in range(0, n, step):
        i, j = np.nonzero(x[lo : lo + step] @ x.T >= cosine)
        i += lo
        keep = (i < j) & ((ball[i] < 0) | (ball[i] != ball[j]))
        i, j = i[keep], j[keep]
        if wide:
            fresh = np.ones(len(i), dtype=bool)
            some = max(1, CELLS // (wide * wide))
            for k in range(0, len(i), some):
                fresh[k : k + some] = ~(before[i[k : k + some], :, None] == before[j[k : k + some], None, :]).any((1, 2))
            i, j = i[fresh], j[fresh]
        if len(i):
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            known = np.flatnonzero(root != np.arange(n))
            nodes, roots = local_roots(np.concatenate([i, known]), np.concatenate([j, root[known]]))
            root[nodes] = roots
    root[links == 0] = -1
    return links, root


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The batch's vectors, which have one length, at length 1; scaled first, so that no magnitude over- or underflows."""
    x = np.asarray(batch.column(column).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    A link is a pair of rows with cosine >= ``cosine`` in double precision; no pair below it is linked.
    Vectors that are null, empty, zero, or hold nulls, NaNs or infinities link with nothing and
    keep their id as component. Vectors link with those of their own length only; each length has its own forest.
    Rows with a null id have 0 links, a null component and are kept. Rows that share an id are
    separate vectors, each with its own links, that count as one node in components. Labels and other columns are ignored;
    an empty table gives no rows. Pairs farther apart than the link angle are never compared
    outside a leaf; recall over the forest is measured in the tests.
    """
    small_batches(vectors.sparkSession)
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("e"))
    finite = F.col("id").isNotNull() & F.coalesce(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0), F.lit(False))
    # Equal vectors have equal keys of 128 bits, which stand for them wherever the vectors themselves are not needed.
    rows = rows.select("id", F.when(finite, F.col("e")).alias("e")).select("id", "e", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(seed), "e").alias("h2"))
    good = rows.where("e IS NOT NULL")
    seen = good.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.collect_set(F.size("e")).alias("lengths")).first()  # as many as there are lengths
    unique = seen.rows == seen.ids
    # A vector is named by its smallest id; where ids repeat any number will do once it is written.
    name = F.col("id") if unique else F.monotonically_increasing_id()
    nodes = cut(good.groupBy("h1", "h2", "e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("node", name))
    edges, links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), nodes.select("node", F.lit(0).cast("long").alias("links")).limit(0)
    for d in sorted(seen.lengths):
        own = nodes.where(F.size("e") == d) if len(seen.lengths) > 1 else nodes
        more_edges, more_links = _one_length(own, d, cosine, trees, spill, leaf, sample, seed)
        edges, links = edges.union(more_edges), links.union(more_links)
    if not unique:
        numbers = good.select("id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
        first = numbers.groupBy("id").agg(F.min("node").alias("b"))
        edges = edges.union(numbers.join(first, "id").where("node <> b").select(F.col("node").alias("a"), "b"))
    parts = components(edges)
    links = links.groupBy("node").agg(F.sum("links").alias("links"))
    answer = nodes.join(links, "node", "left").join(parts, "node", "left").select("id", "h1", "h2", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    if not unique:
        answer = answer.join(answer.groupBy("component").agg(F.min("id").alias("least")), "component").withColumn("component", F.col("least"))
    answer = answer.select("h1", "h2", "weight", "n_links", "component")
    # Vectors that many rows repeat, fewer than 1024 of them, are told to every task; the others meet their rows by a shuffle.
    large = max(1024, seen.rows // 1024)
    hot = F.broadcast(answer.where(F.col("weight") > large).drop("weight"))
    slim = good.select("id", "h1", "h2")
    joined = slim.join(hot, ["h1", "h2"]).unionByName(slim.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(answer.where(F.col("weight") <= large).drop("weight"), ["h1", "h2"]))
    every = joined.select("id", "n_links", "component").union(rows.where("e IS NULL").select("id", F.lit(0).cast("long"), "id"))
    return every.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def _one_length(nodes: DataFrame, d: int, cosine: float, trees: int, spill: float, leaf: int, sample: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) and links (node, links) between distinct vectors of one length."""
    n = nodes.count()
    picked = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(sample).select("e").toArrow()
    x = _unit(picked.combine_chunks().to_batches()[0], 0) if picked.num_rows else np.zeros((0, d))
    depth = max(0, math.ceil(math.log2(max(1, n / leaf) * 1.5))) if n > leaf else 0
    balls = find_balls(x, cosine, BALL_SHARE, BALL_LEAST)
    shared = nodes.sparkSession.sparkContext.broadcast((Forest(x, depth, trees, spill, seed), balls))
    inner = inner_cosine(cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, centres = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(batch, 2)
            ball = np.full(len(v), -1)
            if len(centres):
                c = v @ centres.T
                first = np.argmax(c >= inner, axis=1)
                ball = np.where(c[np.arange(len(v)), first] >= inner, first, -1)
            r, leaves = forest.leaves(v)
            order = np.argsort(r, kind="stable")
            ends = np.cumsum(np.bincount(r, minlength=len(v)))
            paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), type=pa.int32()), pa.array(leaves[order], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ball, type=pa.int64()), paths], names=["node", "weight", "e", "ball", "paths"])

    placed = cut(nodes.select("node", "weight", "e").mapInArrow(place, "node long, weight long, e array<double>, ball long, paths array<long>"))
    by_ball = placed.where("ball >= 0").groupBy("ball").agg(F.min("node").alias("root"), F.sum("weight").alias("total"))
    # Members far inside a ball are compared with strangers only; a ball without strangers near it needs no trees.
    outer = math.cos(min(math.pi, math.acos(inner) + math.acos(cosine))) - 1e-9

    def near_ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, centres = shared.value
        seen: set[int] = set()
        for batch in batches:
            if len(centres) and batch.num_rows:
                c = _unit(batch, 0) @ centres.T >= outer
                c[np.arange(len(c)), np.maximum(batch.column(1).to_numpy(), 0)] &= batch.column(1).to_numpy() < 0
                seen.update(np.flatnonzero(c.any(0)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), type=pa.int64())], names=["ball"])

    with_strangers = sorted(r.ball for r in placed.select("e", "ball").mapInArrow(near_ball, "ball long").distinct().collect())  # at most as many as centres
    compared = placed.where((F.col("ball") < 0) | F.col("ball").isin(with_strangers))

    def leaf_rows(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        batch = group.combine_chunks().to_batches()[0] if group.num_rows else None
        if batch is None:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        names = batch.schema.names
        node, weight, ball = (batch.column(names.index(c)).to_numpy() for c in ("node", "weight", "ball"))
        paths = batch.column(names.index("paths"))
        links, root = compare_leaf(_unit(batch, names.index("e")), weight, ball, [paths[i].values.to_numpy() for i in range(len(node))], key[0].as_py(), cosine)
        keep = root >= 0
        return pa.table({"node": node[keep], "links": links[keep], "root": node[root[keep]]})

    in_leaves = compared.select("node", "weight", "e", "ball", "paths", F.explode("paths").alias("leaf"))
    found = cut(in_leaves.groupBy("leaf").applyInArrow(leaf_rows, "node long, links long, root long"))
    star = placed.join(F.broadcast(by_ball), "ball")  # at most as many as centres
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(star.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return edges, found.select("node", "links").union(star.select("node", (F.col("total") - F.col("weight")).alias("links")))
