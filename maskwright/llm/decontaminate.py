"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item is a small set of shingles, a document a large one, so similarity of the two
sets says nothing and containment |item & document| / |item| is asked for. Items are
partitioned by set size (doubling classes). An item's sketch is its smallest hashes: with ``n``
shingles at most ``miss = n - ceil(0.75 n)`` may be absent, so of the ``miss + extra`` smallest
hashes at least ``extra`` are in any document that contains the item. A document therefore
looks its shingles up in each class's sketches (skipping classes too large for it), items
with enough hits are candidates, and each is verified on the exact shingle sets. No item is missed.

The benchmark is the query set: it is taken in blocks of bounded bytes, each block's index is
broadcast and held against all documents, which never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, map_batches
from .shingles import ALNUM, shingle_array, shingle_sets, word_arrays

#: Words of a shingle, and the least containment in hundredths.
WORDS, PERCENT = 5, 75
#: Sketch hashes beyond those that may be absent.
EXTRA = 4
#: UTF-8 bytes of benchmark text in a block.
BLOCK_BYTES = 4 << 20
#: Bits of the filter in front of a class's sketches.
FILTER = 20


class SizeClass:
    """Sketches of the items of one size class."""

    def __init__(self, items: list[int], sets: list[np.ndarray], percent: int, extra: int):
        sketches, self.need = [], {}
        for i in items:
            s = sets[i]
            miss = len(s) - (percent * len(s) + 99) // 100
            size = min(len(s), miss + extra)
            by_unsigned = np.sort(s.view(np.uint64))
            sketches.append(by_unsigned[:size].view(np.int64))
            self.need[i] = size - miss
        order = np.concatenate(sketches)
        owner = np.repeat(items, [len(x) for x in sketches])
        at = np.argsort(order, kind="stable")
        self.hashes, first = np.unique(order[at], return_index=True)
        self.owners = owner[at]
        self.begins = np.append(first, len(at))
        self.least = min((percent * len(sets[i]) + 99) // 100 for i in items)
        self.filter = np.zeros(1 << FILTER, dtype=bool)
        self.filter[self.hashes & ((1 << FILTER) - 1)] = True

    def candidates(self, s: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) with enough distinct sketch hits; s: distinct-or-not shingles, doc: their documents."""
        near = np.flatnonzero(self.filter[s & ((1 << FILTER) - 1)])
        if not len(near):
            return set()
        at = np.minimum(np.searchsorted(self.hashes, s[near]), len(self.hashes) - 1)
        hit = self.hashes[at] == s[near]
        pairs = np.unique(np.stack([doc[near[hit]], at[hit]]), axis=1)
        found: dict[tuple[int, int], int] = {}
        for d, k in zip(*pairs.tolist(), strict=True):
            for i in self.owners[self.begins[k] : self.begins[k + 1]].tolist():
                found[d, i] = found.get((d, i), 0) + 1
        return {x for x, n in found.items() if n >= self.need[x[1]]}


class Index:
    """A block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[bytes], k: int, percent: int, table: np.ndarray, extra: int = EXTRA):
        self.ids, self.k, self.percent, self.table = ids, k, percent, table
        self.sets = shingle_sets(texts, table, k)
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by_size.setdefault(len(s).bit_length(), []).append(i)
        self.classes = [SizeClass(by_size[c], self.sets, percent, extra) for c in sorted(by_size)]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of all contained items."""
        out = []
        for lo, hi in chunks([len(t) for t in texts]):
            words = word_arrays(texts[lo:hi], self.table)
            sets = [shingle_array(w, self.k) for w in words]
            sizes = np.array([len(s) for s in sets])
            if not sizes.sum():
                continue
            s, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            found = set()
            for c in self.classes:
                large = sizes >= c.least
                if large.all():
                    found |= c.candidates(s, doc)
                elif large.any():
                    keep = large[doc]
                    found |= c.candidates(s[keep], doc[keep])
            distinct: dict[int, np.ndarray] = {}
            for d, i in sorted(found):
                own = distinct.setdefault(d, np.unique(sets[d]) if d not in distinct else distinct[d])
                shared = len(np.intersect1d(own, self.sets[i], assume_unique=True))
                if 100 * shared >= self.percent * len(self.sets[i]):
                    out.append((lo + d, i, shared))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, **how) -> Iterator:
    """Broadcast indexes of the benchmark, one of bounded size after the other."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == b) if n > 1 else rows
        got = part.toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(got.column(0).to_pylist(), [t.encode() for t in got.column(1).to_pylist()], **how))


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = WORDS, percent: int = PERCENT, table: np.ndarray = ALNUM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` for each document row and item it contains.

    Words are runs of letters and digits, A-Z lower-cased; an item of fewer than ``k`` words is one
    shingle, its whole sequence, and is found only in a text that is that sequence. Null,
    empty and word-less texts contain nothing and are contained in nothing. Null ids stay null; repeated rows
    and items each give their rows; other columns are ignored; an empty table on
    either side gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel_of(shared):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = index.search(bytes_of(batch.column(1)))
                rows = pa.array([d for d, _, _ in found], type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        pa.array([index.ids[i] for _, i, _ in found], type=pa.int64()),
                        pa.array([len(index.sets[i]) for _, i, _ in found], type=pa.int64()),
                        pa.array([n for _, _, n in found], type=pa.int64()),
                    ],
                    names=["doc_id", "item_id", "n_item", "n_shared"],
                )

        return kernel

    parts = [map_batches(slim, kernel_of(b), "doc_id long, item_id long, n_item long, n_shared long") for b in _blocks(benchmark, item_col, item_text_col, block_bytes, k=k, percent=percent, table=table)]
    return reduce(DataFrame.union, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = WORDS, percent: int = PERCENT, table: np.ndarray = ALNUM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they were; see :func:`contained_items`."""
    place = docs.columns.index(text_col)

    def kernel_of(shared):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[d for d, _, _ in index.search(bytes_of(batch.column(place)))]] = False
                yield batch.filter(pa.array(keep))

        return kernel

    for b in _blocks(benchmark, item_col, item_text_col, block_bytes, k=k, percent=percent, table=table):
        docs = map_batches(docs, kernel_of(b), docs.schema)
    return docs
