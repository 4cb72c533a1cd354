"""Packing: order-preserving window cuts by dynamic programming with a monotone queue.

The documents of a partition form one stream of tokens in their given order. A cut may fall
at a document's end (free), at a sentence's end (a small truncation penalty) or, where
sentences are long, at every ``stride`` tokens in between (a larger one). With ``c`` the
tokens before a cut, the best cost of a stream that ends a window there is

    best[k] = penalty[k] + min over i with c[k] - c[i] <= window of best[i] + window - (c[k] - c[i])

and since ``best[i] + c[i]`` is all that depends on ``i``, a queue of rising values over the
sliding window gives each minimum in constant time. The stream is solved in blocks: all
windows but the last of a block are final, the last one's tokens start the next block, so
memory holds one block and not the partition.

No shuffle: each task packs what it reads; a task's last window alone may stay short.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, map_batches, texts_of
from .tokens import MEMO, OWNER, encoder

#: Tokens of a window.
WINDOW = 4096
#: What a cut costs, in padded tokens: between documents, between sentences, elsewhere.
PENALTY = (0, 16, 64)
#: Tokens between the cuts that are allowed inside a long sentence.
STRIDE = 128
#: Tokens of the stream that are solved at once.
BLOCK = 1 << 19

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(n: int, soft: np.ndarray, hard: np.ndarray, stride: int = STRIDE, penalty: tuple = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a stream of ``n`` tokens, 0 and n included, and their penalties.

    hard: ends of documents; soft: ends of sentences.
    """
    at = np.unique(np.concatenate([[0], soft, hard, [n]]).astype(np.int64))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > stride)
    more = [np.arange(at[i] + stride, at[i + 1], stride) for i in wide]
    free = np.concatenate([[0], hard, [n]])
    if more:
        at = np.union1d(at, np.concatenate(more))
    cost = np.full(len(at), float(penalty[2]))
    cost[np.isin(at, soft)] = penalty[1]
    cost[np.isin(at, free)] = penalty[0]
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts, first and last included, that minimise padding plus penalties."""
    c, p = at.tolist(), cost.tolist()
    before = [0] * len(c)
    queue: deque[tuple[float, int, int]] = deque([(float(c[0]), c[0], 0)])  # best + c, c, place
    for k in range(1, len(c)):
        here = c[k]
        while here - queue[0][1] > window:
            queue.popleft()
        value, _, i = queue[0]
        before[k] = i
        total = value + window + p[k]  # best[k] + c[k]
        while queue and queue[-1][0] >= total:
            queue.pop()
        queue.append((total, here, k))
    out, k = [], len(c) - 1
    while k:
        out.append(c[k])
        k = before[k]
    return [c[0], *out[::-1]]


class Stream:
    """Packs documents that arrive in order; yields pieces of finished windows."""

    def __init__(self, first: int, window: int, block: int, stride: int, penalty: tuple, with_ids: bool):
        self.next, self.window, self.block, self.stride, self.penalty, self.with_ids = first, window, block, stride, penalty, with_ids
        self.held: list[tuple] = []  # doc, start, ids, doc's tokens, ends of sentences
        self.n = 0

    def add(self, doc, ids: np.ndarray, soft: np.ndarray) -> Iterator[tuple]:
        for lo in range(0, len(ids), self.block):
            part = ids[lo : lo + self.block]
            self.held.append((doc, lo, part, len(ids), soft[(soft > lo) & (soft <= lo + len(part))] - lo))
            self.n += len(part)
            if self.n >= self.block:
                yield from self.solve(False)

    def solve(self, last: bool) -> Iterator[tuple]:
        if not self.n:
            return
        begins = np.cumsum([0, *(len(x[2]) for x in self.held)])
        soft = np.concatenate([x[4] + b for x, b in zip(self.held, begins, strict=False)])
        ends = np.array([b for b, x in zip(begins[1:], self.held, strict=True) if x[1] + len(x[2]) == x[3]], dtype=np.int64)
        cuts = best_cuts(*cut_points(self.n, soft, ends, self.stride, self.penalty), self.window)
        stop = self.n if last else cuts[-2]
        k, rest = 0, []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > stop:
                break
            while begins[k + 1] <= lo:
                k += 1
            j = k
            while j < len(self.held) and begins[j] < hi:
                doc, start, ids, total, _ = self.held[j]
                a, b = max(lo, begins[j]) - begins[j], min(hi, begins[j + 1]) - begins[j]
                piece = ids[a:b]
                yield (doc, start + int(a), int(b - a), zlib.crc32(piece.tobytes()), total, self.next, int(begins[j] + a - lo), *([piece.view(np.int32)] if self.with_ids else []))
                j += 1
            self.next += 1
        for x, b in zip(self.held, begins, strict=False):
            if b + len(x[2]) > stop:
                a = max(0, stop - b)
                rest.append((x[0], x[1] + int(a), x[2][a:], x[3], x[4][x[4] > a] - a))
        self.held, self.n = rest, int(self.n - stop)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW, stride: int = STRIDE, penalty: tuple = PENALTY, block: int = BLOCK, with_ids: bool = True, memo: int = MEMO) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` tokens.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32 (of the
    piece's ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end id),
    sequence_id, offset (place in the sequence), and ``ids`` if asked for. Every id of every
    document lies in exactly one piece; the pieces of a sequence are gapless from 0 and
    in the order of the stream.

    Null and empty texts are documents of the end id alone. Null ids stay null; repeated rows
    are separate documents that share an id. Other columns are ignored whatever their names. An empty
    table gives no rows. A text longer than a block is solved in parts. Sequence ids are
    unique, rising within a partition, not gapless over the table. ``memo``: units and words that a
    worker remembers at most; it changes time and memory, not results.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 7 + ([pa.list_(pa.int32())] if with_ids else [])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, memo).encode
        stream = Stream(TaskContext.get().partitionId() << 33, window, block, stride, penalty, with_ids)
        end = np.array([end_id], dtype="<u4")

        def send(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows: list[tuple] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for lo, hi in chunks([len(t) for t in texts], 4 << 20):
                for doc, (got, soft) in zip(ids[lo:hi], encode(texts[lo:hi]), strict=True):
                    for row in stream.add(doc, np.concatenate([got, end]), soft):
                        rows.append(row)
                        if len(rows) >= 4096:
                            yield send(rows)
                            rows = []
        rows += stream.solve(True)
        for lo in range(0, len(rows), 4096):
            yield send(rows[lo : lo + 4096])

    from pyspark.sql import functions as F

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, schema, OWNER)
