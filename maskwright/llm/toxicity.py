"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are its embedding (words of the training sample) and the mean embedding of
its hashed character trigrams, so that a word never seen still has a meaning. Two gated
recurrent layers read a window of words in both directions; attention weighs the positions,
the weighted mean of states and inputs gives the window's logit. A text is scored by
*all* its overlapping windows: the greatest logit, calibrated on held-back training documents.

Labels are per document, so training picks windows: of a toxic text those that the current
model (at first: log-odds of words) finds most toxic, of a clean text its most suspicious
and a random one; then the network is trained end to end by Adam.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, map_batches, release, remember, texts_of

#: Words of a window and from one window to the next.
WINDOW, STEP = 40, 30
#: Widths: embedding of words and of characters, recurrent state, attention.
D, H, A = 8, 8, 8
#: Words that get an embedding of their own, hashed character trigrams.
VOCABULARY, TRIGRAMS = 20_000, 4096
#: Labelled documents that the model is fitted on at most (toxic ones; three times as many clean ones), and UTF-8 bytes of their texts.
FIT_ROWS, FIT_BYTES = 1500, 16 << 20
#: UTF-8 bytes that are scored at once, and words a worker remembers.
SCORED_BYTES = 1 << 20
MEMO = 300_000
#: From this score on a text is predicted toxic.
THRESHOLD = 0.7

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def clean_word(unit: str) -> str:
    return _EDGE.sub("", unit).lower()


def trigram_rows(word: str) -> list[int]:
    padded = f"<{word}>"
    return [zlib.crc32(padded[i : i + 3].encode()) % TRIGRAMS for i in range(max(1, len(padded) - 2))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def windows_of(n: int, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    """First words of all overlapping windows of a text of n words; one window at least."""
    return np.arange(0, max(1, n - window + step), step)[: max(1, -(-(n - window) // step) + 1 if n > window else 1)]


class Network:
    """The model; parameters in ``p``."""

    def __init__(self, words: list[str], odds: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        x = 2 * D
        self.row = {w: i + 2 for i, w in enumerate(words)}  # 0: padding, 1: unknown
        self.p = {"E": small(len(words) + 2, D), "C": small(TRIGRAMS, D) * 3, "Wa": small(2 * H + x, A), "ba": np.zeros(A, np.float32), "va": small(A), "w": small(2 * H + x), "b": np.array([-2.0], np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": small(x, 3 * H) * 2, f"U{d}": small(H, 3 * H) * 2, f"c{d}": np.zeros(3 * H, np.float32)}
        self.p["E"][2:, 0] = odds / 2
        self.p["E"][:2, 0] = 0
        self.p["w"][2 * H] = 2.0
        self.p["Wa"][2 * H, 0], self.p["va"][0] = 2.0, 2.0
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        return np.array([self.row.get(w, 1) if w else 1 for w in words], dtype=np.int64), [trigram_rows(w) for w in words]

    def vectors(self, words: list[str]) -> np.ndarray:
        """Input vectors of words."""
        rows, grams = self.inputs(words)
        c = np.array([self.p["C"][g].mean(0) for g in grams], dtype=np.float32).reshape(-1, D)
        return np.concatenate([self.p["E"][rows], c], axis=1)

    def _read(self, xw: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: bool):
        t_, b, _ = xw.shape
        h, out, tape = np.zeros((b, H), np.float32), np.empty((t_, b, H), np.float32), []
        for t in range(t_ - 1, -1, -1) if back else range(t_):
            hu = h @ u
            zr = 1 / (1 + np.exp(-(xw[t, :, : 2 * H] + hu[:, : 2 * H])))
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(xw[t, :, 2 * H :] + r * hu[:, 2 * H :])
            new = h + (mask[t] * (1 - z)) * (n - h)
            if keep:
                tape.append((t, h, z, r, n, hu[:, 2 * H :]))
            out[t] = h = new
        return out, tape

    def pooled(self, x: np.ndarray, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits; x: inputs [time, window, 2D], xf and xb: their projections, mask [time, window, 1]."""
        p = self.p
        f, tape_f = self._read(xf, p["Uf"], mask, False, keep)
        g, tape_b = self._read(xb, p["Ub"], mask, True, keep)
        s = np.concatenate([f, g, x], axis=2)
        a = np.tanh(s @ p["Wa"] + p["ba"])
        e = np.where(mask[:, :, 0] > 0, a @ p["va"], -1e4)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pool = (w[:, :, None] * s).sum(0)
        return pool @ p["w"] + p["b"][0], (s, a, w, pool, tape_f, tape_b)

    def step_gradients(self, rows: np.ndarray, grams: np.ndarray, gram_mask: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the mean weighted cross-entropy; rows [time, window], grams [time, window, g]."""
        p = self.p
        c = (p["C"][grams] * gram_mask[..., None]).sum(2) / gram_mask.sum(2, keepdims=True)
        x = np.concatenate([p["E"][rows], c], axis=2).astype(np.float32)
        logit, (s, a, w, pool, tape_f, tape_b) = self.pooled(x, x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask, True)
        d = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        out = {"w": pool.T @ d, "b": np.array([d.sum()])}
        dpool = d[:, None] * p["w"]
        dw = (s * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        out["va"] = (a * de[:, :, None]).sum((0, 1))
        da = de[:, :, None] * p["va"] * (1 - a * a)
        out["Wa"], out["ba"] = np.tensordot(s, da, ([0, 1], [0, 1])), da.sum((0, 1))
        ds = w[:, :, None] * dpool + da @ p["Wa"].T
        dx = ds[:, :, 2 * H :].copy()
        for name, tape, part in (("f", tape_f, ds[:, :, :H]), ("b", tape_b, ds[:, :, H : 2 * H])):
            u, dh = p[f"U{name}"], np.zeros_like(part[0])
            du, dxw = np.zeros_like(u), np.zeros((*part.shape[:2], 3 * H), np.float32)
            for t, h, z, r, n, hn in reversed(tape):
                dh = dh + part[t]
                m = mask[t]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dxw[t] = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ dhu
                dh = dh * (1 - m * (1 - z)) + dhu @ u.T
            out[f"U{name}"], out[f"c{name}"] = du, dxw.sum((0, 1))
            out[f"W{name}"] = np.tensordot(x, dxw, ([0, 1], [0, 1]))
            dx += dxw @ p[f"W{name}"].T
        out["E"] = np.zeros_like(p["E"])
        np.add.at(out["E"], rows.ravel(), dx[:, :, :D].reshape(-1, D))
        out["C"] = np.zeros_like(p["C"])
        share = (dx[:, :, D:] / gram_mask.sum(2, keepdims=True))[:, :, None, :] * gram_mask[..., None]
        np.add.at(out["C"], grams.ravel(), share.reshape(-1, D))
        return out

    def calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton's method, slightly regularised, rising slope."""
        a, b = 1.0, 0.0
        for _ in range(50):
            q = sigmoid(a * logits + b)
            v = np.maximum(q * (1 - q), 1e-6)
            g = np.array([((q - y) * logits).sum() + 0.01 * (a - 1), (q - y).sum() + 0.01 * b])
            hess = np.array([[(v * logits * logits).sum() + 0.01, (v * logits).sum()], [(v * logits).sum(), v.sum() + 0.01]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -2, 2)
        self.scale, self.shift = max(float(a), 1e-3), float(b)


class Scorer:
    """Scores texts; remembers the input vectors of the words it has seen."""

    def __init__(self, net: Network, memo: int = MEMO):
        self.net, self.limit = net, memo
        self._reset()

    def _reset(self) -> None:
        self.units: dict[str, int] = {}
        self.words: dict[str, int] = {"": 0}
        self.x = np.zeros((4096, 2 * D), np.float32)  # row 0: padding; grows by half

    def _learn(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > self.limit:
            self._reset()
            new = list(units)
        words = {u: clean_word(u) for u in new}
        unseen = sorted({w for w in words.values() if w not in self.words})
        if unseen:
            n = len(self.words)
            self.words.update({w: n + i for i, w in enumerate(unseen)})
            if n + len(unseen) > len(self.x):
                self.x = np.concatenate([self.x[:n], np.zeros((max(len(unseen), n // 2), 2 * D), np.float32)])
            for lo in range(0, len(unseen), 1 << 14):
                some = unseen[lo : lo + (1 << 14)]
                self.x[n + lo : n + lo + len(some)] = self.net.vectors(some)
        self.units.update({u: self.words[w] for u, w in words.items()})

    def logits(self, texts: list[str]) -> np.ndarray:
        """The greatest window logit of each text."""
        p = self.net.p
        split = [t.split() for t in texts]
        self._learn(set().union(*split) if split else set())
        get = self.units.__getitem__
        ids = [np.fromiter((i for i in map(get, u) if i), dtype=np.int64) if u else np.zeros(0, np.int64) for u in split]
        begins = np.cumsum([0, *(len(i) for i in ids)])
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        starts = [windows_of(len(i)) for i in ids]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        first = np.concatenate(starts) + begins[owner] if len(owner) else np.zeros(0, np.int64)
        left = begins[owner + 1] - first
        out = np.full(len(texts), -np.inf)
        span = np.arange(WINDOW)[:, None]
        x = self.x[flat]
        xf, xb = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        for lo in range(0, len(first), 2048):
            hi = lo + 2048
            at = np.minimum(span + first[lo:hi], len(flat) - 1)
            mask = span < left[lo:hi]
            logit, _ = self.net.pooled(x[at], xf[at], xb[at], mask[:, :, None].astype(np.float32))
            np.maximum.at(out, owner[lo:hi], logit)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.net.scale * self.logits(texts) + self.net.shift)


def _log_odds(docs: list[list[str]], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The most widespread words of a sample and their log-odds for label 1, clipped."""
    seen, toxic = Counter(), Counter()
    for words, label in zip(docs, y, strict=True):
        distinct = set(words) - {""}
        seen.update(distinct)
        if label:
            toxic.update(distinct)
    words = sorted((w for w, n in seen.items() if n >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    t, c = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    return words, np.array([np.clip(np.log((toxic[w] + 0.5) / (t + 1)) - np.log((seen[w] - toxic[w] + 0.5) / (c + 1)) if seen[w] >= 5 else 0, -4, 4) for w in words], dtype=np.float32)


def train(texts: list[str], labels: list[int], seed: int = 3, epochs: int = 3, batch: int = 128) -> Network:
    """A network fitted on labelled texts; one fifth of them calibrates it. With one label only, that label's rate is the score."""
    rng = np.random.default_rng(seed)
    y_all = np.array(labels, dtype=np.float64)
    # One string object for each distinct word: lists of millions of words are mostly repeats.
    cleaned: dict[str, str] = {}
    same: dict[str, str] = {}

    def words_of(text: str) -> list[str]:
        units = text.split()
        for u in units:
            if u not in cleaned:
                w = clean_word(u)
                cleaned[u] = same.setdefault(w, w)
        return [w for w in map(cleaned.__getitem__, units) if w]

    docs = [words_of(t) for t in texts]
    cleaned.clear()
    same.clear()
    held = np.arange(len(docs)) % 5 == 4
    fit = np.flatnonzero(~held)
    words, odds = _log_odds([docs[i] for i in fit], y_all[fit])
    net = Network(words, odds, seed)
    if not len(texts) or y_all.min() == y_all.max():
        rate = float(y_all.mean()) if len(texts) else 0.0
        net.scale, net.shift = 0.0, float(np.log((rate + 0.01) / (1.01 - rate)))
        return net
    weight_of = dict(zip(words, odds.tolist(), strict=True))
    distinct = sorted({w for i in fit for w in docs[i]})
    number = {w: k for k, w in enumerate(distinct)}
    wide = min(12, max((max(1, len(w)) for w in distinct), default=1))  # a word has as many trigrams as characters
    rows = np.zeros(len(distinct) + 1, np.int64)
    gram = np.zeros((len(distinct) + 1, wide), np.int32)
    gmask = np.zeros((len(distinct) + 1, wide), np.float32)
    gmask[-1, 0] = 1
    for lo in range(0, len(distinct), 1 << 14):
        some = distinct[lo : lo + (1 << 14)]
        rows[lo : lo + len(some)], grams = net.inputs(some)
        for k, g in enumerate(grams, lo):
            gram[k, : len(g[:wide])], gmask[k, : len(g[:wide])] = g[:wide], 1
    ids = {i: np.array([number[w] for w in docs[i]], dtype=np.int32) for i in fit}
    value = np.array([weight_of.get(w, 0.0) for w in distinct])
    unknown = len(distinct)
    del docs, distinct, number, weight_of
    give_back()
    m1, m2, moment = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        chosen: list[tuple[int, int]] = []
        for i in fit:
            starts = windows_of(len(ids[i]))
            run = np.concatenate([[0], np.cumsum(np.maximum(value[ids[i]], 0) ** 2)]) if len(ids[i]) else np.zeros(1)
            heat = run[np.minimum(starts + WINDOW, len(run) - 1)] - run[np.minimum(starts, len(run) - 1)]
            order = np.argsort(-heat, kind="stable")
            picks = {int(order[0])} if y_all[i] else {int(order[0]), int(rng.integers(len(starts)))}
            if y_all[i] and len(order) > 1 and heat[order[1]] > 0.5 * heat[order[0]]:
                picks.add(int(order[1]))
            chosen += [(i, int(starts[k])) for k in sorted(picks)]
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), batch):
            part = chosen[lo : lo + batch]
            at = np.full((WINDOW, len(part)), unknown, np.int64)
            for k, (i, s) in enumerate(part):
                own = ids[i][s : s + WINDOW]
                at[: len(own), k] = own
            mask = (at < unknown).astype(np.float32)[:, :, None]
            y = np.array([y_all[i] for i, _ in part])
            got = net.step_gradients(rows[at], gram[at], gmask[at], mask, y, np.ones(len(part)))
            moment += 1
            rate = 0.01 * (1 if epoch < epochs - 1 else 0.3)
            for k, g in got.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.98 * m2[k] + 0.02 * g * g
                net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**moment)) / (np.sqrt(m2[k] / (1 - 0.98**moment)) + 1e-6)).astype(np.float32)
            net.p["E"][0] = 0
    own = np.flatnonzero(held)
    scorer = Scorer(net)
    logits = np.concatenate([np.zeros(0), *(scorer.logits([texts[i] for i in own[lo:hi]]) for lo, hi in chunks([len(texts[i]) for i in own], 1 << 18))])
    if len(own):
        net.calibrate(logits, y_all[own])
    return net


def held_out(id_col: str = "doc_id"):
    """True for documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Network:
    """Train on at most ``fit_rows`` toxic and three times as many clean labelled documents, of at most ``fit_bytes`` of text, none of them held out.

    The documents come in the order of their ids' hash until either bound is met, with whole texts; a text that alone
    would pass the bytes left is not taken. Of rows that repeat an id the greatest text counts, of its labels the greater.
    The sample's calibration follows the labels' rates in the whole table, not in the sample.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    rates = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    n = {y: min(fit_rows * (1 if y else 3), c) for y, c in rates.items()}
    picked = [r for y in sorted(n) for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n[y]).collect()]
    if not picked:
        return train([], [])
    few = docs.sparkSession.createDataFrame([(r.id, r.y) for r in picked], "id long, y int")  # at most 4 * fit_rows rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = texts.join(F.broadcast(few), "id").groupBy("id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.max("y").alias("y")).collect()
    chosen, used = [], 0
    for r in sorted(size, key=lambda r: (zlib.crc32(str(r.id).encode()), r.id)):
        if used + r.bytes <= fit_bytes:
            used += r.bytes
            chosen.append((r.id, r.y))
    few = docs.sparkSession.createDataFrame(chosen, "id long, y int")
    rows = texts.join(F.broadcast(few), "id").groupBy("id").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"), F.max("y").alias("y")).toArrow()  # at most fit_bytes
    got = sorted(((zlib.crc32(str(i).encode()), i, t, y) for i, t, y in zip(*(rows.column(c).to_pylist() for c in ("id", "text", "y")), strict=True)), key=lambda r: r[:2])
    of = {y: max(1, sum(r[3] == y for r in got)) for y in n}
    sample = [r[2] for r in got], [r[3] for r in got]
    del rows, got
    net = train(*sample)
    if len(n) == 2 and net.scale:
        share = lambda c: np.log(c[1] / c[0])
        net.shift += float(share(rates) - share(of))
    del sample
    # What the fit needed goes back to the system: the driver holds the plans of whatever comes next.
    release(docs.sparkSession)
    give_back()
    return net


#: Owner of what workers remember.
OWNER = "toxicity"


def _scorer(shared) -> Scorer:
    return remember(OWNER, id(shared.value), lambda: Scorer(shared.value))


def toxicity_scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row, from the whole text alone.

    Null, empty and word-less texts have one empty window and its score. Null ids stay null, repeated rows each
    get a row, other columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in chunks([len(t) for t in texts], SCORED_BYTES):
                s = scorer.scores(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(s, type=pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, "doc_id long, score double, predicted int", OWNER)


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    shared, place = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            texts = texts_of(batch.column(place))
            s = np.concatenate([np.zeros(0), *(scorer.scores(texts[lo:hi]) for lo, hi in chunks([len(t) for t in texts], SCORED_BYTES))])
            yield batch.filter(pa.array(s < threshold))

    return map_batches(docs, kernel, docs.schema, OWNER)
