"""URL filters: gradient-boosted trees on lexical features, trained from labelled URLs, under fixed rules.

A rule is a host and a path prefix; it fits its host and all subdomains, the longest fitting
rule decides. Where no rule fits, boosted regression trees on lexical features decide:
lengths, depth, digit ratio, entropy, punctuation, parameter counts and statistics of the
host's suffixes. ``train`` fits them on a table of labelled URLs; ``train_on_rules`` takes those that a
rule decides as the labelled ones. Either takes a bounded sample.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: (rule, verdict): the host up to the first slash, the path from it on.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Labelled URLs that the trees are fitted on at most.
FIT_ROWS = 20_000
#: Trees, their depth, learning rate, histogram bins, least rows of a leaf.
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 10
#: Folds of the labelled rows whose suffix statistics leave them out.
FOLDS = 5
#: Features of a URL.
WIDTH = 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to the next ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; of equal lengths the first in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        h, p = name[: name.index("/")], name[name.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * np.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def features(url: str, host: str, path: str, stats: dict[str, tuple[float, float]]) -> list[float]:
    """Lexical features of a URL; ``stats`` has (rate of label 1, log of rows) of known suffixes."""
    query = url.partition("?")[2].partition("#")[0]
    last, two = suffixes(host)
    unknown = stats.get("", (0.5, 0.0))
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count("."), host.count("-"), digits, digits / max(1, len(url)),
        sum(c.isdigit() for c in host), _entropy(url), _entropy(host), query.count("=") + (query.count("&") if query else 0), float("#" in url),
        float(url[:5].lower() == "https"), float(path.endswith("/")), float("." in path.rpartition("/")[2]), max(map(len, path.split("/"))),
        *stats.get(last, unknown), *stats.get(two, unknown),
    ]


class Trees:
    """Boosted regression trees on the logistic loss over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, leaf: int = LEAF):
        self.n, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.base, self.edges, self.trees = 0.0, [], []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = np.clip(y.mean() if len(y) else 0.0, 0.001, 0.999)
        self.base = float(np.log(rate / (1 - rate)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, f = self._bin(x), np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: dict[int, tuple] = {}
            node = np.zeros(len(y), dtype=np.int64)
            for at in range((1 << self.depth) - 1):
                rows = np.flatnonzero(node == at)
                split = self._split(b[rows], g[rows], h[rows]) if len(rows) >= 2 * self.leaf else None
                if split:
                    tree[at] = split
                    node[rows] = 2 * at + 1 + (b[rows, split[0]] > split[1])
            values = np.zeros((1 << (self.depth + 1)) - 1)
            np.add.at(values, node, g)
            values *= self.rate / (np.bincount(node, h, len(values)) + 1)
            f += values[node]
            self.trees.append((tree, values))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-6, None
        for j in range(b.shape[1]):
            gs, hs, ns = (np.cumsum(np.bincount(b[:, j], w, self.bins))[:-1] for w in (g, h, np.ones(len(g))))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(ns < self.leaf) | (len(g) - ns < self.leaf)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (j, k)
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.edges and len(x):
            b = self._bin(x)
            for tree, values in self.trees:
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(self.depth):
                    for at, (j, k) in tree.items():
                        rows = node == at
                        node[rows] = 2 * at + 1 + (b[rows, j] > k)
                f += values[node]
        return 1 / (1 + np.exp(-f))


def suffix_stats(urls: list[tuple[str, str, str]], y: list[int], rate: float) -> dict[str, tuple[float, float]]:
    """(rate of label 1, log of rows) of suffixes with five rows at least; "" stands for all others."""
    seen, blocked = Counter(), Counter()
    for (_, host, _), label in zip(urls, y, strict=True):
        for s in set(suffixes(host)):
            seen[s] += 1
            blocked[s] += label
    return {s: ((blocked[s] + 5 * rate) / (n + 5), float(np.log(n))) for s, n in seen.items() if n >= 5} | {"": (rate, 0.0)}


class UrlModel:
    """Trees and suffix statistics; 1 stands for block.

    No row's own label is in the statistics that it is fitted with, else the trees would look at nothing but them:
    each row is fitted twice, with statistics of the other folds of rows and, as the URL of an unseen
    site, with those of the other folds of sites.
    """

    def __init__(self, urls: list[tuple[str, str, str]], y: list[int]):
        rate = sum(y) / len(y) if y else 0.0
        self.stats = suffix_stats(urls, y, rate)
        by_row = np.arange(len(urls)) % FOLDS
        by_site = np.array([zlib.crc32(suffixes(host)[1].encode()) % FOLDS for _, host, _ in urls], dtype=np.int64)
        rows, labels = [], []
        for fold in (by_row, by_site):
            for k in range(FOLDS):
                rest, own = np.flatnonzero(fold != k).tolist(), np.flatnonzero(fold == k).tolist()
                stats = suffix_stats([urls[i] for i in rest], [y[i] for i in rest], rate)
                rows += [features(*urls[i], stats) for i in own]
                labels += [y[i] for i in own]
        self.trees = Trees().fit(np.array(rows, dtype=np.float64).reshape(len(rows), WIDTH), np.array(labels, dtype=np.float64))

    def matrix(self, urls: list[tuple[str, str, str]]) -> np.ndarray:
        return np.array([features(*u, self.stats) for u in urls], dtype=np.float64).reshape(len(urls), WIDTH)

    def block_scores(self, urls: list[tuple[str, str, str]]) -> np.ndarray:
        return self.trees.predict(self.matrix(urls))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", fit_rows: int = FIT_ROWS) -> UrlModel:
    """Fit on at most ``fit_rows`` distinct URLs of a table with labels, 1 for block and 0 for allow.

    Null URLs and null labels are left out; a URL with both labels counts as blocked; without rows, or with one
    label alone, every URL gets that rate as its score.
    """
    url = F.col(url_col).cast("string")
    rows = labelled.select(url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where("url IS NOT NULL AND label IS NOT NULL").groupBy("url", "host", "path").agg(F.max("label").alias("label"))
    got = rows.orderBy(F.xxhash64("url"), "url").limit(fit_rows).collect()
    return UrlModel([(r.url, r.host, r.path) for r in got], [r.label for r in got])


def train_on_rules(pages: DataFrame, url_col: str = "url", rules=RULES, fit_rows: int = FIT_ROWS) -> UrlModel:
    """Fit on the URLs that a rule decides, for tables without labels; see :func:`train`."""
    url = F.col(url_col).cast("string")
    verdict = rule_of(host_of(url), path_of(url), rules)[1]
    return train(pages.select(url.alias("url"), F.when(verdict.isNotNull(), (verdict == "block").cast("int")).alias("label")), fit_rows=fit_rows)


def judge(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every row.

    Null URLs and URLs without ``://`` have an empty host and path, which fit no rule; the trees judge
    them like any other. Null ids stay null, repeated rows each get a row, other
    columns are ignored, an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(host, path, rules)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"), F.coalesce(url, F.lit("")).alias("url"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = list(zip(batch.column(5).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            score = shared.value.block_scores(urls)
            says = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(batch.column(4).to_pylist(), score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(says, type=pa.string()), pa.array(score, type=pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "block_score"])

    return map_batches(rows, kernel, "page_id long, host string, path string, rule string, verdict string, block_score double")
