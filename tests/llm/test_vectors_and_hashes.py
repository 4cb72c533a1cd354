"""Near vectors against brute force on odd tables; shingle hashes on words that polynomial hashes confuse."""

from collections import Counter

import numpy as np
import pytest

from maskwright.llm import components, decontaminate, jaccard_join, near_vectors, shingles


def brute(rows, cosine=0.95):
    """(id, links, component) of every row by plain loops."""

    def usable(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)

    unit = [None] * len(rows)
    for k, (i, v) in enumerate(rows):
        if i is not None and usable(v):
            x = np.array(v, dtype=np.float64)
            x = x / np.abs(x).max()
            unit[k] = x / np.linalg.norm(x)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            linked = unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine
            links[a] += linked
            links[b] += linked
            if linked or (unit[a] is not None and unit[b] is not None and rows[a][0] == rows[b][0]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, links[k], None if i is None else least[find(k)], i is None or least[find(k)] == i) for k, (i, _) in enumerate(rows))


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    return Counter(tuple(r) for r in near_vectors.near_duplicates(df, **how).collect())


ODD = {
    "lengths": [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.01]), (6, [0.0, 0.5, 0.0])],
    "magnitudes": [(1, [1e200, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [0.0, 1e308, 1e308]), (5, [0.0, 5e-324, 5e-324]), (6, [0.0, float("inf"), 1.0])],
    "repeated ids": [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (7, [1.0, 0.01, 0.0]), (9, [0.0, 0.0, 1.0]), (5, None)],
    "null ids and equal vectors": [(None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (None, None), (4, [0.0, 0.0]), (6, []), (8, [1.0, None])],
}


@pytest.mark.parametrize("name", ODD)
def test_odd_vectors(spark, name):
    assert found(spark, ODD[name]) == brute(ODD[name])


def test_every_level_below_the_sample_splits(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((6000, 12))
    x[1000:1500] = x[0] + 0.1 * r.standard_normal((500, 12))
    x[2000:2400] = np.repeat(x[2000:2100], 4, axis=0) + 0.05 * r.standard_normal((400, 12))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    forest = near_vectors.Forest(unit[:300], 8, 4, 0.05, 1)
    assert forest.top == 2
    rows, leaves = forest.leaves(unit)
    assert np.bincount(np.unique(leaves, return_inverse=True)[1]).max() < 1200 and set(rows.tolist()) == set(range(6000))
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    got = found(spark, [(i, v.tolist()) for i, v in enumerate(x)], leaf=64, sample=300)
    total = sum(k[1] for k in got.elements())
    assert 0.95 * links.sum() <= total <= links.sum()


def morse(n):
    word = b"a"
    while len(word) < n:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    return word.decode()


def test_words_that_polynomials_confuse(spark):
    a = morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    short = morse(64)[:60]
    other = short.translate(str.maketrans("ab", "ba"))
    texts = [a, b, short, other, f"x {a} y z w", f"x {b} y z w", "a\0", "a", "w w w w w", "w w w w w w", "w w w w"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {i: (1, 9 if i == 10 else i) for i in range(1, 12)}
    items = spark.createDataFrame([(1, b), (2, f"x {b} y z w")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(df, items).collect()} == {(2, 1), (6, 2)}
    seen = {}
    r = np.random.default_rng(1)
    for _ in range(3000):
        word = bytes(r.integers(97, 100, r.integers(1, 90)).astype(np.uint8))
        h = int(shingles.word_arrays([word])[0][0])
        assert seen.setdefault(h, word) == word


def test_bitmaps_bound_from_below():
    r = np.random.default_rng(2)
    for n in (3, 700, 5000):
        a = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[: int(0.8 * len(a))], r.integers(-(1 << 62), 1 << 62, n // 3)]))
        differ = len(np.setxor1d(a, b))
        assert jaccard_join.differing(jaccard_join.wide_bitmap(a), jaccard_join.wide_bitmap(b)) <= differ
        assert jaccard_join.differing(jaccard_join.folded(jaccard_join.wide_bitmap(a), 8), jaccard_join.wide_bitmap(b)) <= differ


def test_components_in_blocks(spark, monkeypatch):
    """Edge lists of more than one block go through star rounds."""
    monkeypatch.setattr(components, "BLOCK", 50)
    r = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in components.components(spark.createDataFrame([(a, b) for a, b in edges] + [(None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
