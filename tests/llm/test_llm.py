import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import chat_pairs, decontaminate, jaccard_join, licenses, near_vectors, packing, queries, sharding, token_counts, tokens, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
LONG = " ".join(rng.choice(WORDS) for _ in range(6000)) + "."
BASE = [rng.choice(WORDS) for _ in range(80)]
ODD = [(1, None, 0), (2, "", 0), (3, "  \n\t ", 0), (4, "one", 1), (5, "One", 1), (6, " ".join(BASE), 1), (7, " ".join(BASE), 1), (8, " ".join(BASE[:79] + ["zz"]), 0), (9, LONG, 0), (10, "été ñandú İstanbul é <|endoftext|> don't 3.5 你好。", 0), (None, " ".join(BASE), 0), (6, " ".join(BASE), 1), (11, "a " * 50, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated rows and columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, x, "n", 7) for i, t, x in ODD], "doc_id long, text string, n int, key string, component long").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def library():
    return tokens.Encoder().library


def test_prefix_counts_match_library():
    pc, lib, r = token_counts.PrefixCounter(), library(), random.Random(3)
    alphabet = "abcdehilnorst ABC'.,!?-é ß1234567890<|>\n你İ́"
    for _ in range(60):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60))) + r.choice(["", "we're they'll", "<|endoftext|>x", "internationalisation"])
        counts = token_counts.prefix_counts(token_counts.stored(pc.text(text)))
        assert counts.tolist() == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text


def test_token_counts_on_odd_rows(odd, none):
    lib = library()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.prefix_tables(odd).collect())
    assert got == Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert token_counts.prefix_tables(none).count() == 0
    blob = token_counts.stored(token_counts.PrefixCounter().text("hello there you"))
    assert token_counts.count_at(blob, 5) == 1 and token_counts.longest_within(blob, 1) >= 5


def test_packing_round_trip(odd, none):
    lib = library()
    rows = packing.pack(odd, with_ids=True).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        docs[r.doc_id, r.doc_tokens].append(r)
        seqs[r.sequence_id].append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for r in rows) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in ODD)
    whole = [x for r in sorted(docs[9, len(lib.encode(LONG, add_special_tokens=False).ids) + 1], key=lambda r: r.start) for x in r.ids]
    assert whole == [*lib.encode(LONG, add_special_tokens=False).ids, 2]
    assert packing.pack(none).count() == 0


def test_best_cuts_are_optimal():
    r = random.Random(1)
    for _ in range(40):
        n = r.randrange(1, 60)
        at, cost = packing.cut_points(n, np.array(sorted(r.sample(range(1, n + 1), min(n, 5)))), np.array([n]), 7, (0, 3, 9))
        best = {0: 0.0}
        for k in range(1, len(at)):
            best[k] = min(best[i] + 16 - (at[k] - at[i]) + cost[k] for i in range(k) if at[k] - at[i] <= 16)
        cuts = packing.best_cuts(at, cost, 16)
        of = dict(zip(at.tolist(), cost.tolist(), strict=True))
        assert sum(16 - (b - a) + of[b] for a, b in zip(cuts, cuts[1:], strict=False)) == pytest.approx(best[len(at) - 1])


def brute_components(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def test_jaccard_on_odd_rows(odd, none):
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(odd).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components([(i, t) for i, t, _ in ODD])
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 9, 10, 11]


def test_jaccard_near_the_limit(spark):
    r, rows = random.Random(9), []
    for g in range(25):
        base = [r.choice(WORDS) for _ in range(r.randrange(5, 120))]
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w[: len(w) - r.randrange(0, 3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (1, 512):
        got = Counter(tuple(x) for x in jaccard_join.jaccard_components(df, tile=tile).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute_components(rows)


def test_near_vectors(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((700, 16))
    x[100:250] = x[0] + 0.02 * r.standard_normal((150, 16))
    x[300:330] = x[299] + 0.05 * r.standard_normal((30, 16))
    x[400] = x[401]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [1.0, None] + [1.0] * 14, 0), (904, [], 0)]
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, ball int"), leaf=64).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    found = sum(v[0] for v in got.values())
    assert found <= links.sum() and found >= 0.99 * links.sum()
    assert got[400][0] >= 1 and got[401][1] == 400
    assert all(got[i] == (0, i, True) for i in range(900, 905))
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert near_vectors.near_duplicates(empty).count() == 0


def test_sharding(odd, none):
    rows = sharding.external_shuffle(odd, shards=4, carry=("text", "n"), bucket_rows=3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.external_shuffle(none).count() == 0


def test_toxicity(spark, odd, none):
    r, texts = random.Random(4), []
    for i in range(600):
        words = [r.choice(WORDS) for _ in range(r.randrange(10, 150))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilest", "wretch"]))
        texts.append((i, " ".join(words), int(i % 4 == 0)))
    net = toxicity.train([t for _, t, _ in texts[:500]], [y for _, _, y in texts[:500]])
    scores = toxicity.Scorer(net).scores([t for _, t, _ in texts[500:]])
    assert np.mean((scores >= 0.5) == np.array([y for _, _, y in texts[500:]])) > 0.95
    out = toxicity.toxicity_scores(odd, net).collect()
    assert len(out) == len(ODD) and all(0 <= q.score <= 1 for q in out)
    assert toxicity.toxicity_scores(none, net).count() == 0 and toxicity.drop_toxic(odd, net).columns == odd.columns
    assert toxicity.Scorer(toxicity.train(["a", "b"], [0, 0])).scores(["x"])[0] < 0.3
    starts = toxicity.windows_of(101)
    assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= 101 and (np.diff(starts) < toxicity.WINDOW).all()


def test_gradients_of_the_network():
    net = toxicity.Network(["aa", "bb", "cc"], np.array([0.5, -0.5, 0.1]), 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, grams = np.array([[2, 3], [4, 1], [0, 2]]), np.arange(12).reshape(3, 2, 2)
    gmask, mask, y = np.ones((3, 2, 2)), np.array([[1, 1], [1, 1], [0, 1]], float)[:, :, None], np.array([1.0, 0.0])

    def loss():
        p = net.p
        x = np.concatenate([p["E"][rows], p["C"][grams].mean(2)], axis=2).astype(np.float32)
        z, _ = net.pooled(x, x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask)
        q = toxicity.sigmoid(z)
        return float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))

    got = net.step_gradients(rows, grams, gmask, mask, y, np.ones(2))
    for name in ("w", "Uf", "Wb", "Wa", "va", "cf", "E"):
        v, i = net.p[name], np.unravel_index(np.argmax(np.abs(got[name])), net.p[name].shape)
        v[i] += 1e-2
        up = loss()
        v[i] -= 2e-2
        down = loss()
        v[i] += 1e-2
        assert got[name][i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4), name


def test_urls(spark):
    rows = [(1, "http://a.Example.ORG/es/x"), (2, "https://example.org/en/12"), (3, "http://x.org/q"), (4, "http://xorg/"), (5, None), (6, "nothing"), (7, "http://a.com/de/?x=/fr/"), (8, "http://org"), (9, "http://x.com/fr/a#b")]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(df, url_filter.train_on_rules(df)).collect()}
    assert [got[i].rule for i in range(1, 10)] == ["example.org/es/", "example.org/en/1", "org/", None, None, None, "com/de/", None, "com/fr/"]
    assert got[1].host == "a.example.org" and got[1].verdict == "block" and got[5].host == got[6].path == "" and got[8].path == ""
    assert url_filter.judge(df.where("false"), url_filter.UrlModel([], [])).count() == 0
    urls = [(f"http://h{i}.{'bad' if i % 2 else 'good'}.net/{i}", f"h{i}.{'bad' if i % 2 else 'good'}.net", f"/{i}") for i in range(300)]
    model = url_filter.UrlModel(urls[:200], [i % 2 for i in range(200)])
    assert ((model.block_scores(urls[200:]) > 0.5) == (np.arange(200, 300) % 2 == 1)).mean() > 0.95


def test_licenses(spark, odd, none):
    mit = " ".join(licenses.SENTENCES[i][0] + "." for i in (9, 10, 11))
    wrapped = mit.replace(" of ", " of\n")
    rows = [(1, "Text.\nReleased under the MIT License.\nMore"), (2, wrapped), (3, mit.replace("IN NO EVENT", "AT NO TIME")), (4, None), (5, "licensed under cc by-nc 4.0! Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.rule, r.n_matches) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit-notice", 1), (2, "mit-text", 1), (5, "cc-by-nc-4-notice", 2)}
    assert licenses.scan(odd).count() == licenses.scan(none).count() == 0


def test_chat_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b <|im_end|>"), (3, 0, "user", "z"), (3, 1, "assistant", "y"), (4, 0, None, None), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.chosen_id: r for r in chat_pairs.format_pairs(chat_pairs.pair_by_opening(df)).collect()}
    r = got[1]
    assert (r.rejected_id, r.prompt_turns, r.prompt) == (2, 1, "<|im_start|>user\nq<|im_end|>\n") and "<| im_end|>" in r.rejected
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "a<|im_end|>"
    assert got[3].rejected == "" and got[3].chosen.endswith("y<|im_end|>\n") and set(got) == {1, 3, 4}
    assert chat_pairs.pair_by_opening(df.where("false")).count() == 0


def test_decontamination(spark, odd, none):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randrange(3, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "one")]
    docs = []
    for i in range(60):
        w, item = [r.choice(WORDS) for _ in range(300)], items[i % 30][1].split()
        docs.append((i, " ".join(w[:100] + item[: r.randrange(len(item) // 2, len(item)) + 1] + w[100:])))
    docs += [(i, t) for i, t, _ in ODD]
    shingle = lambda t: (lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = Counter((d, i, len(s), len(s & shingle(t))) for d, t in docs for i, x in items if (s := shingle(x)) and 100 * len(s & shingle(t)) >= 75 * len(s))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (4 << 20, 500):
        assert Counter(tuple(x) for x in decontaminate.contained_items(left, right, block_bytes=block).collect()) == want
    assert decontaminate.contained_items(none, right).count() == decontaminate.contained_items(odd, right.where("false")).count() == 0
    assert decontaminate.decontaminate(odd, right).count() == len(ODD) - 2  # "one" and "One" are an item


def test_whole_queries_are_stable(spark):
    for name in ("op1_packing", "op3_sharding"):
        digest = [hashlib.md5(str(sorted(map(str, queries.QUERIES[name](spark, DATA).collect()))).encode()).hexdigest() for _ in range(2)]
        assert digest[0] == digest[1]


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.select("doc_id").distinct().count() == docs.count() and pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
