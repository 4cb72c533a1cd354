"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact on whole texts.

Two documents link when 100 * |A & B| >= 75 * |A | B| over their distinct word shingles. The
result names each document's component, so links inside a group that is already known to be
connected need not be enumerated; no link that could join two groups is skipped.

1. One pass over the texts gives each document its set's size, a 128-bit class key (equal sets
   are one class) and a parity bitmap, and finds *common* shingles (those that recur within slices
   of the corpus), a list of bounded length that holds the most frequent ones.
2. A second pass takes each class's *prefix*: the first ``n - ceil(0.75 n) + 1`` shingles in the
   order (how common, hash). Two sets that link share a shingle of both prefixes, whatever the
   order, so the order only decides how many rows meet. Prefixes travel as packed arrays of
   (hash, id), dealt by hash; of hashes that two documents have, those with the very same
   documents come out as one *key*, as they would only find the same pairs again.
3. Turns hold each class against hubs of its keys (the key's first class, then ones picked
   by hash), a bounded number of pairs for each class. Those that pass the size and bitmap bounds are
   verified by intersecting their sorted arrays, and joined to components: this is what
   spares a large group of near copies its pairs. Keys that hold one component only then go.
   After two, turns end when one leaves most pairs of different components, or what is left is few pairs for each row.
4. What is left to find are links between different components. Keys that hold two or more
   components meet in tiles: (key, size band, salt). Inside a tile the same bounds hold, with
   bitmaps that are longer in the bands of larger sets, and the pairs that pass are verified. A
   large key is dealt over as many salts as it needs.

Why the bitmap bounds: bit j holds the parity of a set's shingles that hash to j. Where two
bitmaps differ, at least one shingle is in one set only, so |A ^ B| >= popcount(a ^ b) and
2 |A & B| <= |A| + |B| - popcount(a ^ b).

A bitmap of bounded length travels with each row, one as long as the set with each pair: parities
of half as many bits are the exclusive or of the halves, so bitmaps of two lengths compare.

Whole shingle sets move only for documents of pairs that passed the bounds; they are made anew
from the texts, which never move themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, chunks, cut, map_batches, release
from .components import components
from .shingles import WHITE, mix, set_key, shingle_sets

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 75
#: A shingle is common if it was counted so often in slices that have it twice, and how many common ones there are at most (the most frequent).
COMMON, COMMON_MOST = 4, 2_000_000
#: Documents whose shingles are counted together in the search for common ones.
SLICE, SLICE_SHINGLES = 4096, 4 << 20
#: Prefix entries of a bucket on average.
BUCKET_ENTRIES = 1 << 19
#: Words of 64 bits in the bitmap that travels with a class, and at most in the one that travels with a tile's rows.
BITMAP, TILE_BITMAP = 8, 64
#: Hubs that a node is held against in the first turn and in later ones, the most turns, pairs for each row that are left to tiles before that, and the share of pairs that a turn has to leave at most.
HUBS, TURNS, EASY, HELPED = (1, 8), 6, 32, 0.75
#: Rows of a key that one salt of a tile holds.
TILE = 512


def least_overlap(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """Smallest intersection with which sets of n and m shingles link."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def wide_bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles over about as many bits as there are shingles, at least 512, as 64-bit words."""
    size = 1 << max(9, int(len(s) - 1).bit_length()) if len(s) else 512
    bits = np.bincount((mix(s.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap over fewer bits: halves are added as parities."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits that differ between two bitmaps, the longer one folded: a bound from below of |A ^ B|."""
    n = min(len(a), len(b))
    return int(np.bitwise_count((folded(a, n) ^ folded(b, n)).view(np.uint64)).sum())


def _first_pass(docs: DataFrame, k: int, table: bytes) -> DataFrame:
    """``id, n, class, bits`` of every document; besides, with null bits and class, hashes (as id) that are common in a slice, and their documents (as n)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "class", "bits", "wide", "common"]
        held: dict[bytes, np.ndarray] = {}
        seen = size = 0

        def counted() -> pa.RecordBatch:
            every = np.concatenate([*held.values(), np.zeros(0, dtype=np.int64)])
            held.clear()
            every.sort()
            found, n = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
            m = len(found)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n + 1), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64())), pa.array([True] * m, type=pa.bool_())], names=names)

        for batch in batches:
            texts = bytes_of(batch.column(1))
            for lo, hi in chunks([len(t) for t in texts]):
                sets = shingle_sets(texts[lo:hi], table, k)
                keys = [set_key(s, t, table) for s, t in zip(sets, texts[lo:hi], strict=True)]
                wide = [wide_bitmap(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([len(s) for s in sets], type=pa.int64()), pa.array(keys, type=pa.binary()), pa.array([folded(w, BITMAP) for w in wide], type=pa.list_(pa.int64())), pa.array(wide, type=pa.list_(pa.int64())), pa.array([False] * len(sets), type=pa.bool_())],
                    names=names,
                )
                for s, key in zip(sets, keys, strict=True):
                    seen += 1
                    if len(s) and key not in held:
                        held[key] = s
                        size += len(s)
                if seen >= SLICE or size >= SLICE_SHINGLES:
                    yield counted()
                    held, seen, size = {}, 0, 0
        if held:
            yield counted()

    return map_batches(docs, kernel, "id long, n long, class binary, bits array<long>, wide array<long>, common boolean")


def prefix(s: np.ndarray, common: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles one of which any linking set shares in its own prefix, in the order (level, hash); shingles that are not common have level 0."""
    n = len(s)
    want = n - (percent * n + 99) // 100 + 1 if n else 0
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.argsort(np.where(common[at] == s, level[at], 0), kind="stable")]
    return s[:want]


def _packed(keys: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, keys, first id, id steps) of packed prefix entries."""
    order = np.argsort(ids, kind="stable")
    keys, ids = keys[order], ids[order]
    bucket = (keys.view(np.uint64) >> np.uint64(40)).astype(np.int64) % buckets
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    rows: list[tuple] = []
    for part in np.split(by, cuts) if len(by) else []:
        own = ids[part]
        wide = int(own[-1]) - int(own[0]) >= 1 << 32
        rows.append((int(bucket[part[0]]), keys[part].tobytes(), int(own[0]), (own if wide else (own - own[0]).astype(np.uint32)).tobytes()))
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "keys", "first", "steps"])


def _unpacked(keys: bytes, first: int, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, dtype=np.int64)
    if len(steps) == len(keys):
        return k, np.frombuffer(steps, dtype=np.int64)
    return k, np.frombuffer(steps, dtype=np.uint32).astype(np.int64) + first


def _shared_keys(docs: DataFrame, k: int, table: bytes, percent: int, common: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """``key, id, core, hashes``: one row per id and set of ids that share prefix hashes, one id per class and task at least.

    core: one of the key's hashes is in the id's shorter prefix; hashes: how many the key stands for in its
    bucket. A key is made from the ids that have its hashes; that two sets of ids might make the same one only adds pairs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts, names = bytes_of(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in chunks([len(t) for t in texts]):
                for i, t, s in zip(names[lo:hi], texts[lo:hi], shingle_sets(texts[lo:hi], table, k), strict=True):
                    if not len(s) or i is None or (key := set_key(s, t, table)) in seen:
                        continue
                    seen.add(key)
                    own = prefix(s, *order, percent)
                    # The lowest bit tells the part of the prefix that partners of the same size or larger must share.
                    core = np.arange(len(own)) < len(s) + 1 - -(-2 * percent * len(s) // (100 + percent))
                    keys.append((own & ~1) | core)
                    ids.append(np.full(len(keys[-1]), i, dtype=np.int64))
                    size += len(keys[-1])
            if size >= 1 << 19:
                yield _packed(np.concatenate(keys), np.concatenate(ids), buckets)
                keys, ids, size = [], [], 0
                if len(seen) > 1 << 17:
                    seen.clear()
        if size:
            yield _packed(np.concatenate(keys), np.concatenate(ids), buckets)

    def repeated(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """A bucket's entries whose key two ids have; taken in ranges so that a large bucket needs little more than itself."""
        total = sum(len(x[0]) for x in parts)
        ranges = max(1, -(-total // (1 << 20)))
        for r in range(ranges):
            pick = [(x[0].view(np.uint64) >> np.uint64(1) & np.uint64(0xFFFF)) % np.uint64(ranges) == np.uint64(r) for x in parts] if ranges > 1 else [slice(None)] * len(parts)
            key, i = (np.concatenate([x[c][p] for x, p in zip(parts, pick, strict=True)]) for c in (0, 1))
            core, key = (key & 1).astype(bool), key & ~1
            order = np.lexsort((i, key))
            key, i, core = key[order], i[order], core[order]
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1])
            key, i, core = key[fresh], i[fresh], core[fresh]
            twin = np.zeros(len(key), dtype=bool)
            same = key[1:] == key[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            key, i, core = key[twin], i[twin], core[twin]
            if not len(key):
                continue
            runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            same_ids = np.repeat(np.add.reduceat(mix(mix(i.view(np.uint64)) + np.uint64(k)), runs).view(np.int64), np.diff(runs, append=len(key)))
            order = np.lexsort((i, same_ids))
            key, i, core = same_ids[order], i[order], core[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1])]))
            key, i, core, hashes = key[first], i[first], np.logical_or.reduceat(core, first), np.diff(first, append=len(key))
            for lo in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (key, i, core, hashes)], names=["key", "id", "core", "hashes"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, keys, first, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and parts:
                    yield from repeated(parts)
                    parts = []
                now = bucket
                parts.append(_unpacked(keys, first, steps))
        if parts:
            yield from repeated(parts)

    packed = map_batches(docs, pack, "bucket long, keys binary, first long, steps binary")
    return map_batches(packed.repartition("bucket").sortWithinPartitions("bucket"), unpack, "key long, id long, core boolean, hashes long")


def _wanted_bits(ids: DataFrame, n: int) -> np.ndarray:
    """A one-hash filter over ids: at least 16 bits for each of n, at most 2^27 bits (then it only passes more)."""
    words = 1 << min(21, max(8, int(np.ceil(np.log2(max(1, n * 16 / 64))))))
    rows = ids.selectExpr(f"pmod(xxhash64(id), {words * 64}) AS at").selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, CAST(at & 63 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, dtype=np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _sets(docs: DataFrame, k: int, table: bytes, wanted: DataFrame, unique: bool) -> DataFrame:
    """``id, class, set`` of ids that pass a filter for the wanted ones, made anew from their texts."""
    bits = _wanted_bits(wanted, wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    at = F.pmod(F.xxhash64("id"), F.lit(len(bits) * 64))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((shared.value[place >> 6] >> (place & 63)) & 1 == 1))
            texts = bytes_of(batch.column(1))
            for lo, hi in chunks([len(t) for t in texts]):
                sets = shingle_sets(texts[lo:hi], table, k)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([set_key(s, t, table) for s, t in zip(sets, texts[lo:hi], strict=True)], type=pa.binary()), pa.array(sets, type=pa.list_(pa.int64()))], names=["id", "class", "set"])

    made = map_batches(docs.where("id IS NOT NULL").select("id", "text", at.alias("place")), kernel, "id long, class binary, set array<long>")
    return made if unique else made.dropDuplicates(["id", "class"])


def _room(a: str, b: str, percent: int, differ: Column) -> Column:
    """Whether sets whose bitmaps differ in so many bits can overlap enough."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return 2 * least_overlap(n, m, percent) <= n + m - differ


def could_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and the bitmaps' first words allow a link of the sets whose columns end in a and b; a set of one shingle links with its own class only."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    differ = sum((F.bit_count(F.col(f"bits{a}")[i].bitwiseXOR(F.col(f"bits{b}")[i])) for i in range(BITMAP)), F.lit(0))
    return (least_overlap(n, m, percent) <= F.least(n, m)) & (n + m > 2) & _room(a, b, percent, differ)


def could_link_wide(a: str, b: str, percent: int) -> Column:
    """The same by all words of bitmaps that are longer."""
    every = F.aggregate(F.zip_with(f"bits{a}", f"bits{b}", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return (F.size(f"bits{a}") <= BITMAP) | _room(a, b, percent, every)


def fold_to(x: Column, words: Column, halvings: int) -> Column:
    """A bitmap folded until it has so many words; ``halvings`` are enough for that."""
    half = lambda s: (F.size(s) / 2).cast("int")
    fold = lambda s: F.zip_with(F.slice(s, F.lit(1), half(s)), F.slice(s, half(s) + 1, half(s)), lambda p, q: p.bitwiseXOR(q))
    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), x, lambda s, _: F.when(F.size(s) > words, fold(s)).otherwise(s))


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose wide bitmaps allow a link, with what finds their texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_pylist() for c in (2, 3))
            x, y = ([v.values.to_numpy() for v in batch.column(c)] for c in (4, 5))
            keep = [100 * (p + q - d) >= percent * (p + q + d) for p, q, d in zip(n, m, map(differing, x, y), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b"), kernel, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, table: bytes, percent: int, unique: bool) -> DataFrame:
    """Pairs (a, b) of nodes whose sets link, by intersection of their sorted arrays."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("id").alias(f"id_{x}"), F.col("class").alias(f"class_{x}")) for x in "ab")
    pairs = cut(_bounded(pairs, nodes, percent).join(left, "a").join(right, "b"))
    if pairs.isEmpty():
        return pairs.select("a", "b")
    sets = _sets(docs, k, table, pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct(), unique)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    side = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.col("class").alias(f"class_{x}"), F.col("set").alias(f"set_{x}"))
    both = pairs.join(side("a"), ["id_a", "class_a"]).join(side("b"), ["id_b", "class_b"])
    out = cut(map_batches(both.select("a", "b", "set_a", "set_b"), kernel, "a long, b long"))
    release(docs.sparkSession)
    return out


def _open(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries with their components, of keys that hold two components at least."""
    labelled = entries.drop("component").join(parts, "node", "left").select("key", "node", "core", "hashes", F.coalesce("component", "node").alias("component"))
    per = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return cut(labelled.join(per, "key"))


def _hub_pairs(entries: DataFrame, nodes: DataFrame, percent: int, turn: int, most: int) -> DataFrame:
    """Pairs (a, b) of a node and those hubs of its keys that it shares most keys with, ``most`` at most; the tiles see what is left.

    A key's hub is its first node, or from the second turn on one picked by a hash of node and key.
    """
    order = F.col("node") if not turn else F.xxhash64("node", "key", F.lit(turn))
    hubs = entries.groupBy("key").agg(F.min(F.struct(order.alias("order"), F.col("node").alias("hub"), F.col("component").alias("hub_part"))).alias("h")).select("key", "h.hub", "h.hub_part")
    shared = entries.join(hubs, "key").where("component <> hub_part").groupBy("node", "hub").agg(F.sum("hashes").alias("keys"))
    best = shared.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("keys"), "hub"))).where(F.col("place") <= most)
    pairs = best.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(could_link("_a", "_b", percent)).select("a", "b")


def _open_pairs(entries: DataFrame) -> tuple[int, float]:
    """Rows, and pairs of different components under one key."""
    parts = entries.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    got = parts.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
    return int(got.rows or 0), got.pairs or 0.0


def _tiled(entries: DataFrame, nodes: DataFrame, percent: int, tile: int) -> DataFrame:
    """Candidate pairs between components: same key, sizes that can link, bitmaps that can overlap enough."""
    per = entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    # A linking pair's sizes differ by less than 100/percent, so its bands are equal or next to each other.
    step = 100.0 / percent
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step)) + 1e-9).cast("int")
    # Never more words than the smallest set of the band has in its own bitmap.
    words = lambda b: F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.pow(F.lit(step), b)) - 1e-6) - 6), F.lit(float(BITMAP))), F.lit(float(TILE_BITMAP))).cast("int")
    wide = nodes.select("node", "n", "wide", band.alias("band")).join(entries.select("node").distinct(), "node", "left_semi")
    wide = wide.select("node", "n", "band", fold_to(F.col("wide"), words(F.col("band")), 40).alias("bits"))
    open_ = entries.join(per, "key").join(wide, "node").withColumn("salts", F.ceil(F.col("rows") / tile).cast("int"))
    left = open_.select("key", "band", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), *(F.col(c).alias(f"{c}_a") for c in ("node", "component", "n", "bits", "band", "core")))
    spread = F.explode(F.expr("flatten(transform(array(band, band - 1), b -> transform(sequence(0, salts - 1), s -> struct(b AS band, s AS salt))))")).alias("t")
    right = open_.select("key", spread, *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "bits", "band", "core")))
    right = right.select("key", F.col("t.band").alias("band"), F.col("t.salt").alias("salt"), "node_b", "component_b", "n_b", fold_to(F.col("bits_b"), words(F.col("t.band")), 3).alias("bits_b"), "band_b", "core_b")
    # Each pair once: the larger band on the right, or the larger node within a band.
    once = (F.col("band_a") < F.col("band_b")) | (F.col("node_a") < F.col("node_b"))
    # Sets of one size or a smaller one share a key of the smaller set's core.
    core = (F.col("core_a") | (F.col("n_a") > F.col("n_b"))) & (F.col("core_b") | (F.col("n_b") > F.col("n_a")))
    could = once & core & (F.col("component_a") != F.col("component_b")) & could_link("_a", "_b", percent) & could_link_wide("_a", "_b", percent)
    joined = left.join(right, (left["key"] == right["key"]) & (left["band"] == right["band"]) & (left["salt"] == right["salt"]) & could)
    return joined.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, table: bytes = WHITE, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    component_id is the smallest id reachable by links, the row's own included. Null, empty
    and blank texts have 0 shingles and link with nothing; a text of fewer than ``k`` words is one
    shingle, its whole sequence of words. A row whose id is null keeps its count and has a null
    component, and links nothing. Rows that share an id are one document to the links: each
    of their sets takes part, and all get the same component. Other columns are ignored
    whatever their names; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = cut(_first_pass(docs, k, table))
    sig = first.where("NOT common").select("id", "n", "class", "bits", "wide")
    total = sig.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles"), F.count("id").alias("ids"), F.countDistinct("id").alias("distinct")).first()
    unique = total.ids == total.distinct
    often = first.where("common").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    found = often.count()
    if found > COMMON_MOST:
        least = often.agg(F.percentile_approx("n", 1 - COMMON_MOST / found)).first()[0]
        often = often.where(F.col("n") > least)
    listed = often.select("id", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()  # COMMON_MOST at most
    common, level = listed.column(0).to_numpy(), listed.column(1).to_numpy()
    order = np.argsort(common)
    common = (common[order], level[order])
    real = sig.where("id IS NOT NULL AND n > 0")
    # A class is named by its smallest id; where ids have several classes any number will do once it is written.
    name = F.col("id") if unique else F.monotonically_increasing_id()
    nodes = cut(real.groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.count(F.lit(1)).alias("rows")).withColumn("node", name))
    # Classes with many rows, fewer than 1024 of them, are told to every task; the others meet their rows by a shuffle.
    large = max(1024, total.docs // 1024)

    def by_class(rows: DataFrame, named: DataFrame) -> DataFrame:
        """Rows with what ``named`` says of their class; as many rows of one class as there may be."""
        named = named.join(nodes.select("class", "rows"), "class")
        hot = F.broadcast(named.where(F.col("rows") > large).drop("rows"))
        cold = named.where(F.col("rows") <= large).drop("rows")
        return rows.join(hot, "class").unionByName(rows.join(hot.select("class"), "class", "left_anti").join(cold, "class", "left"))

    member = cut(by_class(real.select("id", "class").distinct(), nodes.select("class", "node")).select("id", "node"))

    buckets = min(1 << 16, max(1, -(-total.shingles // (4 * BUCKET_ENTRIES))))
    entries = _shared_keys(docs, k, table, percent, common, buckets).join(member, "id").groupBy("key", "node").agg(F.max("core").alias("core"), F.sum("hashes").alias("hashes"))
    entries = cut(entries)
    release(docs.sparkSession)
    ids = member.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b <> hi")
    same_id = member.join(ids.select("id", "b"), "id").where("node <> b").select(F.col("node").alias("a"), "b")
    links, left, pairs = same_id, entries.withColumn("component", F.col("node")), float("inf")
    for turn in range(TURNS):
        new = _verified(_hub_pairs(left, nodes, percent, turn, HUBS[min(turn, len(HUBS) - 1)]), docs, nodes, k, table, percent, unique)
        links = cut(links.union(new))
        parts = components(links)
        left = _open(left, parts)
        release(docs.sparkSession)
        (rows, pairs), before = _open_pairs(left), pairs
        if not pairs or turn and (pairs <= EASY * rows or pairs > HELPED * before):
            break
    if pairs:
        parts = components(links.union(_verified(_tiled(left, nodes, percent, tile), docs, nodes, k, table, percent, unique)))
    if unique:
        named = nodes.join(parts, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
        linked = by_class(real.select("id", "n", "class"), named).select("id", "n", "component_id")
        answer = linked.unionByName(sig.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id")))
    else:
        named = member.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("id").alias("component_id"))
        per_id = named.join(least, "component").groupBy("id").agg(F.min("component_id").alias("component_id"))
        answer = sig.select("id", "n").join(per_id, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    return answer.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each linked group: the one whose id is smallest; all columns as they were.

    Texts without words and rows with a null id stay. Of rows that share a kept id and have
    words, one stays.
    """
    # Three numbers for each row, read three times: written, they spare the driver the plan of the whole join in each of them.
    parts = cut(jaccard_components(docs, id_col, text_col, **how))
    release(docs.sparkSession)
    leave = parts.where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(leave, docs[id_col] == F.col("__gone"), "left_anti")
    twice = parts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select(F.col("doc_id").alias("__twice"))
    if twice.isEmpty():
        return kept
    single = kept.join(twice, kept[id_col] == F.col("__twice"), "left_anti")
    double = kept.join(twice, kept[id_col] == F.col("__twice"), "left_semi")
    return single.unionByName(double.dropDuplicates([id_col]))
