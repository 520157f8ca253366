"""SimHash near-duplicates, found with a hierarchical index over fingerprints in Gray order.

Fingerprints that differ in at most k bits agree in one of k + 1 blocks of bits, so each is dealt to the
k + 1 buckets of its blocks and compared inside them only. In a bucket the fingerprints are sorted by their
rank in the Gray code, which puts similar ones side by side. Neighbours form leaf nodes, neighbouring nodes
upper nodes. A node holds the bits on which all below it agree, as a mask and a pattern, without those that
its parents hold already. A search adds up the differences from node to node on its way down and leaves a
whole group as soon as they exceed k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Sorted, bounded_sample, broadcasts, discard, map_texts, packed, trim, tune, unpacked, written
from .components import stars

SHINGLE, SEED, DISTANCE, FANOUT = 3, 42, 3, 8
FRONTIER = 1 << 18  # pairs of a query and a node that are held at once
HOT, LEVELS = 100_000, 4  # fingerprints from which a bucket is cut again, and how often that can be
CHUNK = 1 << 16  # shingles that are held at once
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the text's shingles of `width` words, as 64 bits; 0 if it has no word."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is 9 to 13 and 32
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = [0, *(ends[:-width] + 1).tolist()]
    last = ends[width - 1 :].tolist()
    n, counts, digest = len(first), np.zeros((8, 256), dtype=np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        part = first[lo : lo + CHUNK]
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(part, last[lo : lo + CHUNK], strict=True)), dtype="<u8", count=len(part))
        octets = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long): every whole text's fingerprint, as a signed integer. Null and blank texts have 0."""
    return map_texts(docs, lambda: lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))], "fp long", key, text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class HammingIndex:
    """The hierarchical index over the fingerprints of many buckets, each bucket with a tree of its own."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fanout: int = FANOUT) -> None:
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, self.codes = order, codes[order]
        bucket = bucket[order]
        #: From the leaves up: first and last + 1 of each node's children, its last code, its agreeing bits and pattern.
        self.levels: list[dict[str, np.ndarray]] = []
        low = high = self.codes
        last = np.arange(1, len(codes) + 1)
        while True:
            fresh = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            starts = np.flatnonzero(fresh)
            place = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.append(starts, len(bucket))))
            first = np.flatnonzero(place % fanout == 0)
            end = np.append(first[1:], len(bucket))
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            agree = ~(low ^ high)
            last, bucket = last[end - 1], bucket[first]
            self.levels.append({"first": first, "end": end, "last": last, "agree": agree, "own": agree, "pattern": low})
            if len(np.unique(bucket)) == len(bucket):
                break
        for lower, upper in zip(self.levels, self.levels[1:], strict=False):
            lower["own"] = lower["agree"] & ~np.repeat(upper["agree"], upper["end"] - upper["first"])

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places i < j, in the index's order, of all codes of one bucket that differ in at most `distance` bits."""
        top = self.levels[-1]
        size = np.diff(np.append(0, top["last"]))
        tree = np.repeat(np.arange(len(size)), size)
        depth = len(self.levels) - 1
        for lo in range(0, len(tree), FRONTIER):
            own = tree[lo : lo + FRONTIER]
            yield from self._down(depth, np.arange(lo, lo + len(own)), own, np.zeros(len(own), dtype=np.uint8), distance)

    def _down(self, depth: int, query: np.ndarray, node: np.ndarray, spent: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Follow (query, node) pairs into the nodes' children, `spent` being the differences so far."""
        level = self.levels[depth]
        for part in range(0, len(query), FRONTIER // FANOUT):
            cut = slice(part, part + FRONTIER // FANOUT)
            q, k = query[cut], node[cut]
            count = level["end"][k] - level["first"][k]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            child = np.repeat(level["first"][k], count) + step
            q, used = np.repeat(q, count), np.repeat(spent[cut], count)
            if depth == 0:
                keep = child > q
                q, child = q[keep], child[keep]
                near = np.bitwise_count(self.codes[q] ^ self.codes[child]) <= distance
                if near.any():
                    yield q[near], child[near]
                continue
            below = self.levels[depth - 1]
            keep = below["last"][child] - 1 > q  # nodes wholly before the query have met it already
            q, child, used = q[keep], child[keep], used[keep]
            used = used + np.bitwise_count((self.codes[q] ^ below["pattern"][child]) & below["own"][child])
            keep = used <= distance
            yield from self._down(depth - 1, q[keep], child[keep], used[keep], distance)


class Forest:
    """Union-find over places, a batch of links at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self.parent = self.parent[self.parent]


def bucket_links(keys: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each linked fingerprint of these buckets but one of its group: itself, and that one."""
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count[back] > 1
    keys, codes = keys[shared], codes[shared]
    if not len(keys):
        return codes, codes
    index = HammingIndex(keys, codes)
    forest = Forest(len(codes))
    for a, b in index.pairs(distance):
        forest.link(a, b)
    all_ = np.arange(len(codes))
    root = forest.roots(all_)
    tied = root != all_
    return index.codes[tied], index.codes[root[tied]]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) fingerprints that are linked through buckets, enough of them to connect what is connected.

    distinct: a column fp of distinct fingerprints. A group of m fingerprints in a bucket gives m - 1 rows
    instead of its pairs, so near copies never make rows by the square of their number. A bucket with more than
    HOT fingerprints is cut again: its fingerprints agree in one block and differ in at most `distance` of the
    other bits, so they agree in one block of those too. No pair is lost, whatever the buckets' sizes.
    """
    out = None
    dealt = _deal(distinct.select("fp", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("bucket")), [-1], distance)
    frees = [f for f, _ in _blocks(-1, distance)]
    for level in range(LEVELS):
        hot = dealt.groupBy("bucket").count().filter(F.col("count") > HOT).select("bucket")
        if level == LEVELS - 1 or hot.isEmpty():
            found = _compare(dealt, distance)
            return found if out is None else out.unionByName(found)
        hot = written(hot, "hot")
        found = _compare(dealt.join(hot, "bucket", "left_anti"), distance)
        out = found if out is None else out.unionByName(found)
        dealt = _deal(dealt.join(hot, "bucket", "left_semi"), frees, distance)
        frees = [g for f in frees for g, _ in _blocks(f, distance)]
    return out


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _blocks(free: int, distance: int) -> list[tuple[int, int]]:
    """The free bits cut into distance + 1 blocks: (bits that stay free, the block) of each, as signed masks."""
    bits = [b for b in range(64) if free >> b & 1]
    cut = [bits[len(bits) * k // (distance + 1) : len(bits) * (k + 1) // (distance + 1)] for k in range(distance + 1)]
    whole = sum(1 << b for b in bits)
    masks = [sum(1 << b for b in c) for c in cut]
    return [(_signed(whole & ~m), _signed(m)) for m in masks]


def _deal(rows: DataFrame, frees: list[int], distance: int) -> DataFrame:
    """(fp, free, bucket): each fingerprint in the buckets of the blocks that its free bits are cut into.

    A bucket's number is a hash of the one it came from and of the block's bits. Should two buckets share a number,
    they are compared with one another as well, which changes nothing: every pair is checked by its distance.
    """
    parts = [(free, kept, mask) for free in frees for kept, mask in _blocks(free, distance)]
    structs = F.array(*[F.struct(F.lit(f).cast("long").alias("of"), F.lit(k).cast("long").alias("free"), F.lit(m).cast("long").alias("mask")) for f, k, m in parts])
    blocks = F.filter(structs, lambda s: s["of"] == F.col("free")) if len(frees) > 1 else structs
    dealt = rows.select("fp", "bucket", F.explode(blocks).alias("b"))
    return dealt.select("fp", F.col("b.free").alias("free"), F.xxhash64("bucket", "b.mask", F.col("fp").bitwiseAND(F.col("b.mask"))).alias("bucket"))


def _compare(dealt: DataFrame, distance: int) -> DataFrame:
    """The links inside the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = [], []
        for b in batches:
            keys.append(b.column(1).to_numpy())
            codes.append(b.column(0).to_numpy().view(np.uint64))
        if keys:
            a, b = bucket_links(np.concatenate(keys), np.concatenate(codes), distance)
            for lo in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)].view(np.int64)) for x in (a, b)], ["a", "b"])

    return dealt.select("fp", "bucket").repartition("bucket").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id): every row's fingerprint and the smallest key reachable over links.

    Fingerprints of at most `distance` differing bits are linked; equal ones always are, those of null, empty and
    blank texts (0) among them. Null keys and repeated rows are kept; a group with null keys only has a null
    component_id. An empty table gives an empty one, and other columns are not read.
    """
    tune(docs.sparkSession)
    marked = written(fingerprints(docs.select(F.col(key).alias("doc"), F.col(text).alias("t")), "doc", "t"), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    star = stars(links(distinct.select("fp"), distance))
    rooted = distinct.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    whole = written(whole.filter("size > 1"), "whole")
    # a fingerprint that stands alone needs no row: its component is its own document
    special = written(rooted.join(whole, "root").select("fp", "component_id"), "groups")
    special = special.withColumn("grouped", F.lit(True))
    joined = marked.join(special, "fp", "left")
    return joined.select(F.col("doc").alias(key), "fp", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


# near copies by similarity: rare shingles find them, whole sets of shingles decide

WIDTH, SIMILARITY = 5, 0.8


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted; of fewer words the whole sequence, of none nothing."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words))], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first, last = [0, *(ends[:-width] + 1).tolist()], ends[width - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first)))


ROWS, GROWTH = 16, 8  # nodes up to which a bucket is compared at once after the first round, and the growth of hubs from round to round in larger ones


def common_shingles(rows: DataFrame, width: int = WIDTH, sample: int = 4000, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several of a sample of texts, sorted, and how common each is. They only set an order: see `prefix`."""
    some = bounded_sample(rows, "doc", sample, 7)
    sets = map_texts(some, lambda: lambda texts: [[shingle_hashes(t, width).view(np.int64) for t in texts]], "s array<long>", "doc", "t")
    counts = sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "s").limit(most).toArrow()
    s, n = counts["s"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefix(h: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of the set's shingles in one order for all sets, rare ones first: two sets of the similarity share one of them.

    Such sets share at least similarity * len(h) shingles, so all but that many, and one more, are enough.
    """
    if not len(h):
        return h
    known, n = common
    rank = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        rank = np.where(known[at] == h, n[at], 0)
    return h[np.lexsort((h, rank))[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]]


SKETCH, WIDE, LARGE = 1 << 10, 1 << 14, 1500  # bits of a set's parity sketch, of the wider one that large sets have as well, and their least size
SHARED = 8_000_000  # shingles that are sent to the workers at once


def parities(h: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """For each of so many classes of hashes, whether the set has an odd number of them, as 64-bit words.

    A hash that only one of two sets has changes one bit, so their sketches differ in no more bits than the sets in elements.
    """
    odd = (np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def repeated(prefixes: DataFrame) -> DataFrame:
    """(s): the shingles that stand in more than one prefix. Tasks send theirs as packed columns, cut by value."""
    parts = max(1, int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(s, np.array([(k << 64) // parts for k in range(parts)], dtype=np.uint64))
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(s)], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(s[a:b], n[a:b])], pa.binary())], ["part", "blob"])

        for b in batches:
            held.append(b.column(0).flatten().to_numpy().view(np.uint64))
            size += len(held[-1])
            if size > 1 << 22:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blobs.setdefault(part, []).append(blob)
        while blobs:
            s, n = (np.concatenate(x) for x in zip(*(unpacked(b, 2) for b in blobs.popitem()[1]), strict=True))
            s, back = np.unique(s, return_inverse=True)
            s = s[np.bincount(back, weights=n.astype(np.float64)) > 1].view(np.int64)
            for lo in range(0, len(s), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(s[lo : lo + (1 << 16)])], ["s"])

    return prefixes.select("prefix").mapInArrow(deal, "part int, blob binary").repartition(parts, "part").mapInArrow(merge, "s long")


def shared_places(prefixes: DataFrame) -> DataFrame:
    """(node, size, pos, s): the places of shingles that stand in more than one prefix. The others, by far the most, link nothing.

    Up to SHARED of them are sent to the workers; more are met in a join.
    """
    several = written(repeated(prefixes), "repeated")
    if several.count() > SHARED:
        return prefixes.select("node", "size", F.posexplode("prefix").alias("pos", "s")).join(several, "s", "left_semi").select("node", "size", "pos", "s")
    table = prefixes.sparkSession.sparkContext.broadcast(Sorted(np.sort(several.toArrow()["s"].to_numpy().view(np.uint64))))
    discard(several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            s, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            k, _ = table.value.find(s.view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[k])), b.column(1).take(pa.array(row[k])), pa.array(pos[k].astype(np.int32)), pa.array(s[k])], ["node", "size", "pos", "s"])

    return prefixes.select("node", "size", "prefix").mapInArrow(run, "node long, size int, pos int, s long")


def similar(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, repeats: bool = True) -> DataFrame:
    """(a, b): those of the pairs of nodes whose sets of shingles have this Jaccard similarity or more, compared exactly.

    rows: (doc, digest, t); nodes: (node, digest, least, size, sketch, wide), one for each distinct text, `least` being a document that
    has it. Pairs whose sketches differ in more bits than similar sets can in shingles are left out first; only the texts
    of the others are read again. repeats: whether rows may hold a document and text twice.
    """
    of = lambda c, x: nodes.select(F.col("node").alias(c), F.col("size").alias(f"{x}n"), F.col("sketch").alias(f"{x}s"), F.col("wide").alias(f"{x}w"))
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    bits = F.coalesce(differ("xw", "yw"), differ("xs", "ys"))
    near = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").filter(bits <= (F.col("xn") + F.col("yn")) * ((1 - similarity) / (1 + similarity)) + 1e-9)
    pairs = written(near.select("a", "b"), "near")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("digest").alias("d"), "least"), "node")
    ends = written(ends, "ends")
    # the texts stay where they are: a block of the nodes is sent to them, and they meet in a shuffle only beyond all blocks
    met = lambda x: rows.join(x, F.col("doc").eqNullSafe(F.col("least")) & (F.col("digest") == F.col("d"))).select("node", "t")
    found = reduce(DataFrame.unionByName, map(met, broadcasts(ends, "least") or [ends]))
    sets = map_texts(found, lambda: lambda texts: [[shingle_hashes(t, width).view(np.int64) for t in texts]], "s array<long>", "node", "t")
    sets = written(sets.dropDuplicates(["node"]) if repeats else sets, "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    # written, so that nothing downstream keeps Spark from splitting the partitions of a text with many near copies
    out = written(both.filter(common + 1e-9 >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), "similar")
    discard(ends, sets, pairs)
    return out


def joined_similar(rows: DataFrame, nodes: DataFrame, prefixes: DataFrame, linked: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, repeats: bool = True) -> DataFrame:
    """(u, v) as from `stars`: the components of the nodes over the links and over all pairs of the similarity.

    prefixes: (node, size, prefix); linked: pairs of nodes that are together in any case.
    A bucket holds the nodes that have one shingle in their prefixes, and every pair of the similarity meets in one.
    Buckets with the same nodes, known by two hashes of these, are one. In each round some of a bucket's nodes, its hubs, are compared exactly with all others there that are not in
    their component yet, and then leave it. Buckets whose nodes are all in one component are done. So a pair is left out
    only if its ends are connected already by checked pairs, its sizes, places in the order or sketches rule it out, or
    it fails the check. The first round has one hub a bucket: it connects groups of near copies, at a row for each place, so that
    all pairs of a small bucket are met only where that was not enough. Hubs then grow by GROWTH.
    """
    dealt = written(shared_places(prefixes), "places")
    nodes = nodes.join(prefixes.select("node", "size", "sketch", "wide"), "node")
    roots, tested, hubs, placed_before = stars(linked), [], 1, dealt
    chance = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    words = [f"w{j}_" for j in range(SKETCH // 64)]  # of the sketch, which goes with each place of an open bucket
    short = prefixes.select("node", *[F.col("sketch")[j].alias(w) for j, w in enumerate(words)])
    while True:
        trim(rows.sparkSession)
        placed = dealt.join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        each = placed.groupBy("s").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.min(F.struct(chance, "node", "pos")).alias("first"),
            F.bit_xor(F.xxhash64("node")).alias("own"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("own2"),
        )
        # of the buckets with the same nodes the first in the order stands for all: places in it are the least for every pair
        alone = each.filter("lo < hi").groupBy("m", "own", "own2").agg(F.min(F.struct("first.pos", "s", F.col("first.node").alias("node"))).alias("x"))
        open_ = written(alone.select("x.s", "m", F.col("x.node").alias("first")), "buckets")
        if open_.isEmpty():
            discard(open_, *tested, placed_before)
            return roots
        hub = F.col("node") == F.col("first")
        if tested:
            hub = hub | (F.col("m") <= ROWS) | (chance * F.col("m") < F.lit(hubs << 30))
        placed = placed.join(open_, "s").withColumn("hub", hub)
        placed = placed if words[0] in placed.columns else placed.join(short, "node")
        last, placed = placed_before, written(placed.select("s", "node", "size", "pos", "root", "hub", *words), "open")
        other = placed.filter("hub").select("s", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "pos", "root", *words)])
        # at the first shingle that two sets share, no more than what follows can be shared as well
        most = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2"))
        met = placed.join(other, "s").filter(F.col("root") != F.col("root2")).filter(~F.col("hub") | (F.col("node") < F.col("node2")))
        met = met.filter(most + 1e-9 >= (F.col("size") + F.col("size2")) * (similarity / (1 + similarity)))
        bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}2"))) for w in words])
        met = met.filter(bits <= (F.col("size") + F.col("size2")) * ((1 - similarity) / (1 + similarity)) + 1e-9)
        pairs = met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidates")
        tested.append(pairs)
        if not pairs.isEmpty():
            near, old = similar(rows, pairs, nodes, similarity, width, repeats), roots
            roots = stars(old.toDF("a", "b").unionByName(near))
            discard(near, old)
        discard(open_, last)
        placed_before = placed
        dealt, hubs = placed.filter("not hub").select("node", "size", "pos", "s", *words), hubs * GROWTH


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: that with the smallest key.

    Rows are grouped if their texts are equal, if their fingerprints are linked as in `groups`, or if their sets of
    five-word shingles have the similarity or more, and through others that are. All columns stay. It is rows that
    are judged, not keys: rows with one key and unlike texts all stay. Null keys come after all others, so a row with
    one goes if it repeats a row that has a key. Of rows with the smallest key but near texts, that with the smallest
    digest stays; of rows with equal keys and texts, that whose other columns come first as JSON. A null text counts
    as empty. An empty table stays empty.
    """
    tune(docs.sparkSession)
    trim(docs.sparkSession)
    digest = lambda t: F.unhex(F.substring(F.sha2(F.coalesce(t, F.lit("")).cast("binary"), 256), 1, 32))
    rows = docs.select(F.col(key).alias("doc"), digest(F.col(text)).alias("digest"), F.col(text).alias("t"))

    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(rows))

    def build():
        common = shared.value

        def step(texts: list) -> list:
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            sets = [shingle_hashes(t) for t in texts]
            return [pa.array(fps), list(map(len, sets)), [prefix(h, similarity, common).view(np.int64) for h in sets], list(map(parities, sets)), [parities(h, WIDE) if len(h) >= LARGE else None for h in sets]]

        return step

    found = map_texts(rows.select(F.struct("doc", "digest").alias("own"), "t"), build, "fp long, size int, prefix array<long>, sketch array<long>, wide array<long>", "own", "t")
    marked = written(found.select("own.doc", "own.digest", "fp", "size", "prefix", "sketch", "wide"), "marked")
    again = written(marked.groupBy("doc", "digest").count().filter("count > 1").select(F.col("doc").alias("doc2"), F.col("digest").alias("digest2")), "again")
    repeats = not again.isEmpty()
    # equal texts have equal marks, so any of them will do
    each = marked.groupBy("digest").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"), F.max("fp").alias("fp"))
    nodes = written(each.withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = marked.select("doc", F.col("digest").alias("d"), "size", "prefix", "sketch", "wide")
    prefixes = nodes.join(own, (F.col("digest") == F.col("d")) & F.col("least").eqNullSafe(F.col("doc"))).select("node", "size", "prefix", "sketch", "wide")
    prefixes = written(prefixes.dropDuplicates(["node"]) if repeats else prefixes, "prefixes")

    trim(docs.sparkSession)
    star = stars(links(nodes.select("fp").distinct()))
    rooted = nodes.select("node", "fp").join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    heads = written(rooted.groupBy("root").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "heads")
    by_fingerprint = rooted.join(heads, "root").filter("node <> b").select(F.col("node").alias("a"), "b")
    joined = joined_similar(rows, nodes, prefixes, by_fingerprint, similarity, repeats=repeats)

    placed = nodes.select("node", "digest", "least", "n").join(joined.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = written(placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "digest")).alias("kept")), "first")
    stays = F.col("digest") == F.col("kept.digest")
    grouped = placed.join(first, "root").filter((F.col("n") > 1) | ~stays).select("digest", stays.alias("stays"), F.col("kept.least").alias("kept"))
    copies = marked.select("doc", "digest").join(grouped, "digest").filter(~F.col("stays") | ~F.col("doc").eqNullSafe(F.col("kept")))
    copies = written(copies.select(F.col("doc").alias("doc2"), F.col("digest").alias("digest2")).distinct(), "copies")
    discard(marked, nodes, prefixes, star, heads, joined, first)
    trim(docs.sparkSession)

    same = F.col(f"own.{key}").eqNullSafe(F.col("doc2")) & (F.col("digest") == F.col("digest2"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), digest(F.col(text)).alias("digest"))
    out = whole
    for part in broadcasts(copies, "doc2") or [copies]:
        out = out.join(part, same, "left_anti")
    if repeats:
        once = out.join(again, same, "left_semi").groupBy(F.col(f"own.{key}").alias("k"), "digest").agg(F.min_by("own", F.to_json("own")).alias("own"))
        out = out.join(again, same, "left_anti").select("own").unionByName(once.select("own"))
    return out.select("own.*")
