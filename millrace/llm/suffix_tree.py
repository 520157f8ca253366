"""Language-model scoring by a probabilistic suffix tree over words, grown level by level on the executors.

A state of the tree is a context of one to `depth` words. Every context that occurs `context` times is a candidate,
whatever its share of the corpus, and it stays if the next words differ enough from those after its longest suffix
that stays: the gain in log-likelihood must exceed the cost of its parameters (a minimum description length
test). A state spells out the next words that follow it `fewest` times, smoothed towards that suffix, and leaves the
rest of its mass to the suffix. A token is scored in the longest state that ends the words before it.

A context of k + 1 words occurs as often as its first k words are followed by the last, so the counts of one level
give the candidates of the next, as in frequent-itemset mining. The test is a sum over next words, so it is an
aggregate with partial sums; nothing is gathered per context. Floors are absolute: the tree grows with the corpus.

Texts are split once, into numbers of frequent words and hashes of the others, and kept in shared storage. Words
and contexts are known by 63-bit hashes: two of n words or contexts share one with a probability of about
n^2 / 2^64, and would then be counted as one. What reaches the driver and the workers is bounded: the words
with numbers (no more than WORDS), and the tree, a level's candidates and
the counts of other words in blocks, each of which is met with all texts. Should the other words need more than
MOST_BLOCKS blocks, they meet the texts in a join instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Sorted, packed, slices, tune, unpacked, written

DEPTH = 3
CONTEXT, FEWEST = 64, 8  # occurrences of a context, and of a word after it, from which they are looked at
PULL = 5.0  # tokens by which a state's own counts are smoothed towards its suffix
WORDS = 1_000_000  # the most frequent words, so many at most, have numbers. Only speed depends on it
ENTRIES = 2_000_000  # candidates, or states and words after them, that are sent to the workers at once
RARE, MOST_BLOCKS = 6_000_000, 32  # counts of words without a number that are sent at once, and in how many blocks at most
MEMO = 400_000  # words that a task knows the numbers of
QUOTA = 2_000_000  # tokens whose pairs of context and word are counted in one task
END = b" "  # stands for a text's end; no word has white space
FLUSH = 400_000  # different words that a task holds before it passes their counts on
HELD = 2_000_000  # pairs of context and word that a task holds before it counts them
_TOP = 1 << 63
_ROLL = 7


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hash(word: bytes) -> int:
    """XXH64 with the highest bit set, which tells it from a frequent word's number."""
    return xxhash.xxh64_intdigest(word, 42) | _TOP


END_HASH = word_hash(END) - (1 << 64)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): the hash of each word and how often it occurs in all texts, ends included, counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(word_hash, held), dtype=np.uint64, count=len(held)).view(np.int64)), pa.array(list(held.values()), pa.int64())], ["h", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    held.update(words_of(t))
                    held[END] += 1
                if len(held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    return docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """The frequent words' counts and hashes by falling count, their places by hash, and the sizes of the corpus."""

    counts: np.ndarray
    hashes: np.ndarray
    by_hash: Sorted
    numbers: np.ndarray  # of the hashes in order
    tokens: int
    distinct: int
    least: int  # every word that occurs so often has a number

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each frequent word, and for any other its hash."""
        out = hashes.copy()
        k, at = self.by_hash.find(hashes)
        out[k] = self.numbers[at].astype(np.uint64)
        return out

    def root(self, counts: np.ndarray) -> np.ndarray:
        """The probabilities of words that occur so often."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def root_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(self.root(counts))


def encode(docs: DataFrame, shared, text: Column, own: dict[str, Column]) -> DataFrame:
    """(row, own, tokens, codes, rare): each text as numbers of frequent words (-1: another), with the hashes of the others, and its end.

    codes are 32-bit, in three planes of bytes, which pack better; row is a number of its own.
    """
    source = docs.select(F.struct(*[c.alias(n) for n, c in own.items()]).alias("own"), text.cast("string").alias("t"))
    kind = source.schema["own"].dataType.simpleString()

    def binary(data: bytes, sizes: np.ndarray) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        symbols: Symbols = shared.value
        memo: dict[bytes, int] = {}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1):
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                for flat in texts:
                    flat.append(END)
                if len(memo) > MEMO:
                    memo.clear()
                new = [w for w in set(chain.from_iterable(texts)) if w not in memo]
                memo.update(zip(new, symbols.codes(np.fromiter(map(word_hash, new), dtype=np.uint64, count=len(new))).tolist(), strict=True))
                codes, rare, sizes, others = [], [], [], []
                for flat in texts:
                    c = np.fromiter(map(memo.__getitem__, flat), dtype=np.uint64, count=len(flat))
                    missed = c[c >= np.uint64(_TOP)]
                    small = np.where(c >= np.uint64(_TOP), np.uint64(0xFFFFFF), c).astype(np.uint32)
                    codes.append(np.ascontiguousarray(small.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes())
                    rare.append(missed.tobytes())
                    sizes.append(len(flat))
                    others.append(len(missed))
                sizes, n = np.array(sizes, dtype=np.int64), part.num_rows
                columns = [pa.array(np.arange(row, row + n)), part.column(0), pa.array(sizes), binary(b"".join(codes), 3 * sizes), binary(b"".join(rare), 8 * np.array(others, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "own", "tokens", "codes", "rare"])
                row += n

    return source.mapInArrow(run, f"row long, own {kind}, tokens long, codes binary, rare binary")


@dataclass
class Stretch:
    """The tokens of some texts one after another: frequent words' numbers, all words' hashes, places in their texts."""

    codes: np.ndarray
    hashes: np.ndarray
    place: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, codes: list[bytes], rare: list[bytes], symbols: Symbols) -> Stretch:
        sizes = np.array([len(c) // 3 for c in codes], dtype=np.int64)
        flat = np.empty((int(sizes.sum()), 4), dtype=np.uint8)
        at = 0
        for c, n in zip(codes, sizes.tolist(), strict=True):
            flat[at : at + n, :3] = np.frombuffer(c, dtype=np.uint8).reshape(3, n).T
            at += n
        flat[:, 3] = np.where(flat[:, 2] == 255, 255, 0)  # numbers stay below 0xff0000, as there are no more than WORDS
        numbers = flat.reshape(-1).view(np.int32).astype(np.int64)
        hashes = symbols.hashes[np.maximum(numbers, 0)] if len(symbols.hashes) else np.zeros(len(numbers), np.uint64)
        hashes[numbers < 0] = np.frombuffer(b"".join(rare), dtype=np.uint64)
        starts = np.cumsum(sizes) - sizes
        return cls(numbers, hashes, np.arange(len(numbers)) - np.repeat(starts, sizes), starts)

    def contexts(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one word before each token, two, and so on: whether there are so many, and the hash of these."""
        h = np.zeros(len(self.hashes), dtype=np.uint64)
        for k in range(1, depth + 1):
            before = np.zeros_like(h)
            before[k:] = self.hashes[:-k]
            h = h ^ rolled(before, _ROLL * (k - 1))
            yield self.place >= k, h


def rolled(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return x << np.uint64(by) | x >> np.uint64(64 - by) if by else x


def _rolled(c: Column) -> Column:
    return F.shiftleft(c, _ROLL).bitwiseOR(F.shiftrightunsigned(c, 64 - _ROLL))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: every bit of the result depends on every bit of x."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _summed(ctx: np.ndarray, sym: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order, with their counts."""
    order = np.lexsort((sym, ctx))
    ctx, sym = ctx[order], sym[order]
    fresh = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (sym[1:] != sym[:-1]))))
    total = np.diff(np.append(fresh, len(ctx))) if n is None else np.add.reduceat(n[order], fresh)
    return ctx[fresh], sym[fresh], total.astype(np.int64)


@dataclass
class Candidates:
    """Contexts by hash, with their counts, the hashes of all but their first words, and those of their last words."""

    ctx: Sorted
    total: np.ndarray
    tail: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Candidates:
        ctx = rows["ctx"].to_numpy().view(np.uint64)
        order = np.argsort(ctx)
        return cls(Sorted(ctx[order]), *(rows[c].to_numpy()[order] for c in ("total", "tail", "last")))


PAIRS = "ctx long, tail long, last long, total long, sym long, n long, above double"


def _pairs(encoded: DataFrame, shared, level: int, known, context: int, fewest: int) -> DataFrame:
    """(ctx, tail, last, total, sym, n, above): which words follow each context of `level` words, and how often, from `fewest` times on.

    known: the Candidates; None at the first level, where each word is one that has occurred `context` times or may
    have. There, total is 0 where the context has no number, and above (the root's probability) is null where the word
    has none. Tasks count pairs and deal them out by context, a frequent context's by its words as
    well, into parts of about QUOTA tokens.
    """
    symbols: Symbols = shared.value
    session = encoded.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 1 + symbols.tokens // QUOTA)
    rare_too = context < symbols.least
    quota = QUOTA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: Symbols = shared.value
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ctx, sym, spread = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((sym, ctx))
            ctx, sym, spread = ctx[order], sym[order], spread[order]
            fresh = np.flatnonzero(np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (sym[1:] != sym[:-1]))))
            n = np.diff(np.append(fresh, len(ctx)))
            ctx, sym, spread = ctx[fresh], sym[fresh], spread[fresh]
            part = ((mixed(ctx) + mixed(sym) % spread) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[own[0]])], pa.int32()), pa.array([packed(ctx[own], sym[own], n[own])], pa.binary())], ["part", "blob"])

        for batch in batches:
            for piece in slices(batch, 0):
                s = Stretch.of(piece.column(0).to_pylist(), piece.column(1).to_pylist(), symbols)
                for fits, ctx in s.contexts(level):
                    pass
                if known is None:
                    before = np.concatenate(([-1], s.codes[:-1]))
                    total = np.where(before >= 0, symbols.counts[np.maximum(before, 0)], 0) if len(symbols.counts) else np.zeros(len(before), np.int64)
                    fits = fits & ((total >= context) | (rare_too & (before < 0)))
                else:
                    total = np.zeros(len(ctx), np.int64)
                    k, at = known.value.ctx.find(ctx)
                    total[k] = known.value.total[at]
                    fits = fits & (total > 0)
                sym = np.where(s.codes >= 0, s.codes.astype(np.uint64), s.hashes)
                if fits.any():
                    held.append((ctx[fits], sym[fits], (1 + total[fits] // quota).astype(np.uint64)))
                    size += len(held[-1][0])
                    if size > HELD:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: Symbols = shared.value
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blobs.setdefault(part, []).append(blob)
        while blobs:
            ctx, sym, n = (np.concatenate(x) for x in zip(*(unpacked(b, 3) for b in blobs.popitem()[1]), strict=True))
            ctx, sym, n = _summed(ctx, sym, n.view(np.int64))
            enough = n >= fewest
            ctx, sym, n = ctx[enough], sym[enough], n[enough]
            numbered = sym < np.uint64(_TOP)
            number = sym[numbered].astype(np.int64)
            tail, last, total, above = np.zeros(len(ctx), np.int64), ctx.view(np.int64), np.zeros(len(ctx), np.int64), np.zeros(len(ctx))
            if known is None:
                k, at = symbols.by_hash.find(ctx)
                total[k] = symbols.counts[symbols.numbers[at]]
                above[numbered] = symbols.root(symbols.counts[number])
            else:
                k, at = known.value.ctx.find(ctx)  # all there are
                tail, last, total = known.value.tail[at], known.value.last[at], known.value.total[at]
            sym[numbered] = symbols.hashes[number]
            columns = [ctx.view(np.int64), tail, last, total, sym.view(np.int64), n]
            for lo in range(0, len(ctx), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[cut]) for x in columns), pa.array(above[cut], mask=above[cut] == 0)], [x.split()[0] for x in PAIRS.split(", ")])

    dealt = encoded.select("codes", "rare").mapInArrow(run, "part int, blob binary").repartition(parts, "part")
    return dealt.mapInArrow(merge, PAIRS)


@dataclass
class Tree:
    """states (depth, ctx, last, left): log10 of the weight that each leaves to its suffix. spelt (depth, ctx, last, sym, log): log10 of the
    words that it spells out. last: the hash of the context's last word. vocabulary (h, n): all words."""

    symbols: object
    vocabulary: DataFrame
    states: DataFrame
    spelt: DataFrame
    depth: int


def _symbols(vocabulary: DataFrame):
    tokens, distinct = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first())
    # how many words there are of each magnitude, four to an octave: a few hundred rows
    sizes = vocabulary.groupBy(F.floor(4 * F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("k")).collect()
    held, least = 0, 1 << 62
    for r in sizes:
        held += r["words"]
        if held > WORDS:
            break
        least = r["least"]
    often = vocabulary.filter(F.col("n") >= least).toArrow()  # no more than WORDS rows
    counts, hashes = often["n"].to_numpy(), often["h"].to_numpy().view(np.uint64)
    order = np.lexsort((hashes, -counts))
    counts, hashes = counts[order], hashes[order]
    numbers = np.argsort(hashes)
    return vocabulary.sparkSession.sparkContext.broadcast(Symbols(counts, hashes, Sorted(hashes[numbers]), numbers.astype(np.int32), tokens, distinct, least))


def _blocks(rows: int) -> int:
    return max(1, -(-rows // ENTRIES))


def _counted(encoded: DataFrame, shared, level: int, candidates: DataFrame, context: int, fewest: int) -> DataFrame:
    """The pairs of all candidates of a level, which are sent to the workers in blocks."""
    if level == 1:
        return written(_pairs(encoded, shared, 1, None, context, fewest), "pairs")
    out = []
    blocks = _blocks(candidates.count())
    for k in range(blocks):
        found = candidates.filter(F.pmod(F.xxhash64("ctx"), F.lit(blocks)) == k).select("ctx", "total", "tail", "last").toArrow()
        known = encoded.sparkSession.sparkContext.broadcast(Candidates.of(found))
        out.append(written(_pairs(encoded, shared, level, known, context, fewest), "pairs"))
    whole = out[0]
    for t in out[1:]:
        whole = whole.unionByName(t)
    return whole


def _grow(encoded: DataFrame, shared, vocabulary: DataFrame, depth: int, context: int, fewest: int) -> Tree:
    symbols: Symbols = shared.value
    session = vocabulary.sparkSession
    states = session.createDataFrame([], "depth int, ctx long, last long, left double")
    spelt = session.createDataFrame([], "depth int, ctx long, last long, sym long, log double")
    candidates = before = None
    for level in range(1, depth + 1):
        if level > 1 and candidates.isEmpty():
            break
        pairs = _counted(encoded, shared, level, candidates, context, fewest)
        if level == 1:  # what is not known of words without a number
            unsure = F.col("above").isNull() | (F.col("total") == 0)
            own, after = (vocabulary.filter(F.col("n") >= least).select(F.col("h").alias(c), F.col("n").alias(f"{c}_n")) for c, least in (("ctx", context), ("sym", fewest)))
            rest = pairs.filter(unsure).drop("total", "above").join(own, "ctx").join(after, "sym")
            root = (F.col("sym_n") + 0.5) / (symbols.tokens + 0.5 * (symbols.distinct + 1))
            pairs = pairs.filter(~unsure).unionByName(rest.withColumn("total", F.col("ctx_n")).withColumn("above", root).drop("ctx_n", "sym_n"))
        else:
            pairs = pairs.drop("above").join(before, ["tail", "sym"])
        rows = written(pairs.withColumn("p", (F.col("n") + PULL * F.col("above")) / (F.col("total") + PULL)), f"level-{level}")
        each = rows.groupBy("ctx").agg(
            F.max("last").alias("last"), F.max("total").alias("total"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), (1 - F.sum("p")).alias("rest"), (1 - F.sum("above")).alias("wide"),
            F.sum(F.col("n") * F.ln(F.col("p") / F.col("above"))).alias("gain"),
        )
        gain = F.col("gain") + (F.col("total") - F.col("n")) * F.ln(F.col("rest") / F.col("wide"))
        cost = (F.col("m") + 1) * float(0.5 * np.log(max(2, symbols.tokens)))
        kept = each.filter((F.col("rest") > 1e-9) & (F.col("wide") > 1e-9)).filter(gain > cost)
        # rounded, as the last bits of a sum depend on its order
        kept = written(kept.select(F.lit(level).alias("depth"), "ctx", "last", F.round(F.log10(F.col("rest") / F.col("wide")), 12).alias("left")), f"states-{level}")
        states = states.unionByName(kept)
        # a state's own probabilities, and those of its suffix where it is none: what the contexts with these tails are held against
        judged = rows.select("ctx", "last", "sym", "p", "above").join(kept.select("ctx", F.lit(True).alias("kept")), "ctx", "left")
        judged = written(judged.select("ctx", "last", "sym", F.col("kept").isNotNull().alias("kept"), F.coalesce(F.when(F.col("kept"), F.col("p")), F.col("above")).alias("above")), f"judged-{level}")
        spelt = spelt.unionByName(judged.filter("kept").select(F.lit(level).alias("depth"), "ctx", "last", "sym", F.log10("above").alias("log")))
        before = judged.select(F.col("ctx").alias("tail"), "sym", "above")
        wider = lambda c: F.col("sym").bitwiseXOR(_rolled(F.col(c)))
        following = rows.filter((F.col("n") >= context) & (F.col("sym") != F.lit(END_HASH).cast("long")))
        candidates = following.select(wider("ctx").alias("ctx"), wider("tail").alias("tail"), F.col("sym").alias("last"), F.col("n").alias("total"))
    return Tree(shared, vocabulary, states, spelt, depth)


def fit(docs: DataFrame, text: str = "text", depth: int = DEPTH, context: int = CONTEXT, fewest: int = FEWEST) -> Tree:
    """The tree learnt from all texts of docs."""
    tune(docs.sparkSession)
    vocabulary = written(word_counts(docs, text), "words")
    shared = _symbols(vocabulary)
    return _grow(written(encode(docs, shared, F.col(text), {"learn": F.lit(True)}), "codes"), shared, vocabulary, depth, context, fewest)


class Block:
    """The states whose last words fall into one block, as sorted arrays."""

    def __init__(self, states: pa.Table, spelt: pa.Table, symbols: Symbols) -> None:
        column = lambda t, c: t[c].to_numpy().view(np.uint64)
        keys = _state_keys(states["depth"].to_numpy(), column(states, "ctx"))
        order = np.argsort(keys)
        self.states, self.left = Sorted(keys[order]), states["left"].to_numpy()[order]
        keys = _word_keys(_state_keys(spelt["depth"].to_numpy(), column(spelt, "ctx")), column(spelt, "sym"))
        order = np.argsort(keys)
        self.words, self.logs = Sorted(keys[order]), spelt["log"].to_numpy()[order]
        self.root = symbols.root_log10(symbols.counts)

    def log10(self, s: Stretch, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token after the words before it, for one that is not frequent without its part in the root; and whether the root has a part."""
        out, open_ = np.zeros(len(s.codes)), np.ones(len(s.codes), bool)
        for level, (fits, ctx) in reversed(list(enumerate(s.contexts(depth), 1))):
            places = np.flatnonzero(fits & open_)
            state = _state_keys(level, ctx[places])
            known, at = self.states.find(state)
            places, state = places[known], state[known]
            spelt, k = self.words.find(_word_keys(state, s.hashes[places]))
            more = self.left[at]
            more[spelt] = self.logs[k]
            out[places] += more
            open_[places[spelt]] = False
        rest = open_ & (s.codes >= 0)
        out[rest] += self.root[s.codes[rest]]
        return out, open_


def _state_keys(depth: np.ndarray | int, ctx: np.ndarray) -> np.ndarray:
    return mixed(ctx ^ np.asarray(depth, dtype=np.uint64) << np.uint64(55))


def _word_keys(state: np.ndarray, sym: np.ndarray) -> np.ndarray:
    return mixed(state ^ rolled(sym, 29))


def _dealt(last: np.ndarray, blocks: int) -> np.ndarray:
    return (last >> np.uint64(20)) % np.uint64(blocks)


def _score(encoded: DataFrame, tree: Tree, key: str, kept: list[str]) -> DataFrame:
    session, shared = encoded.sparkSession, tree.symbols
    symbols: Symbols = shared.value
    depth, blocks = tree.depth, _blocks(tree.states.count() + tree.spelt.count())
    passes = []
    for number in range(blocks):
        mine = F.pmod(F.shiftrightunsigned("last", 20), F.lit(blocks)) == number
        block = session.sparkContext.broadcast(Block(tree.states.filter(mine).toArrow(), tree.spelt.filter(mine).toArrow(), symbols))

        def run(batches: Iterator[pa.RecordBatch], block=block, number=number) -> Iterator[pa.RecordBatch]:
            symbols, tree = shared.value, block.value
            for batch in batches:
                for part in slices(batch, 3):
                    s = Stretch.of(part.column(3).to_pylist(), part.column(4).to_pylist(), symbols)
                    logs, open_ = tree.log10(s, depth)
                    here = np.ones(len(logs), bool)
                    if blocks > 1:  # every token is scored in the block of the word before it; first ones in the first
                        before = np.concatenate(([np.uint64(0)], s.hashes[:-1]))
                        here = np.where(s.place > 0, _dealt(before, blocks), 0) == number
                    frequent = s.codes >= 0
                    root = np.where(frequent, tree.root[np.maximum(s.codes, 0)] if len(tree.root) else 0.0, 0.0)
                    rare = np.flatnonzero(~frequent & here)
                    ends = np.searchsorted(rare, np.append(s.starts[1:], len(logs)))
                    lists = pa.array(np.concatenate(([0], ends)), pa.int32())
                    sums = [np.add.reduceat(np.where(here, x, 0), s.starts) for x in (frequent.astype(np.int64), root, logs)]
                    words = [pa.array(s.hashes[rare].view(np.int64)), pa.array(open_[rare])]
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, sums), *(pa.ListArray.from_arrays(lists, x) for x in words)], ["row", "own", "tokens", "known", "base", "log", "h", "open"])

        kind = encoded.schema["own"].dataType.simpleString()
        passes.append(encoded.select("row", "own", "tokens", "codes", "rare").mapInArrow(run, f"row long, own {kind}, tokens long, known long, base double, log double, h array<long>, open array<boolean>"))
    rare = tree.vocabulary.filter(F.col("n") < symbols.least)
    parts = -(-(symbols.distinct - len(symbols.counts)) // RARE)
    if blocks == 1 and parts <= 1:  # nothing has to be put together
        whole = _looked_up(passes[0], rare.toArrow(), symbols)
    else:
        scored = [written(p, "scored") for p in passes]
        sums = [t.select("row", "known", "base", "log") for t in scored]
        for t in scored:
            if parts <= MOST_BLOCKS:
                for k in range(parts):
                    some = rare.filter(F.pmod(F.shiftrightunsigned("h", 20), F.lit(parts)) == k).toArrow()
                    only = F.filter(F.arrays_zip("h", "open"), lambda x: F.pmod(F.shiftrightunsigned(x["h"], 20), F.lit(parts)) == k)
                    here = t.select("row", "own", "tokens", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("log"), only.alias("x"))
                    sums.append(_looked_up(here.select("row", "own", "tokens", "known", "base", "log", "x.h", "x.open"), some, symbols).select("row", "known", "base", "log"))
            else:
                sums.append(_joined(t, rare, symbols))
        whole = sums[0]
        for x in sums[1:]:
            whole = whole.unionByName(x)
        whole = whole.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "log")])
        whole = encoded.select("row", "own", "tokens").join(whole, "row")
    return whole.select(
        F.col("own.key").alias(key), *[F.col(f"own.{n}").alias(n) for n in kept], F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(symbols.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("log").alias("score"),
    )


def _looked_up(rows: DataFrame, words: pa.Table, symbols: Symbols) -> DataFrame:
    """(row, own, tokens, known, base, log) with the shares of the words in the lists: h, and open where the root has a part in the score."""
    h = words["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    shared = rows.sparkSession.sparkContext.broadcast((Sorted(h[order]), symbols.root_log10(words["n"].to_numpy()[order])))
    never = float(symbols.root_log10(np.zeros(1))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs = shared.value
        for batch in batches:
            for part in [batch.slice(k, 512) for k in range(0, batch.num_rows, 512)]:
                lists, open_ = part.column(6), part.column(7).flatten().to_numpy(zero_copy_only=False)
                wanted = lists.flatten().to_numpy().view(np.uint64)
                found, at = table.find(wanted)
                value, there = np.full(len(wanted), never), np.zeros(len(wanted), np.int64)
                value[found], there[found] = logs[at], 1
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                sums = [np.bincount(row, weights=x, minlength=part.num_rows) for x in (there, value, np.where(open_, value, 0.0))]
                known = part.column(3).to_numpy() + sums[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(known), pa.array(part.column(4).to_numpy() + sums[1]), pa.array(part.column(5).to_numpy() + sums[2])], ["row", "own", "tokens", "known", "base", "log"])

    kind = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, own {kind}, tokens long, known long, base double, log double")


def _joined(scored: DataFrame, rare: DataFrame, symbols: Symbols) -> DataFrame:
    """(row, known, base, log) of the words in the lists by a join; Spark splits the share of a word that is frequent in these texts alone."""
    each = scored.select("row", F.explode(F.arrays_zip("h", "open")).alias("x")).select("row", "x.*")
    each = each.groupBy("row", "h").agg(F.count(F.lit(1)).alias("times"), F.sum(F.col("open").cast("int")).alias("open"))
    log10 = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / (symbols.tokens + 0.5 * (symbols.distinct + 1)))
    return each.join(rare, "h", "left").select("row", F.when(F.col("n") > 0, F.col("times")).otherwise(0).cast("long").alias("known"), (F.col("times") * log10).alias("base"), (F.col("open") * log10).alias("log"))


def score(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", kept: dict[str, Column] | None = None) -> DataFrame:
    """(key, *kept, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are the text's words, A-Z in lower case, and one end. base_score is the root's, score the tree's log10
    probability of the text. A null or empty text is its end alone. Null keys and repeated rows are kept, an
    empty table gives an empty one. kept: further columns to carry along.
    """
    tune(docs.sparkSession)
    kept = kept or {}
    return _score(written(encode(docs, tree.symbols, F.col(text), {"key": F.col(key), **kept}), "codes"), tree, key, list(kept))


def fit_and_score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", kept: dict[str, Column] | None = None, depth: int = DEPTH, context: int = CONTEXT, fewest: int = FEWEST) -> DataFrame:
    """`score` of all docs by the tree that is learnt from those where learn holds; every text is split into words twice, not once a level."""
    tune(docs.sparkSession)
    kept = kept or {}
    learn = F.coalesce(learn, F.lit(False))
    vocabulary = written(word_counts(docs.filter(learn), text), "words")
    shared = _symbols(vocabulary)
    encoded = written(encode(docs, shared, F.col(text), {"key": F.col(key), **kept, "__learn": learn}), "codes")
    tree = _grow(encoded.filter(F.col("own").getField("__learn")), shared, vocabulary, depth, context, fewest)
    return _score(encoded, tree, key, list(kept))
