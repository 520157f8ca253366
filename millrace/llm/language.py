"""Language identification by interpolated Kneser-Ney character models, one per language.

A word is read as its letters with a boundary on each side; contexts do not reach over the boundary. An n-gram is
known by a 64-bit hash of its characters, and each model keeps its n-grams and contexts in sorted hash arrays that
are searched by bisection. The language with the lowest cross-entropy per character wins. N-grams are counted on
the executors; their counts, not texts, reach the driver, for a block of languages at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, map_texts, slices, tune, written

ORDER = 5
PAD, EDGE = "\x00", "\x01"  # no letters
GRAMS = 4_000_000  # distinct n-grams of the languages that are sent to the workers at once, unless one alone has more
MEMO_BYTES, CHUNK_BYTES = 48 << 20, 16 << 20  # of a task's known words, and of the words it scores at once
MEMO = 250_000  # and words, however few the languages
CALIBRATION = 20_000_000  # cross-entropies that calibration brings to the driver at most
letters = regex.compile(r"\p{L}+").findall


def words_of(text: str | None) -> list[str]:
    return letters(text.lower()) if text else []


def grams_of(word: str) -> list[str]:
    """The ORDER-grams that end at each letter and at the closing edge of a word."""
    s = PAD * (ORDER - 2) + EDGE + word + EDGE
    return [s[k : k + ORDER] for k in range(len(word) + 1)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits for each character, all of which depend on it."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _turned(x: np.ndarray, back: int) -> np.ndarray:
    by = 11 * back % 64
    return x << np.uint64(by) | x >> np.uint64(64 - by) if by else x


def hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of characters: the hash of the whole row, and of all but its last character."""
    whole = np.zeros(len(points), dtype=np.uint64)
    for back in range(points.shape[1]):
        whole ^= _turned(mixed(points[:, points.shape[1] - 1 - back]), back)
    return whole, whole ^ mixed(points[:, -1])


def keys_of(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashes of 1- to ORDER-grams that end at each letter and closing edge, the last characters' own, and how many of these each word has."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    text = EDGE.join(words) + EDGE
    own = mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    inside = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # letters before this one in its word
    edge, pad = (mixed(np.array([ord(x)]))[0] for x in (EDGE, PAD))
    keys = [own]
    for back in range(1, ORDER):
        before = np.empty_like(own)
        before[back:] = own[:-back]
        before[inside < back] = pad
        before[inside == back - 1] = edge
        keys.append(keys[-1] ^ _turned(before, back))
    return keys, own, lengths


@dataclass
class Level:
    """One order of one model: n-grams with their counts, contexts with their totals and followers, by hash."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    followers: np.ndarray
    discount: float


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return k, keys[k] == wanted


class KneserNey:
    def __init__(self, grams: list[str], counts: np.ndarray, alphabet: int) -> None:
        """grams: distinct ORDER-grams, at least one; counts: how often each occurs; alphabet: how many characters there are."""
        self.alphabet, self.levels = alphabet, []
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, ORDER)
        counts = np.asarray(counts, dtype=np.float64)
        for m in range(ORDER, 0, -1):
            keys, before = hashes(points)
            if m < ORDER:  # a lower order counts the different characters before it
                keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
                points, before, counts = points[first], before[first], counts.astype(np.float64)
            else:
                order = np.argsort(keys)
                keys, points, before, counts = keys[order], points[order], before[order], counts[order]
            once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
            contexts, back, followers = np.unique(before, return_inverse=True, return_counts=True)
            totals = np.bincount(back, weights=counts)
            self.levels.append(Level(keys, counts, contexts, totals, followers.astype(np.float64), max(0.1, once / (once + 2 * twice)) if once else 0.1))
            points = points[:, 1:]
        self.levels.reverse()

    def log2(self, keys: list[np.ndarray], last: np.ndarray) -> np.ndarray:
        """log2 of the probability of each last character after the others, from the hashes of 1- to ORDER-grams and the character's own."""
        p = np.full(len(last), 1.0 / self.alphabet)
        for own, x in zip(keys, self.levels, strict=True):
            k, known = _at(x.keys, own)
            c = np.where(known, x.counts[k], 0.0)
            h, seen = _at(x.contexts, own ^ last)
            p = np.where(seen, (np.maximum(c - x.discount, 0) + x.discount * x.followers[h] * p) / x.totals[h], p)
        return np.log2(p)


@dataclass
class Block:
    """Some of the languages, in sorted order, with their models."""

    languages: list[str]
    models: list[KneserNey]

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log2 probability in each language, then its characters."""
        keys, last, lengths = keys_of(words)
        _, first, back = np.unique(keys[-1], return_index=True, return_inverse=True)
        each = np.stack([m.log2([k[first] for k in keys], last[first]) for m in self.models], axis=1)
        starts = np.cumsum(lengths) - lengths
        return np.concatenate([np.add.reduceat(each[back], starts), lengths[:, None]], axis=1)


def entropies(sums: np.ndarray) -> np.ndarray:
    return -sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def posterior(h: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-sharpness * (h - h.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def summer(block: Block):
    """A function from texts to a row each: the log2 probability in each language, and the characters (0 without letters).

    Words are scored CHUNK_BYTES at a time and remembered in MEMO_BYTES, whatever the texts and however many the languages.
    """
    width = 8 * (len(block.languages) + 1)
    step = max(16, CHUNK_BYTES // width)
    memo: dict[str, int] = {}
    table = np.zeros((max(step, min(MEMO, MEMO_BYTES // width)), len(block.languages) + 1))

    def rows(words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if len(memo) + len(new) > len(table):
            memo.clear()
            new = list(dict.fromkeys(words))
        if new:
            start = len(memo)
            table[start : start + len(new)] = block.score_words(new)
            memo.update(zip(new, range(start, start + len(new)), strict=True))
        return table[np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))]

    def sums(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), table.shape[1]))
        flat, owner = [], []
        for k, t in enumerate(texts):
            own = words_of(t)
            flat += own
            owner.append(len(own))
        ends = np.cumsum(owner)
        for lo in range(0, len(flat), step):
            hi = min(lo + step, len(flat))
            a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi - 1, side="right") + 1
            cuts = np.maximum(ends[a:b] - np.array(owner[a:b]), lo)
            some = np.flatnonzero(np.minimum(ends[a:b], hi) > cuts)
            out[a + some] += np.add.reduceat(rows(flat[lo:hi]), cuts[some] - lo)
        return out

    return sums


@dataclass
class Model:
    """Blocks of languages; per language the cross-entropy above which a text is rejected."""

    blocks: list  # broadcasts of Block
    limits: dict[str, float]
    sharpness: float


def _chosen(docs: DataFrame, learn: Column, per_language: int, key: str, text: str, lang: str) -> DataFrame:
    """(l, place, t): about per_language texts of each language, by a hash of the key, numbered from 1 on."""
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), learn.alias("w")).filter("w and k is not null and t is not null and l is not null")
    share = rows.groupBy("l").agg((F.lit(float(1 << 30)) * per_language / F.count(F.lit(1))).alias("share"))
    spread = F.pmod(F.xxhash64("k", F.lit(6)), F.lit(1 << 30))
    some = rows.join(written(share, "languages"), "l").filter(spread <= F.col("share"))
    return some.select("l", "t", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k", F.lit(7)), "k", "t")).alias("place")).filter(F.col("place") <= 2 * per_language)


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(l, gram, n): how often each ORDER-gram occurs in the texts of each language; the words are counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words: dict[str, Counter] = {}
                for l, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words.setdefault(l, Counter()).update(words_of(t))
                for l, own in words.items():
                    held: Counter = Counter()
                    for w, n in own.items():
                        for g in grams_of(w):
                            held[g] += n
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([l] * len(held)), pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["l", "gram", "n"])

    return rows.select("l", "t").mapInArrow(run, "l string, gram string, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, per_language: int = 1000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on about per_language whole texts (twice as many at most) of every language among the rows where learn holds.

    The rows are chosen by a hash of the key. Every fifth of a language is kept apart, to choose the sharpness of the
    posterior and the language's rejection limit (the 0.995 quantile of its texts' cross-entropy); a language with
    fewer than five has the limit of all texts that are kept apart, and where there is none nothing is rejected.
    There is no limit to languages or characters: models are made and sent in blocks of about GRAMS n-grams. Rows with
    a null key, text or language, and texts without letters, teach nothing.
    """
    spark = docs.sparkSession
    tune(spark)
    chosen = written(_chosen(docs, learn, per_language, key, text, lang).withColumn("apart", F.col("place") % 5 == 0), "sample")
    counts = written(_gram_counts(chosen.filter(~F.col("apart"))), "grams")
    sizes = [(r["l"], r["n"]) for r in counts.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()]
    if not sizes:
        raise ValueError("no text with letters to learn a language from")
    used = counts.select(F.explode(F.split("gram", "")).alias("c")).agg(F.count_distinct("c")).first()[0] + 1
    groups: list[list[str]] = [[]]
    held = 0
    for l, n in sizes:
        if groups[-1] and held + n > GRAMS:
            groups.append([])
            held = 0
        groups[-1].append(l)
        held += n
    blocks = []
    for own in groups:
        found = counts.filter(F.col("l").isin(own)).orderBy("l", "gram").toArrow()
        names, grams, n = found["l"].to_numpy(zero_copy_only=False), found["gram"].to_pylist(), found["n"].to_numpy()
        cuts = np.flatnonzero(np.append(names[1:] != names[:-1], True)) + 1
        models = [KneserNey(grams[a:b], n[a:b], used) for a, b in zip([0, *cuts], cuts, strict=False)]
        blocks.append(spark.sparkContext.broadcast(Block([str(names[b - 1]) for b in cuts], models)))
    languages = [l for own in groups for l in own]
    # cross-entropies in every language of the texts that were kept apart, of so many as stay within CALIBRATION
    most = max(1, min(2 * per_language // 5, CALIBRATION // len(languages) ** 2))
    apart = chosen.filter(F.col("apart") & (F.col("place") <= 5 * most) & F.col("l").isin(languages)).select(F.struct("l", "place").alias("k"), "t")
    parts = [map_texts(apart, lambda b=b: _lists(b.value), "h array<double>, n long", "k", "t").filter("n > 0").toPandas().sort_values("k", key=lambda c: c.map(tuple)) for b in blocks]
    limits = dict.fromkeys(languages, np.inf)
    sharpness = 1.0
    if len(parts[0]):
        h = np.concatenate([np.array(p["h"].tolist()) for p in parts], axis=1)
        place = {l: k for k, l in enumerate(languages)}
        truth = np.array([place[k["l"]] for k in parts[0]["k"]])
        mine = h[np.arange(len(h)), truth]
        losses = {sharp: -np.log(np.maximum(posterior(h, sharp)[np.arange(len(h)), truth], 1e-12)).mean() for sharp in (1, 2, 4, 8, 16, 32, 64)}
        sharpness = float(min(losses, key=losses.get))
        limits = {l: float(np.quantile(mine[truth == k] if (truth == k).any() else mine, 0.995)) for k, l in enumerate(languages)}
    discard(chosen, counts)
    return Model(blocks, limits, sharpness)


def _lists(block: Block):
    sums = summer(block)

    def step(texts: list) -> list:
        s = sums(texts)
        return [entropies(s).tolist(), pa.array(s[:, -1].astype(np.int64))]

    return step


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, entropy, rejected): the language of every whole text, from the text alone.

    A text that is null, empty or without letters gives `und`, score 0 and a null entropy, and is rejected.
    Otherwise lang_pred is the language of lowest cross-entropy in bits per character (on a tie the first by
    name), score its posterior among the languages, and rejected says that the entropy is above the
    language's calibrated limit. Null keys and repeated rows are kept; an empty table gives an empty one.
    With more than one block of languages, each is met with all texts, and a text's bests are put together.
    """
    sharpness, limits = model.sharpness, model.limits

    def build(shared):
        def make():
            block: Block = shared.value
            sums = summer(block)

            def step(texts: list) -> list:
                s = sums(texts)
                h = entropies(s)
                best = h.argmin(axis=1)
                lowest = h[np.arange(len(h)), best]
                wide = np.exp(-sharpness * (h - lowest[:, None])).sum(axis=1)
                some = s[:, -1] > 0
                top = np.array([limits[l] for l in block.languages])[best]
                return [[block.languages[b] for b in best], pa.array(lowest, mask=~some), pa.array(wide), pa.array(lowest > top)]

            return step

        return make

    outputs = "lang string, entropy double, wide double, over boolean"
    if len(model.blocks) == 1:
        found = map_texts(docs, build(model.blocks[0]), outputs, key, text)
        total = F.col("wide")
    else:
        rows = written(docs.select(F.col(key).alias("key"), F.col(text).alias("t")).withColumn("row", F.monotonically_increasing_id()), "numbered")
        found = None
        for shared in model.blocks:
            part = map_texts(rows.select(F.struct("row", "key").alias("own"), "t"), build(shared), outputs, "own", "t")
            part = part.select("own.row", "own.key", F.struct("entropy", "lang", "wide", "over").alias("x"))
            found = part if found is None else found.unionByName(part)
        found = written(found, "languages").groupBy("row").agg(F.first("key").alias(key), F.min("x").alias("best"), F.collect_list("x").alias("all"))  # as many as there are blocks
        total = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["wide"] * F.exp(-sharpness * (x["entropy"] - F.col("best.entropy"))))
        found = found.select(key, "best.lang", "best.entropy", total.alias("total"), "best.over")
        total = F.col("total")
    some = F.col("entropy").isNotNull()
    return found.select(
        key, F.when(some, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(some, 1 / total).otherwise(0.0).alias("score"), "entropy", (~some | F.col("over")).alias("rejected")
    )
