"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A copy of a test item with at most E edited words keeps all but n * E of the item's word n-grams at least, so
it holds one of any n * E + 1 of them. The seeds of an item are so many of its n-grams, those that the fewest
training documents have. Where a document holds a seed, the stretch around it is aligned with the item, and
the score is the alignment's share of what the whole item would reach.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import slices, tune

N = 3  # words of a seed
SIMILARITY = 0.8  # of its words, what a copy keeps at least: it may have 1 - SIMILARITY edits a word
THRESHOLD = 0.5  # of the score, from which a passage counts as a copy; an edit costs a match and a penalty, chance passages stay below 0.3
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
BLOCK = 32 << 20  # bytes of test items that are sent to the workers at once
_FIND = regex.compile(r"[\p{L}\p{N}]+").findall
_ODD = regex.compile(r"[^\p{L}\p{N}\x00-\x7f]").search
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Runs of letters and digits, in lower case, as UTF-8.

    Most texts have no other characters beyond ASCII, so blanking ASCII's other bytes and splitting does the same as the pattern.
    """
    text = text.lower()
    if text.isascii() or not _ODD(text):
        return text.encode().translate(_PLAIN).split()
    return [w.encode() for w in _FIND(text)]


@dataclass
class Items:
    """A block of test items as numbers of words, and the places of their n-grams."""

    ids: list
    tokens: list[np.ndarray]
    vocabulary: dict[bytes, int]
    grams: np.ndarray  # sorted distinct keys of n-grams
    places: list[list[tuple[int, int]]]  # of each: (item, position)
    width: int

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        ids, tokens, places = [], [], defaultdict(list)
        for key, text in rows:
            own = words(text or "")
            if own:
                ids.append(key)
                tokens.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in own], dtype=np.int64))
        out = cls(ids, tokens, vocabulary, np.empty(0, np.int64), [], max(1, len(vocabulary)))
        if out.width ** N >= 1 << 62:
            raise ValueError("too many different words in a block of test items")
        for item, t in enumerate(tokens):
            for at, key in enumerate(out.keys(t).tolist()):
                places[key].append((item, at))
        out.grams = np.array(sorted(places), dtype=np.int64)
        out.places = [places[k] for k in out.grams.tolist()]
        return out

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The n-grams of a text; -1 where a word is in no item. Texts of fewer than N words are one n-gram, with the last word repeated."""
        if 0 < len(tokens) < N:
            tokens = np.concatenate([tokens, np.repeat(tokens[-1:], N - len(tokens))])
        n = len(tokens) - N + 1
        if n <= 0:
            return np.empty(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(N):
            part = tokens[k : k + n]
            key = key * self.width + np.maximum(part, 0)
            known &= part >= 0
        return np.where(known, key, -1)

    def numbers(self, own: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, own, repeat(-1)), dtype=np.int64, count=len(own))

    def hits(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, n-gram's number) wherever the text has one of the items' n-grams."""
        keys = self.keys(tokens)
        at = np.flatnonzero(keys >= 0)
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.grams, keys[at]), len(self.grams) - 1)
        same = self.grams[k] == keys[at]
        return at[same], k[same]


def edits(length: int, similarity: float) -> int:
    return int((1 - similarity) * length + 1e-9)


def seeds(items: Items, frequency: np.ndarray, similarity: float) -> list[list[tuple[int, int]]]:
    """For each n-gram the items and positions that it is a seed of: the rarest ones of each item, ties by number."""
    of: list[set[int]] = [set() for _ in items.ids]
    for k, places in enumerate(items.places):
        for item, _ in places:
            of[item].add(k)
    out: list[list[tuple[int, int]]] = [[] for _ in items.places]
    for item, grams in enumerate(of):
        need = N * edits(len(items.tokens[item]), similarity) + 1
        # repeated n-grams count once here but may all be hit by other edits: all of an item's places of a seed are kept
        for k in sorted(grams, key=lambda k: (frequency[k], k))[:need]:
            out[k] += [p for p in items.places[k] if p[0] == item]
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """The best local alignment of two word sequences: its score as a share of the item's own, and where it lies in the text."""
    n = len(text)
    row, start = np.zeros(n + 1), np.arange(n + 1)
    ramp = -GAP * np.arange(n + 1)
    places = np.arange(n + 1)
    best, first, last = 0.0, 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        new, origin = np.zeros(n + 1), places.copy()
        take = np.maximum(diagonal, up)
        source = np.where(diagonal >= up, start[:-1], start[1:])
        live = take > 0
        new[1:][live] = take[live]
        origin[1:][live] = source[live]
        # gaps along the text: the best score before, less a penalty for each word skipped
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted >= top, places, 0))
        better = top - ramp > new
        new = np.where(better, top - ramp, new)
        origin = np.where(better, origin[at], origin)
        row, start = new, origin
        k = int(row.argmax())
        if row[k] > best:
            best, first, last = float(row[k]), int(start[k]), k
    return best / (MATCH * len(item)), first, last


def leaks(items: Items, seeded: list[list[tuple[int, int]]], tokens: np.ndarray, similarity: float, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word + 1) of each item that the text holds a copy of, at its best place."""
    at, grams = items.hits(tokens)
    near: dict[int, list[int]] = defaultdict(list)
    for p, k in zip(at.tolist(), grams.tolist(), strict=True):
        for item, q in seeded[k]:
            near[item].append(p - q)
    for item, offsets in sorted(near.items()):
        length = len(items.tokens[item])
        slack = edits(length, similarity) + 1
        best: tuple[float, int, int] | None = None
        windows: list[list[int]] = []
        for o in sorted(set(offsets)):
            lo, hi = max(0, o - slack), min(len(tokens), o + length + slack)
            if windows and lo <= windows[-1][1] and hi - windows[-1][0] <= 8 * length + 64:
                windows[-1][1] = max(hi, windows[-1][1])
            else:
                windows.append([lo, hi])
        for lo, hi in windows:
            part = tokens[lo:hi]
            # no alignment scores more than its matches, so most windows need none
            if np.isin(items.tokens[item], part).sum() < threshold * length:
                continue
            score, a, b = align(items.tokens[item], part)
            if best is None or score > best[0]:
                best = (score, lo + a, lo + b)
        if best and best[0] >= threshold:
            yield item, *best


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The test items, in blocks of about BLOCK bytes, however many there are."""
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-size // BLOCK)
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("t"), F.lit(count)) == k).collect() if count > 1 else rows.collect()
        yield sorted(((r["k"], r["t"]) for r in part), key=lambda r: (str(r[0]), r[1]))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item, score, first_word, last_word): the test items that each whole text holds copies of, at the best place.

    Words are runs of letters and digits, in lower case. A copy is a passage whose alignment has `threshold` of
    the item's score or more; those with no more than 1 - similarity edits for each of the item's words are
    surely found, others where they keep a seed. Items without words match nothing, null texts hold nothing, a
    document without copies has no row. Equal items are reported each; repeated documents each have rows; null
    keys are kept. Items come in blocks of bounded size, each of which is met with all documents.
    """
    spark = docs.sparkSession
    tune(spark)
    kind, item_kind = dict(docs.dtypes)[key], dict(benchmark.dtypes)[item]
    schema = f"`{key}` {kind}, item_id {item_kind}, score double, first_word int, last_word int"
    source = docs.select(key, text)
    out = None
    for shared, seeded in _prepared(docs, benchmark, text, item, item_text, similarity):
        found = source.mapInArrow(_finder(shared, seeded, similarity, threshold, key), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _prepared(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, similarity: float) -> Iterator[tuple]:
    """For each block of test items: the items and the seeds chosen by all documents' counts, as broadcasts of bounded size."""
    context = docs.sparkSession.sparkContext
    for rows in _blocks(benchmark, item, item_text):
        shared = context.broadcast(items := Items.of(rows))
        counted = docs.select(text).mapInArrow(_counter(shared), "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
        frequency = np.zeros(len(items.grams), dtype=np.int64)
        for r in counted.collect():  # a number for each n-gram of the block
            frequency[r["gram"]] = r["docs"]
        yield shared, context.broadcast(seeds(items, frequency, similarity))


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        total = np.zeros(len(items.grams), dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    _, k = items.hits(items.numbers(words(t.as_py())))
                    total[np.unique(k)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "docs"])

    return run


def _finder(shared, seeded, similarity: float, threshold: float, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                at, rows = [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    for row in leaks(items, seeded.value, items.numbers(words(t)), similarity, threshold) if t else ():
                        at.append(k)
                        rows.append((items.ids[row[0]], *row[1:]))
                if rows:
                    ids, score, first, last = zip(*rows, strict=True)
                    columns = [part.column(0).take(pa.array(at)), pa.array(ids), pa.array(score), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, [key, "item_id", "score", "first_word", "last_word"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that hold a copy of a test item, as `find` defines it.

    Each row is judged by its own text, whatever its key: rows with null keys go as well, and rows that share a key
    are judged apart. All columns and all other rows stay. Test items come in blocks, each of which is met with what
    the blocks before have left; nothing is joined.
    """
    tune(docs.sparkSession)
    out = docs
    for shared, seeded in _prepared(docs, benchmark, text, item, item_text, similarity):
        out = out.filter(~_holds(shared, seeded, similarity, threshold)(F.col(text)))
    return out


def _holds(shared, seeded, similarity: float, threshold: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items: Items = shared.value
        for texts in batches:
            yield pd.Series([bool(t) and isinstance(t, str) and any(True for _ in leaks(items, seeded.value, items.numbers(words(t)), similarity, threshold)) for t in texts], dtype=bool)

    return holds
