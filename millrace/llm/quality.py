"""Quality classification from trusted positives and unlabelled text (non-negative PU learning).

A small network over statistics of a text and a bag of its words, hashed into BAG places, is trained to minimise the
non-negative unbiased risk
    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])
with the logistic loss l. The class prior is estimated from the data: the least ratio, over thresholds of a
first scorer, of the shares of unlabelled and of positive rows above the threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample, map_texts, tune

_UPPER, _LOWER, _DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_STOPS, _SPACES = b".,;:!?'\"()-", b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_SYMBOLS = bytes(sorted(set(range(33, 127)) - set(_UPPER + _LOWER + _DIGIT + _STOPS)))
STATS, BAG = 19, 256
FEATURES = STATS + BAG
MEMO = 200_000  # words whose places a worker remembers
_PLACES: dict[bytes, int] = {}


def bag(words: list[bytes]) -> np.ndarray:
    """The square roots of the shares of the words, in lower case, that each place has; they are one vector of length 1."""
    if len(_PLACES) > MEMO:
        _PLACES.clear()
    get = _PLACES.get
    at = list(map(get, words))
    if None in at:
        for w in set(words):
            if w not in _PLACES:
                _PLACES[w] = zlib.crc32(w.lower()) % BAG
        at = list(map(_PLACES.__getitem__, words))
    return np.sqrt(np.bincount(at, minlength=BAG) / len(words))


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text, then the bag of its words; all zero where it has no word."""
    raw = (text or "").encode()
    words = raw.split()
    n, k = len(raw), len(words)
    if not k:
        return np.zeros(FEATURES)
    upper, lower, digit, stops, symbols, high = (n - len(raw.translate(None, x)) for x in (_UPPER, _LOWER, _DIGIT, _STOPS, _SYMBOLS, _HIGH))
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    again = sum(map(eq, words, islice(words, 1, None)))
    again2 = sum(map(eq, words, islice(words, 2, None)))
    again3 = sum(map(eq, words, islice(words, 3, None)))
    letters = max(1, upper + lower + high)
    stats = [
        np.log1p(n), np.log1p(k), n / k, distinct / k, distinct / k**0.7, again / k, again2 / k, again3 / k,
        len(zlib.compress(raw, 1)) / (n + 20), upper / letters, digit / n, stops / n, symbols / n, high / n,
        raw.count(b"|") / k, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), (lower + high) / n,
        symbols / k,
    ]
    return np.concatenate([stats, bag(words)])


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return self.hidden(z) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rounded, as the last bits of a matrix product depend on a row's place in its batch."""
        return np.round(1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))), 9)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_risk(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, float, list[np.ndarray]]:
    """The non-negative risk of weights w on positives p and unlabelled rows u, its negative part, and the step's gradients.

    With prior None: the plain risk of positives against unlabelled rows. Where the negative part is below zero it is
    over-fitted; the gradients are then those that bring it back, as the method has it.
    """

    def forward(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ w[0] + w[1])
        return h, h @ w[2] + w[3][0]

    def backward(x: np.ndarray, h: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        dh = d[:, None] * w[2] * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()])]

    hp, gp = forward(p)
    hu, gu = forward(u)
    if prior is None:
        negative = np.logaddexp(0, gu).mean()
        value = np.logaddexp(0, -gp).mean() + negative
        dp, du = -_sigmoid(-gp) / len(p), _sigmoid(gu) / len(u)
    else:
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        value = prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)
        back_p, back_u = -prior * _sigmoid(gp) / len(p), _sigmoid(gu) / len(u)
        if negative >= 0:
            dp, du = -prior * _sigmoid(-gp) / len(p) + back_p, back_u
        else:
            dp, du = -back_p, -back_u
    return float(value), float(negative), [a + b for a, b in zip(backward(p, hp, dp), backward(u, hu, du), strict=True)]


def train(pos: np.ndarray, unl: np.ndarray, prior: float | None, units: int = 24, steps: int = 800, rate: float = 0.02, decay: float = 1e-4, bag_decay: float = 3e-3) -> Network:
    """Full-batch Adam on the PU risk; with prior None on the plain risk. Statistics are standardised, a bag's weights decay faster."""
    rng = np.random.default_rng(9)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    scale[STATS:] = 0.2
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (pos, unl))
    w = [rng.normal(0, 0.3, (p.shape[1], units)), np.zeros(units), rng.normal(0, 0.3, units), np.zeros(1)]
    w[0][STATS:] = 0.0
    pull = [np.full(w[0].shape, decay), decay, decay, decay]
    pull[0][STATS:] = bag_decay
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        for k, g in enumerate(pu_risk(w, p, u, prior)[2]):
            g = g + pull[k] * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior or 0.5)


DOUBT = 10


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from two scorers that each judge the rows the other learnt from.

    Each gives the least, over thresholds, of the lower 95 % bound of the unlabelled share above the threshold
    to the positive share above it. A prior that is a little low costs no row; one that is high hides negatives.
    The estimate counts as much as the rows that it comes from, against DOUBT rows that speak for one half: with few
    rows the prior stays near that, with thousands they do not matter.
    """

    def least(p: np.ndarray, u: np.ndarray) -> float:
        grid = np.quantile(p, np.linspace(0.01, 0.5, 50))
        above_p, above_u = (np.array([(x >= t).mean() for t in grid]) for x in (p, u))
        return ((above_u - 1.65 * np.sqrt(above_u * (1 - above_u) / len(u))) / above_p).min()

    halves = [(pos[k::2], unl[k::2]) for k in (0, 1)]
    found = [least(s.margin(p), s.margin(u)) for (a, b), (p, u) in (halves, halves[::-1]) if min(map(len, (a, b, p, u))) for s in [train(a, b, None)]]
    n = min(len(pos), len(unl)) if found else 0
    return float(np.clip((n * float(np.mean(found or [0.5])) + DOUBT * 0.5) / (n + DOUBT), 0.05, 0.98))


def feature_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x array<double>): the statistics and the bag of every whole text; zeros where it is null, empty or blank."""
    return map_texts(docs, lambda: lambda texts: [[features(t).tolist() for t in texts]], "x array<double>", key, text)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = 4000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Train on at most about `sample` trusted positives and `sample` unlabelled rows, among keys where learn holds.

    Both are chosen by a hash of the key. A positive is a key that some row of labels marks 1. Negative labels
    are not used, nor any other column. Only these rows' features reach the driver. Without any positive, every
    text scores 0.5.
    """
    trusted = bounded_sample(labels.filter((F.col(label) == 1) & learn).select(F.col(key).alias("k")).distinct(), "k", sample, 90)
    unlabelled = bounded_sample(docs.filter(learn).select(F.col(key).alias("k")), "k", sample, 91).distinct()
    ids = trusted.withColumn("p", F.lit(1)).unionByName(unlabelled.withColumn("p", F.lit(0)))
    chosen = ids.groupBy("k").agg(F.max("p").alias("p"), F.min("p").alias("u"))  # no more than 4 * sample rows
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    stats = feature_rows(rows.select(F.struct("p", "u").alias("k"), "t"), "k", "t")
    found = stats.select("k.p", "k.u", "x").toArrow()
    x = np.array(found["x"].to_pylist(), dtype=np.float64).reshape(-1, FEATURES)
    x = x[order := np.lexsort(x.T)]
    pos, unl = x[np.array(found["p"].to_pylist(), dtype=int)[order] == 1], x[np.array(found["u"].to_pylist(), dtype=int)[order] == 0]
    if not len(pos) or not len(unl):
        zero = np.zeros(FEATURES)
        return Network(zero, zero + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0)
    rng = np.random.default_rng(9)
    pos, unl = pos[rng.permutation(len(pos))], unl[rng.permutation(len(unl))]
    return train(pos, unl, estimate_prior(pos, unl))


def score(docs: DataFrame, model: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): how likely every whole text is of good quality, from 0 to 1, from the text alone.

    Null, empty and blank texts all have the same statistics and so the same score. Null keys and repeated rows
    are kept, an empty table gives an empty one, and other columns are not read.
    """

    def build():
        return lambda texts: [pa.array(model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES)))]

    return map_texts(docs, build, "score double", key, text)


def accepted(docs: DataFrame, model: Network, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs whose texts score `threshold` or more. All columns stay; null and empty texts are judged like blank ones."""
    tune(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t if isinstance(t, str) else None) for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(model.score(x) >= threshold)

    return docs.filter(good(F.col(text)))
