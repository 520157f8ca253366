"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are runs without white space. Each is tagged B (a secret begins), I (it goes on) or O from features of
its shape, of its neighbours and of the file, with the tags' transitions, by Viterbi decoding. The decoding is
exact but not run over every token: where O beats the other tags by more than any choice of neighbouring tags
can make up for, the best path goes through O, so the chain falls apart there.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample, map_texts, tune

#: The kinds of base secrets with their patterns, in the order in which spans that start together are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
B, I, O = range(3)
MEMO, LONGEST = 150_000, 1024  # tokens that a worker remembers, and the characters of the longest of these
PIECE = 1 << 20  # characters of a text that are tagged at once
LEAST = 6  # characters of a span that the field adds
Span = tuple[int, str, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and kind. Positions are code points, the end is exclusive."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs of hex digits are maximal, so those of 24 or more are the matches that are kept
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


_EDGE = "\"'`,;.!?()[]{}<>|%$#&*"
_INNER = re.compile(r"""^[\w"'.-]{0,40}?[=:]["'`]*(.+)$""")
_HEXED, _CODE, _NUMBER, _DOTTED = (re.compile(x).fullmatch for x in (r"[0-9a-fA-F]+", r"[A-Za-z0-9+/_=.-]+", r"[0-9().+:/-]+", r"\w+(\.\w+)+"))
_NAMES = re.compile("|".join(KEYWORDS)).search
_NAMED = {"key", "auth", "bearer", "credential", "credentials", "pwd"}
_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+")
OWN, NEAR = 22, 5  # features of a token, and those that its neighbours see
FILE = 3
LONG = 12  # characters from which a token without digits can be a key


def inner(token: str) -> tuple[int, int]:
    """Start and end, in the token, of what would be the secret: without a name before = or :, quotes and punctuation."""
    m = _INNER.match(token)
    start = m.start(1) if m else 0
    core = token[start:]
    return start + len(core) - len(core.lstrip(_EDGE)), max(start, len(token.rstrip(_EDGE)))


def shape(token: str) -> tuple[list[int], list[int]]:
    """Which of the OWN features the token has, and which of the NEAR ones."""
    a, b = inner(token)
    core, low = token[a:b], token.lower()
    n = len(core)
    digits, upper, lower = sum(map(str.isdigit, core)), core != core.lower(), core != core.upper()
    # runs and entropy of the whole token, but for short ones without digits, which are words
    varied = digits > 0 or n >= LONG
    mixed = sum(1 for _ in islice(_RUNS.finditer(core), 8)) if varied else 0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(core).values()) if varied else 0.0
    keyword = bool(_NAMES(low)) or low.strip(_EDGE + ":=") in _NAMED
    assigns = token.endswith(("=", ":"))
    tests = (
        True, 8 <= n < 16, 16 <= n < 24, 24 <= n < 48, n >= 48, digits > 0, upper and lower, digits > 0 and (upper or lower),
        n >= 12 and bool(_HEXED(core)) and digits < n, bool(_CODE(core)), bool(_NUMBER(core)), "@" in token, bool(_DOTTED(core)),
        mixed >= 4, mixed >= 8, bits >= 3.0, bits >= 3.6, bits >= 4.2, a > 0 and token[a - 1] in "\"'`", a > 0 and token[a - 1] in "=:" , keyword, "_" in core or "-" in core,
    )
    near = (keyword, assigns, token in ("=", ":", ":=", "=>"), digits > 0 and (upper or lower) and n >= 12, token.endswith((".", "!", "?")))
    return [k for k, t in enumerate(tests) if t], [k for k, t in enumerate(near) if t]


def plain_class(token: str) -> tuple | None:
    """For a short word of letters, with a stop behind it or not: all that its features depend on. None for other tokens."""
    word = token if token.isalpha() else token[:-1] if token[-1] in ".,;!?" and token[:-1].isalpha() else None
    if word is None or len(word) >= LONG or _NAMES(low := word.lower()) or low in _NAMED or "AKIA" in word:
        return None
    n = len(word)
    return n >= 8, word != low, word != word.upper(), word.isascii(), low.isascii() and not low.strip("abcdef"), token[-1]


def file_features(text: str) -> np.ndarray:
    """Of the whole text: code-like punctuation, pairs of names and values, and shortness."""
    return np.array([text.count("{") + text.count(";") > len(text) / 200, " = " in text or "=\"" in text, len(text) < 500], dtype=np.float64)


@dataclass
class Crf:
    own: np.ndarray  # OWN x 3
    left: np.ndarray  # NEAR x 3, of the token before
    left2: np.ndarray  # of the one before that
    right: np.ndarray  # of the token after
    file: np.ndarray  # FILE x 3
    steps: np.ndarray  # 3 x 3, from tag to tag
    plain: dict = field(default_factory=dict)  # rows of classes of plain words

    def slack(self) -> float:
        """The most that neighbouring tags can favour another tag over O."""
        t = self.steps
        inside = max(t[a, x] + t[x, b] - t[a, O] - t[O, b] for a in range(3) for b in range(3) for x in (B, I))
        ends = max(max(t[a, x] - t[a, O], t[x, a] - t[O, a]) for a in range(3) for x in (B, I))
        return max(0.0, inside, ends)

    def row(self, token: str) -> np.ndarray:
        """A token's share in its own tag scores and in those of its neighbours: 4 x 3."""
        if (kind := plain_class(token)) is None:
            return self.full_row(token)
        if kind not in self.plain:
            self.plain[kind] = self.full_row(token)
        return self.plain[kind]

    def full_row(self, token: str) -> np.ndarray:
        own, near = shape(token)
        return np.stack([self.own[own].sum(axis=0), self.left[near].sum(axis=0), self.left2[near].sum(axis=0), self.right[near].sum(axis=0)])

    def viterbi(self, scores: np.ndarray, before: bool, after: bool) -> list[int]:
        """The best tags for the tokens' scores; before, after: whether an O stands on that side."""
        best = scores[0] + (self.steps[O] if before else 0)
        back = []
        for s in scores[1:]:
            through = best[:, None] + self.steps
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + s
        if after:
            best = best + self.steps[:, O]
        tags = [int(best.argmax())]
        for k in reversed(back):
            tags.append(int(k[tags[-1]]))
        return tags[::-1]

    def uncertain(self, scores: np.ndarray) -> np.ndarray:
        """The tokens whose best tag may not be O, whatever the tags of their neighbours."""
        return np.flatnonzero(scores[:, O] - np.maximum(scores[:, B], scores[:, I]) <= self.slack())

    def tag(self, scores: np.ndarray) -> Iterator[tuple[int, int]]:
        """(token, tag) for tokens whose best tag is not O."""
        open_ = self.uncertain(scores)
        if not len(open_):
            return
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            lo, hi = int(run[0]), int(run[-1]) + 1
            for k, t in enumerate(self.viterbi(scores[lo:hi], lo > 0, hi < len(scores))):
                if t != O:
                    yield lo + k, t


def chain_scores(rows: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Tag scores of a text's tokens (rows: tokens x 4 x 3, as from Crf.row)."""
    s = rows[:, 0] + file
    s[1:] += rows[:-1, 1]
    s[2:] += rows[:-2, 2]
    s[:-1] += rows[1:, 3]
    return s


_TOKENS, _SOLID = re.compile(r"\S+"), re.compile(r"\S")
_SPACE = re.compile(r"\s")


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(place, piece): the text in pieces of about PIECE characters, cut at white space."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = m.start() if m else len(text)
        yield at, text[at:end] if at or m else text
        at = end


def tagged(text: str, model: Crf, rows_of) -> Iterator[tuple[int, int, int, str]]:
    """(number, tag, place, token) of each token whose best tag is not O, a piece of the text at a time.

    rows_of gives the model's rows of a list of tokens. From piece to piece go the rows of the last three tokens, as a
    token's score needs two tokens before and one after it, and a run of uncertain tokens that may go on.
    """
    file = file_features(text) @ model.file
    kept, number = np.empty((0, 4, 3)), 0  # rows of the last tokens; how many tokens there have been
    run: list[tuple[int, np.ndarray, int, str]] = []  # number, score, place and token of uncertain tokens side by side

    def decoded(after: bool) -> Iterator[tuple[int, int, int, str]]:
        if run:
            tags = model.viterbi(np.array([r[1] for r in run]), run[0][0] > 0, after)
            yield from ((r[0], t, r[2], r[3]) for r, t in zip(run, tags, strict=True) if t != O)
            run.clear()

    waiting: tuple[int, str] | None = None  # place and text of the last token, whose score wants the one after it
    for place, piece in pieces(text):
        tokens = piece.split()
        if not tokens:
            continue
        rows = np.concatenate([kept, rows_of(tokens)])
        last = not _SOLID.search(text, place + len(piece))
        scores = chain_scores(rows, file)
        lo, hi = max(0, len(kept) - 1), len(rows) if last else len(rows) - 1
        open_ = lo + model.uncertain(scores[lo:hi]) if hi > lo else []
        first = number - len(kept)
        if len(open_):
            places = None
            for k in open_:
                k = int(k)
                if run and run[-1][0] != first + k - 1:
                    yield from decoded(True)
                if k < len(kept):
                    at, token = waiting
                else:
                    places = places or [place + m.start() for m in _TOKENS.finditer(piece)]
                    at, token = places[k - len(kept)], tokens[k - len(kept)]
                run.append((first + k, scores[k], at, token))
            if run[-1][0] != first + hi - 1:
                yield from decoded(True)
        elif run and hi > lo:
            yield from decoded(True)
        number += len(tokens)
        if not last:
            waiting = (place + piece.rindex(tokens[-1]), tokens[-1])
        kept = rows[-3:].copy()
        if last:
            break
    yield from decoded(False)


def added_spans(tags: list[tuple[int, int, int, str]], base: list[Span]) -> list[Span]:
    """Spans of tagged tokens, an I joined to the tag before it, without what base spans cover; stretches of LEAST characters or more are left."""
    found: list[list[int]] = []
    chars: list[str] = []
    prev = -2
    for number, tag, place, token in tags:
        a, b = inner(token)
        if b - a < LEAST:
            continue
        if tag == I and prev == number - 1 and found:
            found[-1][1] = place + b
            chars[-1] += " " * (place + a - (found[-1][0] + len(chars[-1]))) + token[a:b]
        else:
            found.append([place + a, place + b])
            chars.append(token[a:b])
        prev = number
    out: list[Span] = []
    for (a, b), own in zip(found, chars, strict=True):
        at = a
        for start, _, end in [*(s for s in base if s[0] < b and a < s[2]), (b, "", b)]:
            lo, hi = at, max(at, start)
            if hi - lo < b - a:  # a stretch beside a base span, without the marks at its ends
                part = own[lo - a : hi - a]
                lo += len(part) - len(part.lstrip(_EDGE + " "))
                hi -= len(part) - len(part.rstrip(_EDGE + " "))
            if hi - lo >= LEAST:
                out.append((lo, "crf", hi))
            at = max(at, end)
    return out


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _of(rng: random.Random, chars: str, n: int) -> str:
    return "".join(rng.choice(chars) for _ in range(n))


#: Made-up secrets of the usual forms.
FORMS = (
    lambda r: _of(r, "0123456789abcdef", r.choice((32, 40, 64))), lambda r: _of(r, "0123456789ABCDEF", r.choice((32, 40))), lambda r: _of(r, _ABC + "+/", 40), lambda r: _of(r, _ABC, r.randint(20, 44)),
    lambda r: "AKIA" + _of(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda r: f"{_of(r, 'abcdefghijklmnopqrstuvwxyz', 3)}_{_of(r, _ABC, 36)}", lambda r: f"{_of(r, 'abcdefgh', 2)}-{_of(r, _ABC, 20)}-{_of(r, _ABC, 12)}",
    lambda r: f"ey{_of(r, _ABC, 18)}.ey{_of(r, _ABC, 30)}.{_of(r, _ABC + '_-', 43)}", lambda r: _of(r, _ABC[:52], r.randint(20, 44)), lambda r: f"{_of(r, _ABC[26:52], 3)}_{_of(r, _ABC[:52], 36)}",
)


def _harmless(rng: random.Random, word: str) -> str:
    """A made-up token with digits or marks that is no secret."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = re.sub(r"\W", "", word) or "name"
    return rng.choice([
        lambda: f"{word}.{number(2)}@mail{number(1)}.example.com", lambda: f"{word}@{word}.org", lambda: f"https://www.{word}.com/{word}/{number(3)}?id={number(4)}", lambda: number(16),
        lambda: ".".join(number(3) for _ in range(4)), lambda: f"+{number(1)}({number(3)}){number(3)}-{number(4)}", lambda: f"20{number(2)}-0{number(1)}-1{number(1)}T1{number(1)}:{number(2)}:{number(2)}", lambda: f"v{number(1)}.{number(2)}.{number(1)}",
        lambda: f"{word}_{word}_{number(2)}", lambda: f"{word}-{word}-{word}", lambda: word + number(3),
    ])()


def examples(texts: list[str], window: int = 16, seed: int = 3, forms: tuple = FORMS) -> list[tuple[list[str], list[int], np.ndarray]]:
    """Windows of tokens with their tags: base matches, made-up secrets put into half of the texts, and plain stretches."""
    rng = random.Random(seed)
    out = []
    for t in texts:
        for _ in range(2):
            lines = t.split(" ")
            at = rng.randint(0, len(lines))
            t = " ".join([*lines[:at], _harmless(rng, lines[at - 1]), *lines[at:]])
        if rng.random() < 0.5:
            lines = t.split(" ")
            value = rng.choice(forms)(rng)
            form = rng.choice(['{k} = "{v}"', "{k}={v}", "{k}: {v}", '"{v}"', "{v}", "'{v}'"]).format(k=rng.choice(("token", "password", "secret", "key", "auth", "API_KEY", "TOKEN")), v=value)
            at = rng.randint(0, len(lines))
            t = " ".join([*lines[:at], form, *lines[at:]])
            truth = [(t.find(value), "", t.find(value) + len(value))]
        else:
            truth = []
        truth += base_spans(t)
        places = list(_TOKENS.finditer(t))
        tags, prev = [O] * len(places), None
        for k, m in enumerate(places):
            a, b = inner(m[0])
            hit = next((s for s in truth if b - a >= 6 and s[0] < m.start() + b and m.start() + a < s[2]), None)
            if hit:
                tags[k] = I if hit == prev else B
            prev = hit
        marked = [k for k, x in enumerate(tags) if x != O] + [k for k, m in enumerate(places) if any(map(str.isdigit, m[0]))][:6]
        for k in {*marked[:8], *(rng.randrange(len(places)) for _ in range(2 if places else 0))}:
            lo = max(0, min(k - rng.randint(2, window - 3), len(places) - window))
            part = places[lo : lo + window]
            if len(part) == window:
                out.append(([m[0] for m in part], tags[lo : lo + window], file_features(t)))
    return out


def train(texts: list[str], rounds: int = 150, rate: float = 0.1, decay: float = 2e-3, forms: tuple = FORMS) -> Crf:
    """Maximise the windows' conditional log-likelihood by gradient steps over exact forward-backward sums."""
    data = examples(texts, forms=forms)
    width = OWN + 3 * NEAR + FILE
    if not data:
        data = examples(["plain words without any secret in this text at all to learn from it now then more"] * 8)
    n, length = len(data), len(data[0][0])
    x = np.zeros((n, length, width))
    y = np.array([tags for _, tags, _ in data])
    for k, (tokens, _, file) in enumerate(data):
        for t, token in enumerate(tokens):
            own, near = shape(token)
            x[k, t, own] = 1
            for back, at in ((-1, OWN), (-2, OWN + NEAR), (1, OWN + 2 * NEAR)):
                if 0 <= t - back < length:
                    x[k, t - back, [at + j for j in near]] = 1
        x[k, :, -FILE:] = file
    w, steps = np.zeros((width, 3)), np.zeros((3, 3))
    one = np.eye(3)[y]
    seen = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
    gold = np.einsum("ntf,nta->fa", x, one)
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(steps), np.zeros_like(steps)]]

    def lse(z: np.ndarray, axis: int) -> np.ndarray:
        top = z.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(z - top).sum(axis=axis))

    for r in range(1, rounds + 1):
        s = x @ w
        fore, aft = np.empty_like(s), np.zeros_like(s)
        fore[:, 0] = s[:, 0]
        for t in range(1, length):
            fore[:, t] = s[:, t] + lse(fore[:, t - 1, :, None] + steps, 1)
        for t in range(length - 2, -1, -1):
            aft[:, t] = lse(steps + (s[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
        z = lse(fore[:, -1], 1)
        node = np.exp(fore + aft - z[:, None, None])
        pair = np.exp(fore[:, :-1, :, None] + steps + (s[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads = [(gold - np.einsum("ntf,nta->fa", x, node)) / n - decay * w, (seen - pair.sum(axis=(0, 1))) / n - decay * steps]
        for p, g, m in zip((w, steps), grads, moments, strict=True):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-8)
    own, left, left2, right, file = np.split(w, [OWN, OWN + NEAR, OWN + 2 * NEAR, OWN + 3 * NEAR])
    return Crf(own, left, left2, right, file, steps)


def fit(docs: DataFrame, sample: int = 1500, most_bytes: int = 1 << 15, key: str = "doc_id", text: str = "text") -> Crf:
    """Train on about `sample` texts of no more than most_bytes each, chosen by a hash of the key. Null keys and texts teach nothing."""
    tune(docs.sparkSession)
    rows = bounded_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", sample, 3)
    found = rows.filter(F.octet_length("t") <= most_bytes).collect()
    return train([t for _, t in sorted((str(r["k"]), r["t"]) for r in found)])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scanner(model: Crf):
    """A function from texts to (base spans, all spans) of each, both by start and kind."""
    memo: dict[str, int] = {}
    table = np.zeros((1 << 12, 4, 3))

    def rows_of(tokens: list[str]) -> np.ndarray:
        nonlocal table
        at = list(map(memo.get, tokens))
        if None in at:
            if len(memo) > MEMO:
                memo.clear()
            new = [w for w in dict.fromkeys(tokens) if w not in memo and len(w) <= LONGEST]
            while len(memo) + len(new) + 1 > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            for w in new:
                table[len(memo)] = model.row(w)
                memo[w] = len(memo)
            at = [memo.get(w, -1) for w in tokens]
        rows = table[at]
        if -1 in at:
            for k, w in enumerate(tokens):
                if len(w) > LONGEST:
                    rows[k] = model.row(w)
        return rows

    def scan(texts: list) -> list[tuple[list[Span], list[Span]]]:
        out = []
        for t in texts:
            base = base_spans(t) if t else []
            tags = list(tagged(t, model, rows_of)) if t else []
            out.append((base, sorted(base + added_spans(tags, base), key=lambda s: (s[0], KINDS.index(s[1]))) if tags else base))
        return out

    return scan


def find(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): spans (start, kind, end) that the fixed patterns find in every whole text, and all spans.

    Positions are code points, the end is exclusive. Kinds are assign, access, hex and crf; spans are by start,
    then in that order. A null or empty text has none. Null keys and repeated rows are kept, an empty table
    gives an empty one, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def build():
        scan = scanner(shared.value)

        def step(texts: list) -> list:
            found = scan(texts)
            return [[[{"start": a, "kind": k, "end": b} for a, k, b in spans] for spans in (f[n] for f in found)] for n in (0, 1)]

        return step

    span = "array<struct<start:int,kind:string,end:int>>"
    return map_texts(docs, build, f"base {span}, spans {span}", key, text)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones as one, replaced by the mark."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, model: Crf, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by the mark; all rows and columns stay, null texts stay null."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = scanner(shared.value)
        for texts in batches:
            own = [t if isinstance(t, str) else None for t in texts]
            found = scan(own)
            yield pd.Series([redact(t, both, mark) if t is not None and both else t for t, (_, both) in zip(own, found, strict=True)], dtype=object)

    return docs.withColumn(text, clean(F.col(text)))
