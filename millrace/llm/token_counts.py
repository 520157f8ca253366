"""Word-piece counts by a linear longest-match automaton that never builds the pieces.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for those that continue
it. Each node has a failure link, to the node that stands for what remains once the greedy pieces of its
string are taken off, and the number of pieces so popped. A word is read once, byte by byte; following
failure links adds popped counts, so the time is linear in the word's length.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame

from .base import map_texts
from .bpe import byte_characters

MEMO = 400_000


class LongestMatch:
    """before: bytes that stand before each word when it is matched."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes], before: bytes = b"") -> None:
        self.before = before
        self.goto: dict[int, int] = {}  # node << 8 | byte -> node
        parents: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        piece = [False, False]
        self.begin, self.more = 0, 1
        for root, pieces in ((self.begin, initial), (self.more, continuing)):
            for p in pieces:
                if not p:
                    continue
                node = root
                for b in p:
                    key = node << 8 | b
                    if key not in self.goto:
                        self.goto[key] = len(parents)
                        parents.append((node, b))
                        piece.append(False)
                    node = self.goto[key]
                piece[node] = True
        n = len(parents)
        self.fail, self.popped = [-1] * n, [0] * n
        depth = [0] * n
        for v in range(2, n):  # a parent precedes its children
            depth[v] = depth[parents[v][0]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if piece[v]:
                self.fail[v], self.popped[v] = self.more, 1
                continue
            u, b = parents[v]
            z, count = self.fail[u], self.popped[u]
            while z >= 0 and z << 8 | b not in self.goto:
                count += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.goto[z << 8 | b], count
        self.memo: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of the word by greedy longest match; -1 if some rest of it begins with no piece. An empty word has none."""
        goto, fail, popped = self.goto, self.fail, self.popped
        u, n = self.begin, 0
        for b in word:
            while (v := goto.get(u << 8 | b)) is None:
                if fail[u] < 0:
                    return -1
                n += popped[u]
                u = fail[u]
            u = v
        while u > self.more:
            if fail[u] < 0:
                return -1
            n += popped[u]
            u = fail[u]
        return n

    def remember(self, word: bytes) -> int:
        n = self.count(self.before + word)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(word) < 100:
            self.memo[word] = n
        return n


def byte_level_pieces(path: str) -> list[bytes]:
    """Tokens, as bytes, of a byte-level vocabulary file of the `tokenizers` library."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in enumerate(byte_characters())}
    return [bytes(map(byte.__getitem__, t)) for t in vocab if all(c in byte for c in t)]


@cache
def automaton(path: str) -> LongestMatch:
    """Words are read with a space before them: pieces with one begin words, pieces without any continue them."""
    pieces = byte_level_pieces(path)
    return LongestMatch([p for p in pieces if p[:1] == b" " and b" " not in p[1:]], [p for p in pieces if b" " not in p], b" ")


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown): word pieces of every whole text by greedy longest match.

    Words are runs without white space (bytes 9 to 13 and 32). A word that can't be matched to its end counts
    as one unknown token. A null or empty text has no words. Null keys and repeated rows are kept, an empty
    table gives an empty one, and other columns are not read. path: a vocabulary file that each machine has.
    """

    def build():
        auto = automaton(path)

        def step(texts: list) -> list:
            words, tokens, unknown = [], [], []
            for t in texts:
                own = (t or "").encode().split()
                found = list(map(auto.memo.get, own))
                if None in found:
                    found = [auto.remember(w) if n is None else n for w, n in zip(own, found, strict=True)]
                bad = found.count(-1)
                words.append(len(own))
                tokens.append(sum(found) + 2 * bad)
                unknown.append(bad)
            return [words, tokens, unknown]

        return step

    return map_texts(docs, build, "n_words long, n_tokens long, n_unknown long", key, text)
