"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that stand next to each other inside no token of the vocabulary can never be
joined by a merge, whatever surrounds them. Such a pair is a certain cut: the fragments between cuts are
encoded independently and their ids concatenated, which gives the ids of the whole word.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import map_texts

#: Entries kept in each memo of a worker. Only speed depends on it.
MEMO = 200_000
END = "</w>"
#: Finds a character outside the blocks on whose letters, digits and white space all Unicode versions in use agree.
UNSURE = regex.compile(r"[^\u0000-\u052f\u2000-\u206f\u20a0-\u20bf\u2190-\u2bff\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f64f]").search


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        chars = byte_characters()
        self.inner = [self.vocab[c] for c in chars]
        self.final = [self.vocab[c + END] for c in chars]
        # bytes of every token that merges can make; the word end belongs to its last byte
        seq = {c: bytes([b]) for b, c in enumerate(chars)} | {c + END: bytes([b]) for b, c in enumerate(chars)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        inside = np.zeros((2, 256, 256), dtype=bool)  # [at the word's end][byte][next byte]
        for rank, (a, b) in enumerate(model["merges"]):
            self.merge[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
            whole = seq[a + b] = seq[a] + seq[b]
            ends = b.endswith(END) and b != END
            for k in range(len(whole) - 1):
                inside[int(ends and k == len(whole) - 2), whole[k], whole[k + 1]] = True
        self.inside = inside.tolist()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.path = path
        self.library = None
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[bytes, bool], tuple[int, ...]] = {}

    def cuts(self, word: bytes) -> list[int]:
        """Positions in word where a token certainly ends."""
        inner, final = self.inside
        last = len(word) - 1
        return [k for k in range(1, last + 1) if not (final if k == last else inner)[word[k - 1]][word[k]]]

    def merged(self, fragment: bytes, ends: bool) -> tuple[int, ...]:
        """Ids of one fragment, joining the best-ranked pair until none is left."""
        ids = [self.inner[b] for b in fragment]
        if ends:
            ids[-1] = self.final[fragment[-1]]
        while len(ids) > 1:
            best, new, at = None, 0, 0
            for k, pair in enumerate(zip(ids, ids[1:], strict=False)):
                if (m := self.merge.get(pair)) and (best is None or m[0] < best):
                    (best, new), at = m, k
            if best is None:
                break
            ids[at : at + 2] = [new]
        return tuple(ids)

    def merged_long(self, fragment: bytes, ends: bool) -> tuple[int, ...]:
        """The same for long fragments, with a heap of pairs, in n log n steps."""
        import heapq

        ids = [self.inner[b] for b in fragment]
        if ends:
            ids[-1] = self.final[fragment[-1]]
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := self.merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = right[k]
            if not alive[k] or j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], right[k] = new, False, right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y >= 0 and (m := self.merge.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return tuple(i for i, keep in zip(ids, alive, strict=True) if keep)

    def fragment(self, raw: bytes, ends: bool, keep: bool) -> tuple[int, ...]:
        """Ids of a fragment. Those of cut words are kept; a word in one piece is kept as a word."""
        if (ids := self.fragments.get((raw, ends))) is None:
            ids = (self.merged if len(raw) < 48 else self.merged_long)(raw, ends)
            if keep and len(raw) < 200:
                if len(self.fragments) >= MEMO:
                    self.fragments.clear()
                self.fragments[raw, ends] = ids
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        cuts = self.cuts(raw)
        out: list[int] = []
        start = 0
        for cut in [*cuts, len(raw)]:
            out += self.fragment(raw[start:cut], cut == len(raw), bool(cuts))
            start = cut
        if len(self.words) >= MEMO:
            self.words.clear()
        ids = tuple(out)
        if len(raw) < 200:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.at_special and any(s in text for s in self.special):
            out: list[int] = []
            for part in self.at_special(text):
                out += [self.special[part]] if part in self.special else self.encode_plain(part)
            return out
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        words = self.split(normalized(text)) if text.isascii() or not UNSURE(text) else self.split_unsure(text)
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.word(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return list(chain.from_iterable(found))

    def split_unsure(self, text: str) -> list[str]:
        """Words of a text with characters that Unicode versions class differently: cut by the library's own tables."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte = {c: b for b, c in enumerate(byte_characters())}
        text = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces, word ends included."""
        return " ".join(map(self.token.__getitem__, ids))


def normalized(text: str) -> str:
    """NFC, then each character lower-cased by itself. White space separates words whatever it is."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


@cache
def tokenizer(path: str) -> WordBpe:
    """One per worker process."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): every whole text's token ids. path: a tokenizer file that each machine has.

    A null text counts as empty and gives an empty array, as an empty one does. A null key is kept. Equal
    and repeated rows give equal rows; an empty table gives an empty one. Other columns are not read.
    """

    def build():
        bpe = tokenizer(path)
        return lambda texts: [_lists([bpe.encode(t or "") for t in texts])]

    return map_texts(docs, build, "ids array<int>", key, text)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded string) from (key, ids); null ids decode to an empty text."""
    kind = dict(encoded.dtypes)[key]

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            texts = [bpe.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], [key, "ids", "decoded"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encode and decode in one Python step, for callers that want both."""

    def build():
        bpe = tokenizer(path)

        def step(texts: list) -> list:
            ids = [bpe.encode(t or "") for t in texts]
            return [_lists(ids), [bpe.decode(x) for x in ids]]

        return step

    return map_texts(docs, build, "ids array<int>, decoded string", key, text)


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
