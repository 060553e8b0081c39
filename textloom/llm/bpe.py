"""Byte-pair encoding and decoding of whole texts (operator 2).

A word's symbols form a doubly linked list. A heap holds (merge rank, position) of every
adjacent pair that some merge joins; the lowest is popped, skipped if stale, applied, and
the new neighbours' pairs are pushed. Decoding concatenates vocabulary strings.

Defined results: a null or empty text has no ids and decodes to "". Repeated rows give
equal rows. The whole text is encoded; nothing is cut; a very long text costs time and memory in
proportion to its length. Ties of merge ranks go to the leftmost pair. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from textloom.llm.common import map_texts
from textloom.llm.ragged import PairTable

#: Unicode white space (the White_Space property), written out since engines differ on \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words remembered by a worker; a full memory is emptied.
CACHE_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else 256 onwards in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


def merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge by a heap of ranks over a linked list, lowest rank first, then leftmost."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, p) for i, p in enumerate(pairwise(symbols)) if (r := ranks.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n or (symbols[i], symbols[j]) != pair:
            continue  # stale: one side has been merged since
        symbols[i], symbols[j] = pair[0] + pair[1], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(p := (symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, p))
        if (h := before[i]) >= 0 and (r := ranks.get(p := (symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, p))
    return [s for s in symbols if s is not None]


class WordBpe:
    """BPE with word ends, as its JSON file states: NFC, lower case, white space dropped.

    ``heap=False`` merges new words in bulk (see ragged) instead of one by one; results are
    equal, which the tests hold.
    """

    def __init__(self, path: str, heap: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.alphabet = byte_alphabet()
        self.ranks = {m: i for i, m in enumerate(merges)} if heap else None
        self.pairs = None if heap else PairTable([(self.vocab[a], self.vocab[b], i, self.vocab[a + b]) for i, (a, b) in enumerate(merges)], len(self.vocab))
        self.inner = np.array([self.vocab[c] for c in self.alphabet], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in self.alphabet], np.int64)
        import regex

        self.words_of = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+").findall
        self.fixed = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.words: dict[str, bytes] = {}
        #: What stands between white space, to its ids.
        self.known = dict(self.fixed)

    def word_symbols(self, word: str) -> list[str]:
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        return merge_symbols(symbols, self.ranks)

    def learn_words(self, words: list[str]) -> None:
        if self.pairs is None:
            for w in words:
                self.words[w] = np.array([self.vocab[s] for s in self.word_symbols(w)], "<u4").tobytes()
            return
        raw = [w.encode("utf-8") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        row = np.repeat(np.arange(len(raw)), length)
        code = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[code]
        ends = np.cumsum(length) - 1
        sym[ends] = self.last[code[ends]]
        sym, row = self.pairs.merge(sym, row)
        stop = (4 * np.searchsorted(row, np.arange(len(raw)), "right")).tolist()
        ids, start = sym.astype("<u4").tobytes(), 0
        for w, e in zip(words, stop, strict=True):
            self.words[w] = ids[start:e]
            start = e

    def learn(self, missing: set[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.known.update(self.fixed)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        parts = {m: self.words_of(m) for m in missing}
        new = sorted(set().union(*parts.values()).difference(self.words))
        for k in range(0, len(new), 100_000):
            self.learn_words(new[k : k + 100_000])
        of = self.words.__getitem__
        for m, p in parts.items():
            self.known[m] = of(p[0]) if len(p) == 1 else b"".join(map(of, p))

    def segments(self, text: str | None) -> list[str]:
        """Special strings and, between them, what stands between white space of the normalised text."""
        out: list[str] = []
        for part in self.cut.split(text or "") if "<|" in (text or "") else (text or "",):
            if part in self.special:
                out.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                if "\x1c" in part or "\x1d" in part or "\x1e" in part or "\x1f" in part:
                    out += self.words_of(part)  # white space to Python's split, but not here
                else:
                    out += part.split()
        return out

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.segments(t) for t in texts]
        wanted = set().union(*split)
        missing = wanted.difference(self.known)
        if missing:
            self.learn(missing if len(self.known) <= CACHE_WORDS else wanted.difference(self.fixed))
        of = self.known.__getitem__
        return [b"".join(map(of, s)) for s in split]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, space-joined: the file names no decoder. Ids without a string are left out."""
        of = self.strings.get
        return " ".join([s for i in ids if (s := of(i)) is not None])


@functools.lru_cache(maxsize=2)
def word_bpe(path: str | None, heap: bool = True) -> WordBpe:
    """One encoder per Python worker. path: a file, else the public word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordBpe(path, heap)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row: the id column as doc_id, ids array<int>, decoded string."""

    def run(ids, texts):
        bpe = word_bpe(path)
        found = [np.frombuffer(raw, "<u4").tolist() for raw in bpe.encode_bytes(texts)]
        return {"doc_id": ids, "ids": found, "decoded": [*map(bpe.decode, found)]}

    return map_texts(df, id_col, text_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string", run)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """ids array<int> back to the decoded string."""

    def run(keys, arrays):
        bpe = word_bpe(path)
        return {"doc_id": keys, "decoded": [bpe.decode(a or []) for a in arrays]}

    return map_texts(df, id_col, ids_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, decoded string", run, text="array<int>")


def encode_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As encode, with digests in place of the ids and the decoded text."""

    def run(ids, texts):
        bpe = word_bpe(path)
        n, a, b = [], [], []
        for raw in bpe.encode_bytes(texts):
            n.append(len(raw) // 4)
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
        return {"doc_id": ids, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_texts(df, id_col, text_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
