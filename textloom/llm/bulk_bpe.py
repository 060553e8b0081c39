"""Whole batches of texts to BPE ids in numpy, without a Python object for each word.

The batch becomes one byte array. Words start where the class of characters changes. Words
get 64-bit hashes; new ones are merged in bulk (see ragged) and remembered in sorted arrays,
and the ids of all words are gathered from there. Bytes are compared wherever hashes are
equal, so a collision is noticed; such a batch takes the word-by-word way.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex

from textloom.llm.bpe import WHITE, WordBpe
from textloom.llm.common import slices

MOST_WORDS = 600_000
POWERS = 4096
SLICE = 1_000_000
SEPARATOR = "\n"


@functools.cache
def classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by character."""
    out = np.full(0x110000, 3, np.uint8)
    text = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for k, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (0, f"[{WHITE}]")):
        found = "".join(regex.findall(f"{pattern}+", text))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = k
    return out


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    total = np.cumsum(length)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(start - (total - length), length)


class BulkBpe:
    def __init__(self, path: str):
        self.words = WordBpe(path, heap=False)
        self.mix = np.random.default_rng(7).integers(1, 2**63, POWERS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.contraction = regex.compile(rf"(?<![^{WHITE}\p{{L}}\p{{N}}])'(?:s|t|re|ve|m|ll|d)")
        self.white = regex.compile(f"[{WHITE}]")
        self.forget()

    def forget(self) -> None:
        """Remembered words: hash (ascending), and where their bytes and ids lie."""
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros((4, 0), np.int64)  # byte start, byte length, id start, id count
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        if len(self.hash) + len(hashes) > MOST_WORDS:
            self.forget()
        raw = data[spans(start, length)]
        row = np.repeat(np.arange(len(start)), length)
        ends = np.cumsum(length) - 1
        sym = self.words.inner[raw]
        sym[ends] = self.words.last[raw[ends]]
        sym, row = self.words.pairs.merge(sym, row)
        count = np.bincount(row, minlength=len(start))
        new = np.stack([ends + 1 - length + len(self.bytes), length, np.cumsum(count) - count + len(self.ids), count])
        self.bytes, self.ids = np.concatenate([self.bytes, raw]), np.concatenate([self.ids, sym.astype(np.uint32)])
        both = np.concatenate([self.hash, hashes])
        order = np.argsort(both, kind="stable")
        self.hash, self.at = both[order], np.concatenate([self.at, new], 1)[:, order]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        At most about SLICE characters are in hand at once; longer texts are cut at white space.
        """
        parts, owner = [], []
        for k, t in enumerate(texts):
            at = 0
            while t and len(t) - at > SLICE and (m := self.white.search(t, at + SLICE)):
                parts.append(t[at : m.start()])
                owner.append(k)
                at = m.start()
            parts.append(t[at:] if t and at else t)
            owner.append(k)
        out = [b""] * len(texts)
        for own, batch in slices(owner, parts, SLICE):
            for k, raw in zip(own, self.encode_slice(batch), strict=True):
                out[k] = out[k] + raw if out[k] else raw
        return out

    def encode_slice(self, texts: list[str | None]) -> list[bytes]:
        odd = [k for k, t in enumerate(texts) if t and any(s in t for s in self.words.special)]
        apart = set(odd)
        out = self.encode_plain(["" if t is None or k in apart else self.normal(t) for k, t in enumerate(texts)])
        if out is None:
            return self.words.encode_bytes(texts)
        for k, raw in zip(odd, self.words.encode_bytes([texts[k] for k in odd]) if odd else [], strict=True):
            out[k] = raw
        return out

    def encode_plain(self, texts: list[str]) -> list[bytes] | None:
        joined = SEPARATOR.join([*texts, ""])
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        if joined.isascii():
            kind, begins = classes()[data], None
        else:
            kind = classes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
            begins = np.flatnonzero((data & 0xC0) != 0x80)
        start = np.append(True, kind[1:] != kind[:-1]) | (kind == 2)
        if "'" in joined:
            for m in self.contraction.finditer(joined):
                a, b = m.span()
                start[a], start[a + 1 : b] = True, False
                kind[a:b] = 1
                if b < len(start):
                    start[b] = True
        size = np.ones(len(kind), np.int64) if begins is None else np.diff(np.append(begins, len(data)))
        first = np.flatnonzero(start)  # of runs of characters, white space included
        length = np.add.reduceat(size, first) if len(first) else first
        place = first if begins is None else begins[first]
        real = kind[first] != 0
        place, length = place[real], length[real]
        cuts = np.searchsorted(place, np.cumsum([0, *(len(t) + 1 if begins is None else len(t.encode()) + 1 for t in texts)]))
        if not len(place):
            return [b""] * len(texts)
        flat = spans(place, length)
        head = np.cumsum(length) - length
        inside = np.arange(len(flat)) - np.repeat(head, length)
        hashed = np.add.reduceat((data[flat].astype(np.uint64) + np.uint64(1)) * self.mix[inside % POWERS] + (inside // POWERS).astype(np.uint64), head)
        hashed ^= hashed >> np.uint64(29)
        found, which, back = np.unique(hashed, return_index=True, return_inverse=True)
        if (length[which][back] != length).any() or (data[flat] != data[spans(place[which][back], length)]).any():
            return None
        at = np.searchsorted(self.hash, found)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == found[known]
        if not known.all():
            if len(self.hash) + int((~known).sum()) > MOST_WORDS:
                known[:] = False  # everything is forgotten and learned anew
            new = which[~known]
            self.learn(found[~known], data, place[new], length[new])
            at = np.searchsorted(self.hash, found)
        byte, width, ids, count = self.at[:, at]
        if (width != length[which]).any() or (self.bytes[spans(byte, width)] != data[spans(place[which], length[which])]).any():
            return None
        each = count[back]
        flat_ids = self.ids[spans(ids[back], each)].astype("<u4")
        ends = np.append(0, np.cumsum(each))[cuts]
        return [flat_ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def bulk_bpe(path: str | None) -> BulkBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return BulkBpe(path)
