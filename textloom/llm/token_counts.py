"""Token counts of whole texts without building the tokens (operator 5).

Distinct pre-tokens of a batch become ragged numpy arrays of symbols, each sequence's
lowest-rank pair is merged everywhere at once (see ragged), and surviving symbols are counted.

Defined results: null or empty text 0 tokens and 0 bytes. No truncation. Repeated rows give
equal rows. Ties of ranks merge from the left. A very long text costs memory of a few times its size.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from itertools import accumulate, pairwise

import numpy as np
from pyspark.sql import DataFrame

from textloom.llm.common import map_texts
from textloom.llm.ragged import PairTable

SPACE = "▁"
CACHE_WORDS = 200_000


class PieceCounter:
    """Counts as a sentencepiece BPE model with byte fallback splits text."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or (p[:2] == SPACE * 2 and p.strip(SPACE)) for _, p, _ in pieces):
            raise ValueError("pieces cross the pre-token borders that this counter assumes")
        self.symbol = {p: k for k, (_, p, _) in enumerate(pieces)}
        self.whole = len(pieces)
        for _, p, _ in pieces:
            for c in p:
                self.symbol.setdefault(c, len(self.symbol))
        rank = {p: round(-s * 1e3) for _, p, s in pieces}
        self.bytes_of = np.array([1 if k < self.whole else len(s.encode()) for s, k in self.symbol.items()], np.int64)
        self.pairs = PairTable([(self.symbol[p[:k]], self.symbol[p[k:]], rank[p], self.symbol[p]) for _, p, _ in pieces for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol], len(self.symbol) + 1)
        table = np.full(0x110000, -1, np.int32)
        for s, k in self.symbol.items():
            if len(s) == 1:
                table[ord(s)] = k
        self.char = table
        self.split = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall
        self.seen: dict[str, int] = {}

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) pre-token. Characters of no piece give as many as UTF-8 bytes."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.char[codes].astype(np.int64)
        sym = np.where(sym < 0, -1 - (codes > 0x7F) - (codes > 0x7FF) - (codes > 0xFFFF), sym)
        sym, row = self.pairs.merge(sym, row)
        return np.bincount(row, np.where(sym < 0, -sym, self.bytes_of[np.maximum(sym, 0)]), len(words)).astype(np.int64)

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.split((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        missing = set().union(*split).difference(self.seen)
        if missing:
            if len(self.seen) + len(missing) > CACHE_WORDS:
                self.seen = {}
                missing = set().union(*split)
            words = list(missing)
            ends = list(accumulate(map(len, words)))
            cuts = [0, *(i for i in range(1, len(words)) if ends[i - 1] // 1_000_000 != ends[i] // 1_000_000), len(words)]
            for a, b in pairwise(cuts):
                self.seen.update(zip(words[a:b], self.count_words(words[a:b]).tolist(), strict=True))
        of = self.seen.__getitem__
        return [sum(map(of, w)) for w in split]


@functools.lru_cache(maxsize=2)
def piece_counter(path: str | None) -> PieceCounter:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceCounter(path)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def run(ids, texts):
        n = piece_counter(path).counts(texts)
        return {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(df, id_col, text_col, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", run)
