"""Rank-synchronous pair merging over ragged arrays of symbols.

Every round finds each sequence's lowest-rank pair and merges all its occurrences at once
(of overlapping ones, every other from the left); sequences without a mergeable pair leave.
Where a merge makes a pair of equal or lower rank beside it, one-at-a-time order could
differ: such sequences are merged by a heap instead, so results are always those of merging
one pair at a time, lowest rank first, then leftmost.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int64).max


class PairTable:
    """Pairs of symbols below ``size`` that merge, each with its rank and the symbol made."""

    def __init__(self, pairs: list[tuple[int, int, int, int]], size: int):
        rows = sorted((a * size + b, r, m) for a, b, r, m in pairs)
        self.size = size
        self.keys, self.ranks, self.made = (np.array([x[k] for x in rows], np.int64) for k in range(3))
        self.pair = {k: (r, m) for k, r, m in rows}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge_one(self, symbols: list[int]) -> list[int]:
        """One merge at a time, by a heap."""
        n, sym = len(symbols), list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []
        gone = [False] * n

        def push(i: int, j: int) -> None:
            if sym[i] >= 0 and sym[j] >= 0 and (x := self.pair.get(sym[i] * self.size + sym[j])):
                heapq.heappush(heap, (x[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j] = self.pair[a * self.size + b][1], True
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def merge(self, sym: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols and their sequence, in order; ``row`` ascends, symbols below 0 never merge."""
        first, where = sym, row
        rank, made = self.lookup(sym[:-1], sym[1:])
        rank, made = np.append(rank, NONE)[: len(sym)], np.append(made, 0)[: len(sym)]
        rank[np.append(row[1:] != row[:-1], True)[: len(sym)]] = NONE
        hazard: set[int] = set()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(sym)))
            done = least == NONE
            if done.any():
                keep = np.repeat(~done, size)
                out.append((sym[~keep], row[~keep]))
                sym, row, rank, made, least, size = sym[keep], row[keep], rank[keep], made[keep], least[~done], size[~done]
                if not len(sym):
                    break
            floor = np.repeat(least, size)
            at = np.flatnonzero(rank == floor)
            run = np.append(True, at[1:] != at[:-1] + 1)
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            # Between two merges side by side, the first one's new pair comes before the second merge.
            near = at[:-1][(at[1:] == at[:-1] + 2) & (row[at[1:]] == row[at[:-1]])]
            early = row[near[self.lookup(made[near], sym[near + 2])[0] <= floor[near]]]
            sym = sym.copy()
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            sym, row, rank, made, floor = sym[keep], row[keep], rank[keep], made[keep], floor[keep]
            beside = np.zeros(len(sym) + 1, bool)
            beside[new] = beside[new - 1] = True  # -1 marks the spare place
            touched = np.flatnonzero(beside[:-1])
            right = np.minimum(touched + 1, len(sym) - 1)
            r, m = self.lookup(sym[touched], sym[right])
            r[(right == touched) | (row[right] != row[touched])] = NONE
            rank[touched], made[touched] = r, m
            bad = np.concatenate([early, row[touched[r <= floor[touched]]]])
            if len(bad):
                hazard.update(bad.tolist())
                keep = ~np.isin(row, bad)
                sym, row, rank, made = sym[keep], row[keep], rank[keep], made[keep]
        for k in sorted(hazard):
            s = np.array(self.merge_one(first[np.searchsorted(where, k) : np.searchsorted(where, k, "right")].tolist()), np.int64)
            out.append((s, np.full(len(s), k, where.dtype)))
        if not out:
            return first[:0], where[:0]
        sym, row = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(row, kind="stable")
        return sym[order], row[order]
