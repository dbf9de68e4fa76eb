"""Rank-synchronous pair merging over ragged numpy arrays.

Sequences of symbols lie end to end in one array. In each round every sequence finds its pair of lowest rank and
applies all occurrences of it at once, from the left where they overlap; all sequences do so together. A pair that a
merge makes has a higher rank than that merge, so ranks only rise and the result is that of merging one at a time.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40


class Places:
    """Where each of distinct 64-bit keys stands, found for many keys at once: open addressing, one slot in sixteen or fewer filled."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.view(np.int64)
        self.bits = max(8, (16 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        slot, todo = self._slot(self.keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = free
            todo = todo[self.slots[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it has none."""
        keys = keys.view(np.int64)
        slot = self._slot(keys)
        at = self.slots[slot].astype(np.int64)
        other = np.flatnonzero(at >= 0)
        other = other[self.keys[at[other]] != keys[other]]
        while len(other):
            slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
            at[other] = self.slots[slot[other]]
            other = other[at[other] >= 0]
            other = other[self.keys[at[other]] != keys[other]]
        return at


class Merges:
    """Ranks and results of pairs of symbol ids."""

    def __init__(self, left, right, rank, result):
        self.pairs = Places(np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64))
        self.rank, self.result = np.r_[np.asarray(rank, np.int64), NONE], np.r_[np.asarray(result, np.int64), -1]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place) of each pair; NONE where it doesn't merge."""
        at = self.pairs.find(left << 32 | right)
        return self.rank[at], at

    def merge(self, symbols: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, seq) after all merges; seq numbers each symbol's sequence, ascending. Sequences that are done leave the rounds."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks, at = self._pairs(symbols, seq)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[first, len(seq)])
            least = np.repeat(np.minimum.reduceat(ranks, first), size)
            over = least == NONE
            if over.any():
                done.append((symbols[over], seq[over]))
                symbols, seq, ranks, at, least = (x[~over] for x in (symbols, seq, ranks, at, least))
                if not len(symbols):
                    break
            hit = ranks == least
            run = hit[1:] & hit[:-1]
            if run.any():  # overlaps, as in aaa: every other one of a run, from its left
                i = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], i, -1))
                hit &= (i - start) % 2 == 0
            symbols = np.where(hit, self.result[at], symbols)
            keep = ~np.r_[False, hit[:-1]]
            before = np.r_[hit[1:], False]  # the pair of a symbol left of a merge changes as well
            symbols, seq, ranks, at, stale = symbols[keep], seq[keep], ranks[keep], at[keep], (hit | before)[keep]
            i = np.flatnonzero(stale)
            ranks[i], at[i] = self._pairs(symbols, seq, i)
        if not done:
            return symbols, seq
        symbols, seq = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(seq, kind="stable")
        return symbols[order], seq[order]

    def _pairs(self, symbols, seq, i=None):
        if i is None:
            i = np.arange(len(symbols))
        j = np.minimum(i + 1, max(len(symbols) - 1, 0))
        rank, at = self.find(symbols[i], symbols[j])
        return np.where((j > i) & (seq[i] == seq[j]), rank, NONE), at
