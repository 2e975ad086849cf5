"""An FM-index over integer symbols: wavelet-matrix ranks, batched backward search, sampled locate.

The text is a sequence of runs of symbols 1 .. sigma, each ended by a separator.
Separators are pairwise different and smaller than every symbol, so suffixes
have a total order that ends inside their run, and no match crosses a run.
All searches are vectorised over the patterns, all walks over the matches.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    cur = np.empty(n, dtype=np.int64)
    sorted_rank = rank[order]
    # a rank is the number of suffixes before its group of ties
    fresh = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    cur[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    k = 1
    while True:
        same = np.zeros(n, dtype=bool)
        tie = cur[order[1:]] == cur[order[:-1]]
        same[1:] |= tie
        same[:-1] |= tie
        slots = np.flatnonzero(same)
        if not len(slots):
            return order
        suffix = order[slots]
        nxt = suffix + k
        second = np.where(nxt < n, cur[np.minimum(nxt, n - 1)] + 1, 0)
        key = cur[suffix] * (n + 1) + second
        inner = np.argsort(key, kind="stable")
        suffix, key = suffix[inner], key[inner]
        order[slots] = suffix
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        cur[suffix] = np.maximum.accumulate(np.where(fresh, slots, 0))
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            count = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(int(len(seq) - count[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before position ``at``."""
        lo, hi = np.zeros_like(at), at
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            one_lo, one_hi = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(bit, zeros + one_lo, lo - one_lo), np.where(bit, zeros + one_hi, hi - one_hi)
        return hi - lo


class FMIndex:
    """Index of ``text``: symbols 1 .. sigma, 0 for a separator; the text starts and ends with one."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        text = np.asarray(text, dtype=np.int64)
        if not len(text) or text[0] or text[-1]:
            raise ValueError("the text must start and end with a separator")
        fence = text == 0
        n_fence = int(fence.sum())
        rank = text + n_fence - 1
        rank[fence] = np.arange(n_fence)
        sa = suffix_array(rank)
        self.bwt = text[sa - 1]  # the first suffix wraps round to the last separator
        self.first = n_fence + np.concatenate([[0, 0], np.cumsum(np.bincount(text[~fence], minlength=sigma + 1)[1:])])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.sampled = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the suffixes that start with each row of ``patterns``."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), len(self.bwt), dtype=np.int64)
        live = np.arange(len(patterns))
        for col in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, col]
            lo[live] = self.first[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.first[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = lo >= hi
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        rows = rows.copy()
        out = np.zeros(len(rows), dtype=np.int64)
        walk = np.arange(len(rows))
        steps = 0
        while len(walk):
            here = rows[walk]
            known = self.sampled[here]
            out[walk[known]] = self.samples[self.before[here[known]]] + steps
            walk, here = walk[~known], here[~known]
            c = self.bwt[here]
            rows[walk] = self.first[c] + self.ranks.rank(c, here)
            steps += 1
        return out
