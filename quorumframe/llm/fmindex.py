"""FM-index over a sequence of small integers, searched for many patterns at once with numpy.

The Burrows-Wheeler transform comes from a suffix array built by prefix doubling;
ranks come from a wavelet matrix (one bit vector for each bit of the alphabet);
positions come from suffix positions sampled every SAMPLE symbols of the text.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of text, which must end in its unique smallest symbol."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    s = text[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).astype(np.int64))))
    k = 1
    while rank[order[-1]] < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).astype(np.int64))))
        k *= 2
    return order


class WaveletMatrix:
    """rank and access over integers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.ones: list[np.ndarray] = []  # ones before each position, by level from the highest bit
        self.zeros: list[int] = []
        v = values
        for level in range(levels - 1, -1, -1):
            bit = (v >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            r = self.ones[k][at]
            at = np.where((symbols >> level) & 1, self.zeros[k] + r, at - r)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the position beside it."""
        return self.down(symbols, at) - self.down(symbols, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            r = self.ones[k][at]
            bit = self.ones[k][at + 1] - r
            out |= bit.astype(np.int64) << level
            at = np.where(bit, self.zeros[k] + r, at - r)
        return out


class FMIndex:
    """Index of a text of symbols 1..alphabet-1 (0 is added as its end)."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        text = np.concatenate((text.astype(np.int64), [0]))
        self.n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.wavelet = WaveletMatrix(bwt, max(1, int(alphabet - 1).bit_length()))
        marked = sa % SAMPLE == 0
        self.marks = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.samples = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the rows of patterns: the suffix interval [lo, hi) of each."""
        last = patterns[:, -1]
        lo, hi = self.starts[last].copy(), self.starts[last + 1].copy()
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            c = patterns[live, k]
            lo[live] = self.starts[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.starts[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: step back through the text to a sampled position."""
        out = np.full(len(rows), -1, np.int64)
        at, todo, steps = rows.astype(np.int64).copy(), np.arange(len(rows)), 0
        while len(todo):
            m = self.marks[at]
            hit = self.marks[at + 1] > m
            out[todo[hit]] = self.samples[m[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c = self.wavelet.access(at)
                at = self.starts[c] + self.wavelet.rank(c, at)
                steps += 1
        return out
