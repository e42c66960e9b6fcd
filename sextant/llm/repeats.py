"""Windows of symbols (bytes or words) that occur more than once in a corpus.

Every window of ``width`` symbols holds an anchor: its ``gram`` of least hash.
Equal windows have equal anchors at equal offsets, so the anchors are a
content-defined cover sample of all positions; only windows around anchors that
occur again are compared at all.

Each value that is hashed is mixed from ``unit`` symbols, so that repetitive
texts cannot make hashes agree, and what decides that windows are equal has 96
bits, from sums over two multipliers.  Words enter with 64 bits each: of windows of
words that differ in words of equal 64 bits alone, nothing tells them apart.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from sextant.llm.kernels import WIDE, in_bounds, mix, mixed_bytes, mixed_pairs, powers, prefix, rolling, sliding, spans

U = np.uint64


class View:
    """Anchors and windows of some texts laid end to end: of bytes, or of 64-bit
    hashes of words."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, width: int, gram: int) -> None:
        n = len(symbols)
        self.width, self.reach, self.first, self.n = width, width - gram + 1, first, n
        #: Symbols in a value: fewer where grams would not hold so many.
        self.unit = 1 if gram < 16 else 8 if symbols.dtype == np.uint8 else 2
        self.values = mixed_bytes(symbols) if self.unit == 8 else mixed_pairs(symbols) if self.unit == 2 else mix(symbols.astype(np.uint64) + U(0x632BE59BD9B4E019))
        self.sums = prefix(self.values)
        self.least = self.anchor = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        if n < width:
            return
        grams = rolling(self.sums, gram - self.unit + 1)[: n - gram + 1] | U(1)
        least = sliding(grams, self.reach, np.minimum)
        least[~in_bounds(first, width, n)[: len(least)]] = 0
        pad = np.zeros(self.reach - 1, np.uint64)
        most = sliding(np.concatenate([pad, least, pad]), self.reach, np.maximum)
        #: Where anchors are; ``least`` has each window's anchor, 0 where a
        #: window would leave its text.
        self.at = np.flatnonzero(grams == most)
        self.anchor = grams[self.at]
        self.least = least

    @cached_property
    def more_sums(self) -> np.ndarray:
        return prefix(self.values, 1)

    def contexts(self) -> np.ndarray:
        """A ``WIDE`` hash, for each anchor, of all windows that can have it: anchors
        with equal contexts have equal windows."""
        text = np.searchsorted(self.first, self.at, "right") - 1
        lo = np.maximum(self.at - self.reach + 1, self.first[text])
        hi = np.minimum(self.at + self.width, self.first[text + 1]) - self.unit + 1
        out = np.empty(len(lo), WIDE)
        out["hi"] = mix(spans(self.sums, lo, hi) + (self.at - lo).astype(np.uint64))
        out["lo"] = mix(spans(self.more_sums, lo, hi, 1) + (self.at - lo).astype(np.uint64)) >> U(32)
        return out

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """For each position, whether its window has one of the chosen anchors."""
        out = np.zeros(len(self.least), bool)
        for part in np.array_split(np.flatnonzero(chosen), max(1, int(chosen.sum()) * self.reach // 500_000)):
            if not len(part):
                continue
            at = self.at[part]
            lo = np.maximum(at - self.reach + 1, 0)
            hi = np.minimum(at, len(self.least) - 1)
            count = np.maximum(hi - lo + 1, 0)
            ends = np.cumsum(count)
            index = np.arange(ends[-1]) + np.repeat(lo - ends + count, count)
            out[index[self.least[index] == np.repeat(self.anchor[part], count)]] = True
        return out

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """``WIDE`` hashes of the windows that start at ``at``."""
        end = at + self.width - self.unit + 1
        out = np.empty(len(at), WIDE)
        out["hi"] = mix((self.sums[end] - self.sums[at]) * powers(len(self.sums))[1][at])
        out["lo"] = mix((self.more_sums[end] - self.more_sums[at]) * powers(len(self.sums), 1)[1][at]) >> U(32)
        return out

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """For each symbol, whether a window that starts at ``starts`` covers it."""
        mark = np.zeros(self.n + 1, np.int32)
        mark[starts] += 1
        mark[starts + self.width] -= 1
        return np.cumsum(mark[: self.n]) > 0
