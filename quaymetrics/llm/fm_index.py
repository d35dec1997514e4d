"""A compressed FM-index over integer symbols: wavelet ranks, backward search, sampled positions.

Symbol 0 ends every text and is never searched for.
"""

from __future__ import annotations

import numpy as np

from quaymetrics.llm.suffixes import refine


class BitRank:
    """Bits packed in 64s with running counts."""

    def __init__(self, bits: np.ndarray):
        size = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(size, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many bits are set before each i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletRank:
    """Rank of a symbol in a sequence, one bit vector per binary digit of the symbols."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        values = np.asarray(values, np.int64)
        for digit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bits = (values >> digit & 1).astype(bool)
            self.levels.append((digit, BitRank(bits), int(len(bits) - bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])
        symbols = np.arange(n_symbols)
        self.first = self._follow(symbols, np.zeros(n_symbols, np.int64))

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for digit, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> digit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        return self._follow(symbol, i) - self.first[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for digit, bits, zeros in self.levels:
            one, ones = bits.at(i), bits.ones(i)
            symbol |= one.astype(np.int64) << digit
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.first[symbol]


class FmIndex:
    """Index of `symbols`, texts of symbols over 0 that each end in a 0.

    The ends count as different, in the order of the text, so no suffix ties with another beyond
    its own text and the order is whole after as many rounds as the longest text has bits.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8):
        symbols = np.asarray(symbols, np.int64)
        self.n = len(symbols)
        ends = symbols == 0
        n_ends = int(ends.sum())
        self.order, _ = refine(np.where(ends, np.cumsum(ends) - 1, symbols + n_ends - 1), self.n)
        last = symbols[self.order - 1]
        self.wavelet = WaveletRank(last, n_symbols)
        counts = np.bincount(symbols, minlength=n_symbols)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        kept = (self.order % sample == 0) | (last == 0)  # the first of a text has none before it
        self.marked, self.samples = BitRank(kept), self.order[kept]

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.full(n, self.n, np.int64)

    def extend(
        self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffixes that start with symbol and go on in [low, high)."""
        start, n = self.start[symbol], len(symbol)
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return start + both[:n], start + both[n:]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes that start with each pattern stand; patterns end at the right edge."""
        low, high = self.whole(len(patterns))
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            low[live], high[live] = self.extend(patterns[live, -back], low[live], high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the text of places in the order, by steps back to a sampled position."""
        out = np.zeros(len(places), np.int64)
        which, steps = np.arange(len(places)), 0
        while len(which):
            hit = self.marked.at(places)
            out[which[hit]] = self.samples[self.marked.ones(places[hit])] + steps
            which, places = which[~hit], places[~hit]
            symbol, rank = self.wavelet.access(places)
            places = self.start[symbol] + rank
            steps += 1
        return out
