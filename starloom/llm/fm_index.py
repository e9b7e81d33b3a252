"""A compressed FM-index over one shard of word segments, and matching statistics by backward search.

Text is an array of word codes from 1, with 0 behind each segment. The Burrows-Wheeler transform is held in a wavelet
matrix of packed bits. Suffixes are sorted as far as the longest segment reaches, which is exact for any pattern within a
segment. Queries run side by side, one step at a time for all.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class WaveletMatrix:
    """Rank of any symbol over a sequence of non-negative ints below 2**levels."""

    def __init__(self, sequence: np.ndarray, levels: int):
        n = len(sequence)
        self.levels, self.words, self.counts, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32))
            self.zeros.append(n - int(ones.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.base = self._descend(np.zeros(1 << levels, np.int64), np.arange(1 << levels)) if levels <= 22 else None

    def _descend(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = at >> 6
            below = self.words[i][word] & ((U(1) << (at & 63).astype(np.uint64)) - U(1))
            ones = self.counts[i][word] + np.bitwise_count(below)
            up = ((symbols >> (self.levels - 1 - i)) & 1).astype(bool)
            at = np.where(up, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols equal each given symbol."""
        start = self.base[symbols] if self.base is not None else self._descend(np.zeros(len(at), np.int64), symbols)
        return self._descend(at, symbols) - start


def sorted_suffixes(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` words (a power of two), and the common prefix of each with the one before, within segments.

    left[i]: words from i to the end of its segment.
    """
    n = len(text)
    ranks, width = [text.astype(np.int64)], 1
    while width < depth:
        rank = ranks[-1]
        key = rank * (int(rank.max()) + 2)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        ranks.append(rank)
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for rank in reversed(ranks[:-1]):
        width //= 2
        inside = (a < n) & (b < n)
        equal = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        common[equal] += width
        a[equal] += width
        b[equal] += width
    common = np.minimum(common, np.minimum(left[order[:-1]], left[order[1:]]))
    return order, np.concatenate([[0], common]).astype(np.int32)


RMQ_BLOCK = 8
STREAM_WORDS = 1 << 18


class FmIndex:
    """Segments of words with the number of times that each stands in the corpus.

    What is kept: the wavelet matrix of the transform, common prefixes in the smallest integers that hold them with minima
    over blocks of RMQ_BLOCK, and sums of weights. The text itself and its suffixes are not kept.
    """

    def __init__(self, text: np.ndarray, weights: np.ndarray):
        """text: segments of codes from 1, each followed by 0. weights: of each segment."""
        self.n = len(text)
        ends = np.flatnonzero(text == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        segment = np.repeat(np.arange(len(ends)), ends - starts + 1)
        left = ends[segment] - np.arange(self.n)
        longest = int(left.max(initial=1))
        order, lcp = sorted_suffixes(text, left, 1 << longest.bit_length())
        self.lcp = lcp.astype(np.uint8 if longest < 256 else np.uint16 if longest < 65536 else np.uint32)
        self.weight_upto = np.concatenate([[0], np.cumsum(weights[segment[order]])]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])  # suffixes that begin with a smaller code
        self.matrix = WaveletMatrix(text[order - 1], max(1, int(text.max(initial=0)).bit_length()))
        blocks = -(-self.n // RMQ_BLOCK)
        padded = np.zeros(blocks * RMQ_BLOCK, self.lcp.dtype)
        padded[: self.n] = self.lcp
        self._minima = [padded.reshape(blocks, RMQ_BLOCK).min(axis=1)]
        while (1 << len(self._minima)) <= blocks:
            half = 1 << (len(self._minima) - 1)
            self._minima.append(np.minimum(self._minima[-1][:-half], self._minima[-1][half:]))

    def _down(self, low: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The smallest place from which all prefixes up to and with low are depth long or longer."""
        low, active = self._walk(low, depth, -1, RMQ_BLOCK - 1)
        if len(active):
            block, need = low[active] // RMQ_BLOCK, depth[active]
            for level in range(len(self._minima) - 1, -1, -1):
                at = block - (1 << level) + 1
                block = np.where((at >= 0) & (self._minima[level][np.maximum(at, 0)] >= need), block - (1 << level), block)
            low[active] = np.maximum((block + 1) * RMQ_BLOCK - 1, 0)
            low[active], _ = self._walk(low[active], need, -1, None)
        return low

    def _up(self, high: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first place from high on whose prefix is shorter than depth."""
        high, active = self._walk(high, depth, 1, 0)
        if len(active):
            block, need = high[active] // RMQ_BLOCK, depth[active]
            for level in range(len(self._minima) - 1, -1, -1):
                table = self._minima[level]
                block = np.where((block < len(table)) & (table[np.minimum(block, len(table) - 1)] >= need), block + (1 << level), block)
            high[active] = np.minimum(block * RMQ_BLOCK, self.n)
            high[active], _ = self._walk(high[active], need, 1, None)
        return high

    def _walk(self, place: np.ndarray, depth: np.ndarray, way: int, edge: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Steps of one while prefixes are long enough, up to a block's edge, or at most a block without one; and who stands at an edge with a long enough prefix."""
        place = place.copy()
        active = np.arange(len(place))
        waiting = [np.empty(0, np.int64)]
        for _ in range(RMQ_BLOCK):
            at = place[active]
            go = ((at > 0) if way < 0 else (at < self.n)) & (self.lcp[np.minimum(at, self.n - 1)] >= depth[active])
            active, at = active[go], at[go]
            if edge is not None:
                stop = at % RMQ_BLOCK == edge
                waiting.append(active[stop])
                active = active[~stop]
            if not len(active):
                break
            place[active] += way
        return place, np.concatenate(waiting)

    def matching_statistics(self, stream: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place in a stream of texts, how many words from there on (within the text) stand at least ``least`` times in the indexed segments as one run.

        stream: codes as in the index (0 behind each text; a code that the index hasn't is larger than its largest). Texts are
        taken in blocks of about STREAM_WORDS words, those of a block side by side, one step of the backward search at a time.
        """
        found = np.zeros(len(stream), np.int64)
        ends = np.flatnonzero(stream == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        block = starts // STREAM_WORDS
        for first in np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(ends) else ():
            last = np.searchsorted(block, block[first], side="right")
            self._search(stream, starts[first:last], ends[first:last], least, found)
        return found

    def _search(self, stream: np.ndarray, start: np.ndarray, ends: np.ndarray, least: int, found: np.ndarray) -> None:
        at, low, high = ends - 1, np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        length = np.zeros(len(ends), np.int64)
        alive = at >= start
        while True:
            if not alive.all():
                at, low, high, length, start = at[alive], low[alive], high[alive], length[alive], start[alive]
            if not len(at):
                return
            code = stream[at]
            known = code < len(self.before) - 1
            safe = np.where(known, code, 0)
            new_low = self.before[safe] + self.matrix.rank(safe, low)
            new_high = self.before[safe] + self.matrix.rank(safe, high)
            grown = known & (self.weight_upto[new_high] - self.weight_upto[new_low] >= least)
            stuck = ~grown & (length == 0)
            low, high, length = np.where(grown, new_low, low), np.where(grown, new_high, high), length + grown
            found[at[grown]] = length[grown]
            shorten = np.flatnonzero(~grown & ~stuck)
            if len(shorten):
                a, b = low[shorten], high[shorten]
                depth = np.maximum(self.lcp[a], np.where(b < self.n, self.lcp[np.minimum(b, self.n - 1)], 0)).astype(np.int64)
                depth = np.minimum(depth, length[shorten] - 1)
                low[shorten], high[shorten] = self._down(a, depth), self._up(b, depth)
                length[shorten] = depth
                whole = shorten[depth == 0]
                low[whole], high[whole] = 0, self.n
            at = at - (grown | stuck)
            alive = at >= start
