"""A run-compressed Burrows-Wheeler index of a piece of repetitive text, and matching statistics from it.

Suffixes are sorted once, by prefix doubling in numpy, and the order is let go: what the
index holds is the runs of the transform (symbol and length) and the places of the suffixes
at each run's head and end. A suffix inside a run has the same character before it as its
neighbour above, so stepping back in the text keeps the two neighbours: the neighbour of any
suffix, and the length of its match with it, follow from the last sampled run head before
it. Matching statistics are thus streamed through the text from one run head to the next,
and comparing is done for run heads only. The more repetitive the text, the fewer the runs.
"""

from __future__ import annotations

import numpy as np

from ledgerline.llm.kernels import U64, Rolling, mix64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of small non-negative integers (below 512)."""
    n = len(text)
    wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(6):
        key = (key << 10) | wide[i : n + i]
    span = 6
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(ranked[1:] != ranked[:-1], out=step[1:])
        if step[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = step
        ahead = np.zeros(n, np.int64)
        if span < n:
            ahead[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + ahead
        span *= 2


class RunIndex:
    """Runs of the transform of a text, with the suffix array sampled at their heads and ends."""

    def __init__(self, text: np.ndarray):
        self.text = text
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1].astype(np.int64), -1)
        head = np.ones(len(text), bool)
        head[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], len(text)) - 1
        self.symbols, self.lengths = before[heads], ends - heads + 1
        self.sample_head, self.sample_end = order[heads], order[ends]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of two suffixes, by bisection over rolling hashes of symbols mixed with the next."""
        value = mix64(self.text.astype(U64) + U64(1))
        rolled = Rolling(mix64(value + np.append(value[1:], U64(0)) * U64(3)))
        plain = Rolling(value)
        n = len(self.text)
        low, high = np.zeros(len(a), np.int64), n - np.maximum(a, b)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            pairs = np.maximum(mid - 1, 0)
            same = (plain.ranges(a, a + mid) == plain.ranges(b, b + mid)) & (rolled.ranges(a, a + pairs) == rolled.ranges(b, b + pairs))
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def transform(self) -> np.ndarray:
        """The whole transform: for every suffix in order the symbol before it, -1 before the text."""
        return np.repeat(self.symbols, self.lengths)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position, the suffix sorted before its own (-1 for none), and the length of their match."""
        n = len(self.text)
        place = self.sample_head
        above, length = np.full(len(place), -1), np.zeros(len(place), np.int64)
        # a run head's neighbour is the end of the run before it
        above[1:] = self.sample_end[:-1]
        length[1:] = self._common(place[1:], above[1:])
        by = np.argsort(place)
        place, above, length = place[by], above[by], length[by]
        last = np.searchsorted(place, np.arange(n), "right") - 1
        on = np.arange(n) - place[last]
        neighbour = np.where(above[last] >= 0, above[last] + on, -1)
        return neighbour, np.where(neighbour >= 0, np.maximum(length[last] - on, 0), 0)

    def classes(self, length: int) -> np.ndarray:
        """For every position, the one position that it shares with exactly those whose next ``length`` symbols are the same."""
        neighbour, match = self.matching_statistics()
        to = np.where(match >= length, neighbour, np.arange(len(self.text)))
        while True:
            further = to[to]
            if (further == to).all():
                return to
            to = further
