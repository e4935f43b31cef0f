"""Dependency trees of many lines at once, as flat arrays of parents.

Lines stand one after the other; a token's parent is a place in the same array,
or ``NONE`` at a root. Pointer jumping gives every token its ancestor 1, 2, 4, ...
steps up, all tokens of a batch at each step. A line may be no tree: what leads
into a cycle has no root. Tokens of a cycle are then the roots of what hangs from
them, and the first ancestor that two tokens of different such trees share is the
place where the second one's path enters the cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NONE = -1
#: Pairs of nouns that are made at once.
PAIRS = 1 << 20


def parents(heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of each token's parent, from heads that count a line's tokens from 1; 0, itself and what is out of the line are no parent."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.arange(len(heads)) - first
    some = (heads >= 1) & (heads <= np.repeat(sizes, sizes)) & (heads - 1 != own)
    return np.where(some, first + heads - 1, NONE)


class Forest:
    """Ancestors by pointer jumping; ``parent`` as ``parents`` gives it, no line longer than ``longest``."""

    def __init__(self, parent: np.ndarray, longest: int):
        n = len(parent)
        steps = max(int(longest - 1).bit_length(), 1)
        up = np.append(np.where(parent == NONE, n, parent), n)
        own = self._jumps(up, steps)
        # 2^steps steps up stands the sentinel, or a token of a cycle, and every one of those is stood on
        far = own[-1][own[-1]][:n]
        cyclic = np.zeros(n + 1, bool)
        cyclic[far] = True
        cyclic[n] = False
        self.cycle = np.full(n + 1, NONE)
        if cyclic.any():
            least = np.arange(n + 1)
            for jump in own:
                least = np.minimum(least, least[jump])
            self.cycle[cyclic] = least[cyclic]
            own = self._jumps(np.where(cyclic, n, up), steps)
        self.n, self.up = n, own
        self.depth = np.zeros(n + 1, np.int64)
        self.root = np.arange(n + 1)
        for jump in reversed(own):
            more = jump[self.root] != n
            self.root = np.where(more, jump[self.root], self.root)
        at = np.arange(n + 1)
        for k, jump in reversed(list(enumerate(own))):
            more = jump[at] != n
            self.depth += more.astype(np.int64) << k
            at = np.where(more, jump[at], at)

    @staticmethod
    def _jumps(up: np.ndarray, steps: int) -> list[np.ndarray]:
        out = [up]
        for _ in range(steps - 1):
            out.append(out[-1][out[-1]])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first token on the way up from each of ``b``, itself included, that is also on the way up from that of ``a``; or NONE."""
        root_a, root_b = self.root[a], self.root[b]
        ring_a, ring_b = self.cycle[root_a], self.cycle[root_b]
        across = np.where((ring_a != NONE) & (ring_a == ring_b), root_b, NONE)
        swap = self.depth[a] > self.depth[b]
        high, low = np.where(swap, b, a), np.where(swap, a, b)
        gap = self.depth[low] - self.depth[high]
        for k, jump in enumerate(self.up):
            low = np.where(gap >> k & 1 == 1, jump[low], low)
        for jump in reversed(self.up):
            apart = jump[high] != jump[low]
            high, low = np.where(apart, jump[high], high), np.where(apart, jump[low], low)
        met = np.where(high == low, high, self.up[0][high])
        return np.where(root_a == root_b, met, across)


def pairs(marked: np.ndarray, sizes: np.ndarray, at_once: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of marked tokens of a line, the first one first, some at a time."""
    places = np.flatnonzero(marked)
    line = np.repeat(np.arange(len(sizes)), sizes)[places]
    after = np.bincount(line, minlength=len(sizes))[line] - 1 - (np.arange(len(places)) - np.searchsorted(line, line))
    upto = np.cumsum(after)
    lo = 0
    while lo < len(places):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + at_once, side="right")))
        n = after[lo:hi]
        first = np.repeat(np.arange(lo, hi), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        for k in range(0, len(first), at_once):  # one token alone may have more partners than that
            yield places[first[k : k + at_once]], places[second[k : k + at_once]]
        lo = hi
