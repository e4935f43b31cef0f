"""Charts over tagged sentences: weighted CKY for constituents, Eisner's for dependencies.

Sentences of one length are parsed side by side; a chart's cells of one span
length are an array over sentences and places. Both find the single best parse:
of equal ones that whose split comes first, and of those the rule that stands
first. Charts hold weights alone; which split and rule a weight comes from is
found again for the cells of the best trees, which are few, all sentences at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .hmm import TAGS

# Phrases, and rules with weights (a higher one is better): phrase from a tag, phrase from two parts.
PHRASES = ("S", "NP", "NB", "VP", "PP", "ADJP", "ADVP", "CNP", "CVP", "CS")
LEXICAL = "NP NN -1.0;NP NNS -0.8;NP NNP -0.3;NP PRP 0;NP CD -1.2;NP VBG -2.5;NB NN 0;NB NNS 0;NB NNP -0.2;NB VBG -2;VP VB -0.4;VP VBD -0.4;VP VBZ -0.4;VP VBG -1;ADJP JJ -0.2;ADVP RB -0.2"
BINARY = (
    "S NP VP 0;S PP S -0.8;S ADVP S -0.6;S S . -0.1;S . S -1.5;S S CS -0.7;CS CC S 0;"
    "NP DT NB 0;NP CD NB -0.2;NP JJ NB -0.7;NP NB NB -1.1;NP NP PP -0.6;NP NP CNP -0.5;CNP CC NP 0;CNP . NP -1.2;NP NP . -1.4;"
    "NB JJ NB -0.3;NB NB NB -0.9;NB RB NB -1.6;"
    "VP VB NP -0.2;VP VBD NP -0.2;VP VBZ NP -0.2;VP VBG NP -0.4;VP VBZ ADJP -0.3;VP VB ADJP -0.4;VP VBD ADJP -0.4;VP VBZ VBG -0.6;VP VBD VBG -0.8;VP VB VP -0.9;"
    "VP VP PP -0.4;VP VP ADVP -0.5;VP ADVP VP -0.5;VP VP CVP -0.6;CVP CC VP 0;VP VP . -1.2;VP VP NP -1.5;VP VB S -1.1;VP VBD S -1.1;VP VBZ S -1.1;"
    "PP IN NP 0;PP IN VP -1.5;PP IN PP -1.8;ADJP RB ADJP -0.4;ADJP ADJP CC -2.5;ADJP ADJP ADJP -1.6;ADVP RB ADVP -0.6;ADVP ADVP . -1.8"
)
ROOTS = {"S": 0.0, "VP": -2.0, "NP": -3.0, "PP": -4.0, "ADJP": -5.0, "ADVP": -5.0}
#: A sentence without a derivation, and the weight of each of its parts.
FRAGMENT, PART = "FRAG", -5.0
#: Phrases that only help to keep rules binary.
_HELPERS = ("CNP", "CVP", "CS")
#: Sentences are parsed in pieces of so many tokens, as a chart's work grows with the cube of its length.
LONGEST = 40

SYMBOLS = (*TAGS, *PHRASES)
#: Weights are whole tenths where they can be; this is below all that a piece can have, and twice it is still a 16-bit number.
_UNIT, _NONE = 10, -12000


class Grammar:
    """Rules by numbers of symbols; ``lexical``: weight of each phrase from each tag, ``roots``: of a whole sentence as a phrase."""

    def __init__(self, lexical: str = LEXICAL, binary: str = BINARY, roots: dict[str, float] | None = None):
        at = {s: i for i, s in enumerate(SYMBOLS)}
        self.lexical = np.full((len(TAGS), len(SYMBOLS)), -np.inf)
        self.lexical[np.arange(len(TAGS)), np.arange(len(TAGS))] = 0.0
        for phrase, tag, weight in (r.split() for r in lexical.split(";")):
            self.lexical[at[tag], at[phrase]] = float(weight)
        rules = sorted((r.split() for r in binary.split(";")), key=lambda r: at[r[0]])  # those of one phrase side by side, in their order
        self.whole, self.left, self.right = (np.array([at[r[i]] for r in rules]) for i in range(3))
        self.weight = np.array([float(r[3]) for r in rules])
        self.phrases, self.starts = np.unique(self.whole, return_index=True)
        # what no rule makes stands over one token alone, so that a rule with such a part has one split
        made = np.isin(np.arange(len(SYMBOLS)), self.whole)
        self.first = np.flatnonzero(~made[self.left])
        self.last = np.flatnonzero(made[self.left] & ~made[self.right])
        self.free = np.flatnonzero(made[self.left] & made[self.right])
        self.roots = np.full(len(SYMBOLS), -np.inf)
        for phrase, weight in (ROOTS if roots is None else roots).items():
            self.roots[at[phrase]] = weight
        own = np.concatenate([t[t > -np.inf] for t in (self.lexical, self.roots, self.weight)])
        if (own > 0).any() or not np.allclose(own * _UNIT, np.round(own * _UNIT)):
            raise ValueError("weights are whole tenths, at most 0")
        self.least = min(float(own.min()), PART)
        # rules of each symbol (column) by kind, filled up with one that never holds
        none = len(self.weight)
        self.kinds = []
        for kind in (self.first, self.last, self.free):
            each = [kind[self.whole[kind] == s] for s in range(len(SYMBOLS))]
            table = np.full((max(map(len, each)), len(SYMBOLS)), none)
            for s, r in enumerate(each):
                table[: len(r), s] = r
            self.kinds.append(table)

    def numbers(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """lexical, weight and roots in the type of a chart of n tokens, and what stands for none in it."""
        none, kind = (_NONE, np.int16) if -3 * n * self.least * _UNIT < -_NONE else (-(1 << 29), np.int32)
        return *(np.maximum(np.round(t * _UNIT), none).astype(kind) for t in (self.lexical, self.weight, self.roots)), none


def side_by_side(n: int) -> int:
    """How many sentences of n tokens are parsed at once: charts of some megabytes."""
    return int(min(max((1 << 19) // (n * n), 64), 1024))


@cache
def grammar() -> Grammar:
    return Grammar()


def constituents(tags: np.ndarray, g: Grammar | None = None) -> list[tuple[float, tuple | None]]:
    """The best tree of each row of tags (sentences of one length) and its weight.

    A tree is (symbol, place) over one token or (symbol, left, right). Where no
    rule of the roots derives the whole sentence it is (FRAGMENT, parts): the
    phrases and tokens next to each other that have the most weight, each of them
    for ``PART``; of equal covers the one whose last part is longest, and so on.
    """
    g = g or grammar()
    rows, n = tags.shape
    lexical, weight, roots, none = g.numbers(n)
    chart = np.full((n + 1, len(SYMBOLS), n, rows), none, lexical.dtype)  # by length, symbol, place, row
    chart[1] = lexical[tags].transpose(2, 1, 0)
    left, right = {1: chart[1][g.left[g.free]]}, {1: chart[1][g.right[g.free]]}
    for length in range(2, n + 1):
        places = n - length + 1
        top = np.empty((len(weight), places, rows), chart.dtype)
        top[g.first] = chart[1][g.left[g.first], :places] + chart[length - 1][g.right[g.first], 1 : 1 + places]
        top[g.last] = chart[length - 1][g.left[g.last], :places] + chart[1][g.right[g.last], length - 1 : length - 1 + places]
        most = left[1][:, :places] + right[length - 1][:, 1 : 1 + places]
        now = np.empty_like(most)
        for k in range(2, length):
            np.add(left[k][:, :places], right[length - k][:, k : k + places], out=now)
            np.maximum(most, now, out=most)
        top[g.free] = most
        top += weight[:, None, None]
        own = chart[length][:, :places]
        for phrase, lo, hi in zip(g.phrases, g.starts, [*g.starts[1:], len(top)]):
            np.maximum(top[lo:hi].max(axis=0), none, out=own[phrase])  # weights are no gains, so below none is none
        left[length], right[length] = own[g.left[g.free]], own[g.right[g.free]]
    whole = chart[n, :, 0, :].T.astype(np.int64) + roots
    symbols = whole.argmax(axis=1)
    derived = whole.max(axis=1) > none
    rest = np.flatnonzero(~derived)
    tops = [(int(r), n, 0) for r in np.flatnonzero(derived)]
    out: list = [None] * rows
    parts_of, weights = {}, whole.max(axis=1) / _UNIT
    if len(rest):  # all covers at once: the most that one phrase or token over each span has, then the best way to each end
        reached, last = np.zeros((n + 1, len(rest)), np.int64), np.zeros((n + 1, len(rest)), np.int64)
        peak = chart.max(axis=1)[:, :, rest].astype(np.int64)  # by length, place
        for end in range(1, n + 1):
            start = np.arange(end)
            ways = reached[:end] + peak[end - start, start] + round(PART * _UNIT)
            last[end], reached[end] = ways.argmax(axis=0), ways.max(axis=0)
        weights[rest] = reached[n] / _UNIT
        for row, starts in zip(rest.tolist(), last.T.tolist(), strict=True):
            end, own = n, []
            while end:
                own.append((row, end - starts[end], starts[end]))
                end = starts[end]
            parts_of[row] = range(len(tops), len(tops) + len(own))
            tops += reversed(own)
    row, length, place = np.array(tops).T
    symbol = chart[length, :, place, row].astype(np.int64)
    symbol[: len(tops) - sum(map(len, parts_of.values()))] += roots
    trees = _trees(chart, g, weight, row, length, place, symbol.argmax(axis=1))
    for i, r in enumerate(np.flatnonzero(derived).tolist()):
        out[r] = float(weights[r]), trees[i]
    for r, own in parts_of.items():
        out[r] = float(weights[r]), (FRAGMENT, *(trees[i] for i in own))
    return out


def _trees(chart: np.ndarray, g: Grammar, weight: np.ndarray, row: np.ndarray, length: np.ndarray, place: np.ndarray, symbol: np.ndarray) -> list[tuple]:
    """The best tree of each cell: cells of one step down at once, then trees put together from below."""
    _, symbols, n, rows = chart.shape
    cells, left, right, cost = chart.ravel(), np.append(g.left, 0), np.append(g.right, 0), np.append(weight.astype(np.int64), -(1 << 30))

    def weighed(rule: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The most of some ways (axes before the last) to make each cell, and of equal ones that with the first split and rule: weight, split and rule in one number."""
        one = ((k * symbols + left[rule]) * n + at_place) * rows + at_row
        two = (((size - k) * symbols + right[rule]) * n + at_place + k) * rows + at_row
        key = ((cells[one].astype(np.int64) + cells[two] + cost[rule]) << 20) - (k << 10) - rule
        return key.reshape(-1, key.shape[-1]).max(axis=0)

    steps = []  # of each step's cells: symbol, place, and the numbers of their parts in the next step's (-1: over one token)
    while len(row):
        some = np.flatnonzero(length > 1)
        lower = np.full((2, len(row)), -1)
        lower[0, some], lower[1, some] = np.arange(len(some)), len(some) + np.arange(len(some))
        steps.append((symbol, place, lower))
        at_row, size, at_place, own = row[some], length[some], place[some], symbol[some]
        if not len(some):
            break
        first, last, free = (kind[:, own] for kind in g.kinds)
        splits = np.minimum(np.arange(1, int(size.max()))[:, None, None], size - 1)  # the last one again changes nothing
        best = np.maximum(np.maximum(weighed(first, np.ones_like(first)), weighed(last, np.broadcast_to(size - 1, last.shape))), weighed(free[None], splits))
        code = -best & (1 << 20) - 1
        split, rule = code >> 10, code & (1 << 10) - 1
        row, length, place, symbol = (np.concatenate(x) for x in ((at_row, at_row), (split, size - split), (at_place, at_place + split), (g.left[rule], g.right[rule])))
    trees: list[tuple] = []
    for symbol, place, lower in reversed(steps):
        trees = [(SYMBOLS[s], p) if a < 0 else (SYMBOLS[s], trees[a], trees[b]) for s, p, a, b in zip(symbol.tolist(), place.tolist(), *lower.tolist(), strict=True)]
    return trees


def bracketed(tree: tuple, words: list[str], tags: list[str]) -> str:
    """A tree in brackets, helpers spliced into what holds them."""
    leaf = lambda i: f"({tags[i]} {words[i]})"

    def parts(node: tuple, within: str) -> list[str]:
        symbol = "NP" if node[0] == "NB" else node[0]
        if isinstance(node[1], int):
            return [leaf(node[1])] if symbol in TAGS or symbol == within else [f"({symbol} {leaf(node[1])})"]
        own = [x for child in node[1:] for x in parts(child, symbol)]
        return own if node[0] in _HELPERS or (node[0] == "NB" and within == "NP") else [f"({symbol} {' '.join(own)})"]

    return " ".join(parts(tree, ""))


def dependencies(weights: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head of each word (-1: the root's) in the best projective tree of each sentence, and the tree's weight.

    ``weights``: rows, head, word; ``root``: rows, word. One word hangs from the
    root. Complete spans end in words that have all of their own on that side,
    incomplete ones are held together by the arc between their ends.
    """
    rows, n, _ = weights.shape
    # by kind, gap between a span's ends, first place and row; kinds: 0 complete with the head at the right end, 1 at the left end, 2 and 3 incomplete likewise
    cells = np.zeros((4, n, n, rows))
    arcs = np.ascontiguousarray(weights.transpose(1, 2, 0))
    line = np.arange(n)

    def most(one: int, two: int, gap: int, first: int, less: int) -> np.ndarray:
        """The best of all splits of a span, by kinds of its parts."""
        places, out, now = n - gap, None, None
        for k in range(first, gap + first):
            own = cells[one, k, :places], cells[two, gap - less - k, k + less : k + less + places]
            if out is None:
                out = np.add(*own)
                now = np.empty_like(out)
            else:
                np.maximum(out, np.add(*own, out=now), out=out)
        return out

    for gap in range(1, n):
        i, j = line[: n - gap], line[gap:]
        inner = most(1, 0, gap, 0, 1)
        cells[2, gap, : n - gap], cells[3, gap, : n - gap] = inner + arcs[j, i], inner + arcs[i, j]
        cells[0, gap, : n - gap], cells[1, gap, : n - gap] = most(0, 2, gap, 0, 0), most(3, 1, gap, 1, 0)
    whole = np.stack([cells[0, r, 0] + cells[1, n - 1 - r, r] + root[:, r] for r in range(n)], axis=1)
    tops = whole.argmax(axis=1)
    heads, flat = np.full((rows, n), -1), cells.ravel()
    every = np.arange(rows)
    row, first, gap, kind = np.tile(every, 2), np.concatenate([np.zeros(rows, np.int64), tops]), np.concatenate([tops, n - 1 - tops]), np.repeat([0, 1], rows)
    parts = np.array([[0, 3, 1, 1], [2, 1, 0, 0]])
    while True:  # splits of all spans of the best trees, found again from the top down
        some = gap > 0
        row, first, gap, kind = row[some], first[some], gap[some], kind[some]
        if not len(row):
            return heads, whole.max(axis=1)
        arc, left = kind >= 2, kind == 2
        heads[row[arc], (first + np.where(left, 0, gap))[arc]] = (first + np.where(left, gap, 0))[arc]
        less, (one, two) = arc.astype(np.int64), parts[:, kind]
        k = (kind == 1) + np.minimum(np.arange(int(gap.max()))[:, None], gap - 1)  # the last one again changes nothing
        ways = flat[((one * n + k) * n + first) * rows + row] + flat[((two * n + gap - less - k) * n + first + k + less) * rows + row]
        k = k[ways.argmax(axis=0), np.arange(len(row))]
        row, first, gap, kind = np.tile(row, 2), np.concatenate([first, first + k + less]), np.concatenate([k, gap - less - k]), np.concatenate([one, two])
