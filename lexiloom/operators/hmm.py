"""Part-of-speech tags by a hidden Markov model that is fitted to the corpus itself.

States are tags, observations symbols: a frequent word as it is written, or else
the class of its shape and ending. Each symbol has a few tags that it can take (a
function word its own, a word in -ing a gerund or a noun), and expectation-
maximisation finds how likely they are, from all lines of all documents: in each
round tasks run forward and backward and add expected counts up, Spark sums those
of all tasks, and the driver divides tables of the model's size. A token with one
tag alone cuts what stands before it from what stands after, so lines fall into
runs between such tokens (``Runs``); alike runs are counted once and stored.
Tags of a line are then the single most likely sequence (Viterbi), of equally
likely ones the one whose last, then last but one, ... tag comes first in TAGS.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, stored

#: Words with a symbol of their own, at most, and rounds of fitting.
VOCABULARY, ROUNDS = 4096, 6
#: Tokens of lines, and runs, that go through the model side by side.
TOGETHER, RUNS_TOGETHER = 1 << 15, 1 << 11
# Tags, and words and endings with the tags that they can take.
TAGS = ("NN", "NNS", "NNP", "VB", "VBD", "VBG", "VBZ", "JJ", "RB", "IN", "DT", "PRP", "CC", "CD", ".")
CLOSED = {
    "DT": "the a an this that these those der die das ein eine le la les un une el los las una",
    "IN": "of in to for with on at by from as into von mit zu für auf aus de en dans pour avec con por para",
    "CC": "and or but nor und oder aber et ou mais y o pero",
    "PRP": "i you he she it we they ich du er sie es wir je tu il elle nous vous yo ella nosotros",
    "VBZ": "is has does ist hat est",
    "VB": "are have do be sind haben sont son",
    "VBD": "was were had did war waren hatte",
    "VBG": "being having",
    "RB": "not nicht never nie pas",
}
ENDINGS = {"ing": ("VBG", "NN"), "ed": ("VBD", "JJ"), "ly": ("RB", "JJ"), "s": ("NNS", "VBZ", "NN"), "": ("NN", "VB", "JJ", "RB")}
#: Pairs of tags that are likelier than others at first.
FOLLOW = ("DT NN", "DT JJ", "DT NNS", "JJ NN", "JJ NNS", "NN VBZ", "NN VBD", "NNS VB", "PRP VB", "PRP VBZ", "PRP VBD", "IN DT", "IN NN", "IN NNP", "VB DT", "VBZ DT", "VBD DT", "VBD IN", "RB VB", "NN IN", "CD NNS", "NN .", "NNS .")
_TOKEN = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{Z}\p{L}\p{M}\p{N}]"
_CLOSED = {word: tag for tag, words in CLOSED.items() for word in words.split()}


def tokens_of(line: Column) -> Column:
    """Words, numbers and single signs of a line."""
    return F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))


@cache
def _pattern(last: int) -> re.Pattern:
    """``tokens_of`` for Python, of texts whose greatest code point is ``last``; ends of lines are tokens too."""
    ranges: dict[str, list[list[int]]] = {k: [] for k in "LNZ"}
    for c in range(last + 1):
        kind = unicodedata.category(chr(c))[0].replace("M", "L")
        if kind in ranges:
            own = ranges[kind]
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            else:
                own.append([c, c])
    word, number, space = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in "LNZ")
    return re.compile(f"[{word}]+(?:['’-][{word}]+)*|[{number}]+(?:[.,][{number}]+)*|[\\r\\n]|[^ \\t\\n\\x0b\\f\\r{space}{word}{number}]")


def tokens_and_ends(text: str) -> list[str]:
    """Tokens of all lines of a text, with the ends of lines between them."""
    beyond = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)  # the longer classes are slower
    return _pattern(0x10FFFF if beyond else 0xFFFF).findall(text)


def shape(word: str) -> str:
    """The class of a word that has no symbol of its own; in angle brackets, which no token has around it."""
    if not word[0].isalnum():
        return "<sign>"
    if word[0].isdigit() or word[0].isnumeric():
        return "<number>"
    low = word.lower()
    for ending, names in _ENDED:
        if low.endswith(ending):
            return names[word[0].isupper()]
    raise AssertionError(word)  # the last ending is empty


SHAPES = ("<sign>", "<number>", *(f"<{c} {e}>" for c in ("capital", "small") for e in ENDINGS))
_ENDED = [(e, (f"<small {e}>", f"<capital {e}>")) for e in ENDINGS]


def tags_of(symbol: str) -> tuple[str, ...]:
    """Tags that a symbol can take."""
    word = symbol.lower()
    if word in _CLOSED:
        return (_CLOSED[word],)
    kind = symbol if symbol in SHAPES else shape(symbol)
    if kind == "<sign>":
        return (".",)
    if kind == "<number>":
        return ("CD",)
    case, ending = re.fullmatch("<(capital|small) (.*)>", kind).groups()
    return ENDINGS[ending] + (("NNP",) if case == "capital" else ())


@dataclass
class Model:
    """Probabilities of first tags, of a tag after a tag, and of a symbol (column) under a tag."""

    symbols: list[str]
    start: np.ndarray
    after: np.ndarray
    emit: np.ndarray
    place: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self):
        self.place = {s: i for i, s in enumerate(self.symbols)}

    def symbol(self, token: str) -> int:
        return self.place[token] if token in self.place else self.place[shape(token)]

    def symbols_of(self, tokens: pa.Array) -> np.ndarray:
        """Numbers of the symbols of tokens; distinct ones are looked up once."""
        coded = tokens.dictionary_encode()
        return np.array([self.symbol(t) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]


def first_model(words: list[tuple[str, int]]) -> Model:
    """Before any fitting: each symbol's tags are equally likely, words as frequent as they are, a shape as all rare words."""
    symbols = [*SHAPES, *(w for w, _ in words if w not in SHAPES)]
    counts = dict(words)
    emit = np.zeros((len(TAGS), len(symbols)))
    for i, s in enumerate(symbols):
        own = tags_of(s)
        for t in own:
            emit[TAGS.index(t), i] = counts.get(s, 1 + sum(counts.values()) / 100) / len(own)
    after = np.ones((len(TAGS), len(TAGS)))
    for pair in FOLLOW:
        a, b = pair.split()
        after[TAGS.index(a), TAGS.index(b)] = 6.0
    none = np.zeros_like(emit)  # of a tag that no symbol can take
    return Model(symbols, np.full(len(TAGS), 1 / len(TAGS)), _shares(after, after), _shares(emit, none))


class Numbered(dict):
    """Numbers of distinct tokens (ends of lines have -1), and with them symbols; for one task, which lets go of them as ``full`` says."""

    def __init__(self, model: Model, most: int = 1 << 19):
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update({"\n": -1, "\r": -1})
        self.words, self._symbols = [], []

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self.words)
        self.words.append(token)
        self._symbols.append(self.model.symbol(token))
        return n

    @property
    def full(self) -> bool:
        return len(self.words) >= self.most

    def lines(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and symbols of tokens without ends of lines, and how many each line has."""
        own = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        ends = np.flatnonzero(own < 0)
        own = own[own >= 0]
        upto = np.append(ends - np.arange(len(ends)), len(own))
        return own, np.array(self._symbols, np.int64)[own] if len(own) else own, np.diff(upto, prepend=0)


def texts_of(batch: pa.RecordBatch, at_once: int = 1 << 21) -> Iterator[str]:
    """Texts of a batch one after the other, about so many characters at a time, each with an end of line; null is empty."""
    held, size = [], 0
    for text in batch.column("text"):
        held.append(text.as_py() or "")
        size += len(held[-1]) + 1
        if size >= at_once:
            yield "\n".join([*held, ""])
            held, size = [], 0
    if held:
        yield "\n".join([*held, ""])


#: Left of a run: a tag, the start of a line, or none (a token with one tag alone); right of it: a tag, or the end.
_START, _ALONE, _END = len(TAGS), len(TAGS) + 1, len(TAGS)


def _alike_lengths(length: np.ndarray) -> Iterator[np.ndarray]:
    """Runs that go side by side: short ones of one length, long ones of like lengths, RUNS_TOGETHER at most."""
    order = np.argsort(length, kind="stable")
    own = length[order]
    lo = 0
    while lo < len(order):
        n = int(own[lo])
        most = n if n <= 12 else n * 4 // 3
        hi = int(np.searchsorted(own, most, side="right"))
        while lo < hi:
            upto = min(lo + min(RUNS_TOGETHER, max(4 * TOGETHER // most, 1)), hi)
            yield order[lo:upto]
            lo = upto


class Runs:
    """Lines as runs of tokens that can have several tags, between those that have one; ``can``: tags (rows) of symbols."""

    def __init__(self, can: np.ndarray):
        self.one = can.sum(axis=0) == 1
        self.tag = np.where(self.one, can.argmax(axis=0), -1)
        self.open = np.flatnonzero(can[:, ~self.one].any(axis=1))  # tags of runs
        self.type = np.int16 if can.shape[1] < 1 << 15 else np.int32

    def of(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Left, right, first token and length of each run, empty ones between two tags included; lines without tokens have none."""
        sizes = sizes[sizes > 0]
        ends = np.cumsum(sizes)
        one = np.flatnonzero(self.one[symbols])
        # cuts: tokens with one tag, and before them the start of each line (as -1); a line ends where the next one starts
        at = np.concatenate([one, ends - sizes])
        order = np.lexsort((np.repeat([1, 0], [len(one), len(sizes)]), at))
        starts = order >= len(one)
        at = at[order]
        left = np.where(starts, _START, self.tag[symbols[np.minimum(at, max(len(symbols) - 1, 0))]])
        first = at + ~starts
        upto = np.append(at[1:], len(symbols))
        right = np.append(np.where(starts[1:], _END, left[1:]), _END)
        return left[: len(at)], right[: len(at)], first, upto - first

    def keys(self, symbols: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Runs as bytes, left, right, symbols; and each token with one tag alone."""
        left, right, first, length = self.of(symbols, sizes)
        alone = symbols[self.one[symbols]]
        each = np.concatenate([length, np.ones(len(alone), np.int64)]) + 2
        starts = np.cumsum(each) - each
        out = np.empty(int(each.sum()), self.type)
        out[starts], out[starts + 1] = np.concatenate([left, np.full(len(alone), _ALONE)]), np.concatenate([right, np.zeros(len(alone), np.int64)])
        inside = np.ones(len(out), bool)
        inside[starts] = inside[starts + 1] = False
        out[inside] = np.concatenate([symbols[~self.one[symbols]], alone])
        offsets = np.append(starts, len(out)) * out.itemsize
        return pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def padded(symbols: np.ndarray, sizes: np.ndarray, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lines of like sizes side by side: their numbers, sizes, and symbols padded with -1; lines without tokens are left out."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and sizes[order[hi]] <= sizes[order[lo]] * 5 // 4 + 4 and (hi + 1 - lo) * sizes[order[hi]] <= together:
            hi += 1
        rows = order[lo:hi]
        n = sizes[rows]
        at = np.arange(n[-1])
        inside = at < n[:, None]
        yield rows, n, np.where(inside, symbols[np.where(inside, first[rows][:, None] + at, 0)], -1)
        lo = hi


class Counts:
    """Expected counts and log-likelihood, added up over lines."""

    def __init__(self, model: Model):
        self.model = model
        self.start, self.after, self.emit = np.zeros_like(model.start), np.zeros_like(model.after), np.zeros_like(model.emit.T)
        self.likelihood = 0.0

    def add(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        for _, n, obs in padded(symbols, sizes):
            self._add(n, obs)

    def _add(self, n: np.ndarray, obs: np.ndarray) -> None:
        m, (rows, length) = self.model, obs.shape
        seen = m.emit.T[np.maximum(obs, 0)]  # rows, places, tags
        alpha, scale = np.zeros((rows, length, len(TAGS))), np.ones((rows, length))
        for t in range(length):
            now = (m.start if t == 0 else alpha[:, t - 1] @ m.after) * seen[:, t]
            inside = t < n
            total = np.where(inside, now.sum(axis=1), 1.0)
            scale[:, t] = total
            alpha[:, t] = np.where(inside[:, None], now / total[:, None], 0.0)
        self.likelihood += float(np.log(scale).sum())
        beta = np.ones((rows, len(TAGS)))
        for t in reversed(range(length)):
            inside = t < n
            alpha[:, t] *= beta  # what each tag is likely to be here; alpha of t is not asked for again
            if t == 0:
                self.start += alpha[:, 0].sum(axis=0)
                break
            back = np.where(inside[:, None], seen[:, t] * beta / scale[:, t][:, None], 0.0)
            self.after += m.after * (alpha[:, t - 1].T @ back)
            beta = np.where(inside[:, None], back @ m.after.T, 1.0)
        inside = np.arange(length) < n[:, None]
        symbols, likely = obs[inside], alpha[inside]
        for tag in range(len(TAGS)):
            self.emit[:, tag] += np.bincount(symbols, weights=likely[:, tag], minlength=len(self.emit))

    def add_runs(self, runs: Runs, keys: pa.Array, n: np.ndarray) -> None:
        """The same from distinct runs and how often each stands in lines."""
        width = np.dtype(runs.type).itemsize
        start, end = (int(np.frombuffer(keys.buffers()[1], np.int32)[i]) for i in (keys.offset, keys.offset + len(keys))) if len(keys) else (0, 0)
        flat = np.frombuffer(keys.buffers()[2], runs.type, (end - start) // width, start) if end > start else np.zeros(0, runs.type)
        each = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64) // width
        first = np.cumsum(each) - each
        left, right = flat[first].astype(np.int64), flat[first + 1].astype(np.int64)
        self._add_alone(left, right, flat[np.minimum(first + 2, max(len(flat) - 1, 0))], each, n)
        some, likely = np.flatnonzero((each > 2) & (left != _ALONE)), []
        for own in _alike_lengths(each[some] - 2):
            rows = some[own]
            longest = int(each[rows].max()) - 2
            at = (first + each)[rows] + np.arange(-longest, 0)[:, None]  # shorter ones have something before their start
            obs = flat[np.maximum(at, 0)].astype(np.int64)
            likely.append((obs.ravel(), self._add_runs(runs.open, left[rows], right[rows], obs, longest - (each[rows] - 2), n[rows].astype(float))))
        if likely:
            symbols = np.concatenate([x for x, _ in likely])
            for i, tag in enumerate(runs.open):
                self.emit[:, tag] += np.bincount(symbols, weights=np.concatenate([x[i] for _, x in likely]), minlength=len(self.emit))

    def _add_alone(self, left: np.ndarray, right: np.ndarray, symbol: np.ndarray, each: np.ndarray, n: np.ndarray) -> None:
        """Tokens with one tag, and pairs of them."""
        m = self.model
        own = left == _ALONE
        times = np.bincount(symbol[own], weights=n[own], minlength=len(m.symbols))
        self.emit += (m.emit.T > 0) * times[:, None]
        with np.errstate(divide="ignore"):
            self.likelihood += float(np.log(m.emit.sum(axis=0))[times > 0] @ times[times > 0])
        own = each == 2
        pairs = np.bincount(left[own] * (_END + 1) + right[own], weights=n[own], minlength=(len(TAGS) + 1) * (_END + 1)).reshape(len(TAGS) + 1, _END + 1)
        told = np.hstack([np.vstack([m.after, m.start]), np.ones((len(TAGS) + 1, 1))])
        self.likelihood += float(np.log(told[pairs > 0]) @ pairs[pairs > 0])
        self.after += pairs[: len(TAGS), : len(TAGS)]
        self.start += pairs[_START, : len(TAGS)]

    def _add_runs(self, tags: np.ndarray, left: np.ndarray, right: np.ndarray, obs: np.ndarray, skip: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Runs ``obs`` (places, rows) of one end; the first ``skip`` places of a row are not its own. How often each place has each tag."""
        m, length, line = self.model, len(obs), np.arange(len(times))
        after = m.after[np.ix_(tags, tags)]
        seen = np.ascontiguousarray(m.emit[tags])[:, obs]  # tags, places, rows
        alpha, scale = np.empty_like(seen), np.empty(obs.shape)
        first = np.vstack([m.after, m.start])[:, tags].T[:, left]
        mixed = bool(skip.any())
        for t in range(length):
            now = first if t == 0 else after.T @ alpha[:, t - 1]
            if mixed:
                now = np.where(t == skip, first, now if t else 0.0)
            now = now * seen[:, t]
            scale[t] = now.sum(axis=0)
            if mixed:
                scale[t][t < skip] = 1.0
            np.divide(now, scale[t], out=alpha[:, t])
        beta = np.hstack([m.after[tags], np.ones((len(tags), 1))])[:, right]
        end = (alpha[:, -1] * beta).sum(axis=0)
        beta = beta / end
        self.likelihood += float(np.log(scale).sum(axis=0) @ times + np.log(end) @ times)
        between = np.zeros_like(after)
        for t in reversed(range(length)):
            last = alpha[:, t - 1] * times if t else None
            alpha[:, t] *= beta
            if t:
                back = seen[:, t] * beta / scale[t]
                between += last @ back.T
                beta = after @ back
                if mixed:
                    beta[:, t <= skip] = 0.0
        self.after[np.ix_(tags, tags)] += after * between
        alpha *= times
        side = np.zeros((len(TAGS) + 1, len(tags)))
        for i, tag in enumerate(tags):
            side[:, i] = np.bincount(left, weights=alpha[i, skip, line], minlength=len(side))
            self.after[tag] += np.bincount(right, weights=alpha[i, -1], minlength=len(side))[: len(TAGS)]
        self.after[:, tags] += side[: len(TAGS)]
        self.start[tags] += side[_START]
        return alpha.reshape(len(tags), -1)

    def rows(self) -> pa.RecordBatch:
        """One row for each count that is not zero: table (0 start, 1 after, 2 emit, 3 log-likelihood), place and value."""
        tables = [self.start, self.after.ravel(), self.emit.ravel(), np.array([self.likelihood])]
        at = [np.flatnonzero(t) for t in tables]
        kinds = np.repeat(np.arange(4), [len(a) for a in at])
        values = np.concatenate([t[a] for t, a in zip(tables, at, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(np.concatenate(at), pa.int64()), pa.array(values, pa.float64())], names=["kind", "at", "value"])


def _shares(counts: np.ndarray, else_: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), else_)


def updated(model: Model, start: np.ndarray, after: np.ndarray, emit: np.ndarray) -> Model:
    """The likeliest model for expected counts; a tag without any keeps what it has."""
    return Model(model.symbols, _shares(start, model.start), _shares(after, model.after), _shares(emit, model.emit))


def _word_counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        for end in "\r\n":
            counts.pop(end, None)
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in texts_of(batch):
            counts.update(tokens_and_ends(text))
            if len(counts) >= most:
                yield rows()
                counts.clear()
    yield rows()


def words_of(sequences: DataFrame, most: int = VOCABULARY) -> list[tuple[str, int]]:
    """The most frequent tokens of ``sequences(tokens)`` or ``(text)`` and their numbers; ties in order of the token."""
    if "text" in sequences.columns:
        counts = sequences.select("text").mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    else:
        counts = sequences.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [(r["word"], r["n"]) for r in counts.orderBy(F.col("n").desc(), "word").limit(most).collect()]  # `most` rows


def lines(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols, and how many each line has, some lines at a time."""
    numbered = Numbered(model)
    for batch in batches:
        if "tokens" in batch.schema.names:
            tokens = batch.column("tokens")
            yield model.symbols_of(tokens.flatten()), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
            continue
        for text in texts_of(batch):
            yield numbered.lines(tokens_and_ends(text))[1:]
            if numbered.full:
                numbered.reset()


def _alike(batches: Iterator[pa.RecordBatch], model: Model, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Distinct runs and how often each stands; a task's alike ones leave it mostly as one."""
    runs, held, rows = Runs(model.emit > 0), [], 0

    def sums() -> pa.Table:
        return pa.concat_tables(held).group_by(["run"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["run", "n"])

    for symbols, sizes in lines(batches, model):
        own = pa.table({"run": runs.keys(symbols, sizes)}).group_by(["run"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["run", "n"])
        held.append(own)
        rows += len(own)
        if rows >= most:
            held = [sums()]
            rows = len(held[0])
            if rows >= most // 2:
                yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                held, rows = [], 0
    if held:
        yield from sums().combine_chunks().to_batches(max_chunksize=1 << 16)


def _expected(batches: Iterator[pa.RecordBatch], model: Model, runs: Runs) -> Iterator[pa.RecordBatch]:
    counts, held, rows = Counts(model), [], 0

    def add() -> None:
        own = pa.Table.from_batches(held)
        counts.add_runs(runs, own["run"].combine_chunks(), own["n"].to_numpy())

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= 1 << 17:
            add()
            held, rows = [], 0
    if held:
        add()
    yield counts.rows()


def fit(sequences: DataFrame, rounds: int = ROUNDS, most: int = VOCABULARY) -> tuple[Model, list[float]]:
    """Fit a model to all of ``sequences(tokens)``, or to all lines of ``(text)``; it, and the log-likelihood before each round.

    Null and empty sequences don't count; without any the first model stays.
    """
    spark = sequences.sparkSession
    model = first_model(words_of(sequences, most))
    runs = Runs(model.emit > 0)
    own = sequences.select("text" if "text" in sequences.columns else "tokens")
    alike = own.mapInArrow(lambda it, m=model: _alike(it, m), "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    numbered, folder = stored(alike, "runs")
    likelihoods = []
    for _ in range(rounds):
        counts = numbered.mapInArrow(lambda it, m=model: _expected(it, m, runs), "kind int, at bigint, value double")
        rows = counts.groupBy("kind", "at").agg(F.sum("value").alias("value")).toArrow()  # as many as the model has probabilities
        kind, at, value = (rows.column(c).to_numpy() for c in ("kind", "at", "value"))
        tables = [np.zeros(model.start.size), np.zeros(model.after.size), np.zeros(model.emit.size), np.zeros(1)]
        for k, table in enumerate(tables):
            table[at[kind == k]] = value[kind == k]
        likelihoods.append(float(tables[3][0]))
        model = updated(model, tables[0], tables[1].reshape(model.after.shape), tables[2].reshape(model.emit.T.shape).T)
    forget(spark, folder)
    return model, likelihoods


def decode(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of each token's tag, lines one after the other."""
    return Decoder(model).tags(symbols, sizes)


class Decoder:
    """Likeliest tags: those of each run follow from the tags beside it, and runs of one length go side by side."""

    def __init__(self, model: Model):
        can = np.zeros(model.emit.shape, bool)
        for i, s in enumerate(model.symbols):
            can[[TAGS.index(t) for t in tags_of(s)], i] = True
        self.runs = Runs(can)
        tags, tiny = self.runs.open, 1e-300  # what was never seen stays possible, but below all else
        with np.errstate(divide="ignore"):
            start, after = np.log(model.start + tiny), np.log(model.after + tiny)
            self.emit = np.where(can, np.log(model.emit + tiny), -np.inf)[tags]
        self.after = after[np.ix_(tags, tags)]
        self.before = np.vstack([after, start])[:, tags].T
        self.behind = np.hstack([after[tags], np.zeros((len(tags), 1))])

    def tags(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = self.runs.tag[symbols]
        left, right, first, length = self.runs.of(symbols, sizes)
        some = np.flatnonzero(length)
        for own in _alike_lengths(length[some]):
            rows = some[own]
            longest = int(length[rows].max())
            at = (first + length)[rows] + np.arange(-longest, 0)[:, None]  # shorter ones have something before their start
            skip = longest - length[rows]
            tags = self.runs.open[self._best(symbols[np.maximum(at, 0)], left[rows], right[rows], skip)]
            inside = np.arange(longest)[:, None] >= skip
            out[at[inside]] = tags[inside]
        return out

    def _best(self, obs: np.ndarray, left: np.ndarray, right: np.ndarray, skip: np.ndarray) -> np.ndarray:
        n, rows = obs.shape
        first = self.before[:, left]
        mixed = bool(skip.any())
        best = first + self.emit[:, obs[0]]
        came = np.zeros((n, *best.shape), np.int8)
        for t in range(1, n):
            most = best[0] + self.after[0][:, None]
            for a in range(1, len(best)):
                now = best[a] + self.after[a][:, None]
                np.copyto(came[t], a, where=now > most)
                np.maximum(most, now, out=most)
            best = (np.where(t <= skip, first, most) if mixed else most) + self.emit[:, obs[t]]
        out = np.empty((n, rows), np.int64)
        out[-1] = (best + self.behind[:, right]).argmax(axis=0)
        line = np.arange(rows)
        for t in range(n - 1, 0, -1):
            out[t - 1] = came[t, out[t], line]
        return out
