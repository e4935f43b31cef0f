"""N-best segmentation into SentencePiece pieces, and decoding.

The piece lattice of a text has an arc wherever a stretch of it is a piece. An
arc's score is the logarithm of its piece's probability: as it is in the model
file, or, where the file has ranks only (BPE), by the Zipf-Mandelbrot law of the
rank. Scores are multiples of 2^-20, so that sums are exact. Forward Viterbi
scores are the exact best scores of all beginnings, so the backward A-star search
from the end, which uses them as its heuristic, takes complete segmentations off
its queue in order of score.

No piece crosses from a non-space to a space, nor over a line break, so the
lattice of a text is a chain of the lattices of its words. A-star over a word
gives its N best segmentations, and A-star over the chain, from the last word to
the first, those of the text. Forward and backward Viterbi scores over all words
of a batch at once tell beforehand the best segmentation of each word and the
loss of its second best; only the N - 1 words with the smallest losses can differ
from their best, so the search passes by all others.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, whole_text

SPACE = "▁"
BEST = 4
#: Words whose segmentation a worker remembers.
REMEMBERED = 500_000
#: How much worse than the worst ordinary piece a character without a piece is.
UNKNOWN_LOSS = 10.0
#: Offset of the Zipf-Mandelbrot law, and steps of a score. The offset is the one, of nine from 2.7 (usual for words) to 10^5, by which the best
#: segmentation is the model's own merge order for most words; no sum of scores follows a greedy order everywhere.
OFFSET, STEPS = 60.0, 1 << 20
_WORD = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SEEN_BITS = 22


def _log_probabilities(score: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Scores of a model file as log-probabilities; whole numbers up to 0 are ranks."""
    own = score[ordinary]
    if (own == np.rint(own)).all() and (own <= 0).all():
        weight = 1.0 / (OFFSET - own)
        score = np.full(len(score), -np.inf)
        score[ordinary] = np.log(weight / weight.sum())
    out = np.full(len(score), -np.inf)
    out[ordinary] = np.rint(score[ordinary] * STEPS) / STEPS
    return out


class Lattice:
    """Pieces of a model and the searches over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {model.id_to_piece(i): i for i in ordinary}
        self.score = _log_probabilities(np.array([model.get_score(i) for i in range(n)], np.float64), np.array(ordinary))
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.piece):
            raise ValueError("a piece of this model crosses words")
        self.byte_id = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("this model has no byte pieces")
        self.plain_score = self.score.tolist()
        likely = self.score[ordinary]
        self.unknown = float(likely.min()) - UNKNOWN_LOSS
        self.bytes_of: list[bytes] = [b""] * n
        for p, i in self.piece.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        self.longest = max(map(len, self.piece))
        hashes = np.array([self._hash(p) for p in self.piece], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.piece.values()))[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _SEEN_BITS)] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.best, self.loss = np.zeros(1024), np.zeros(1024)
        self.found: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(_PRIME) & ((1 << 64) - 1)
        return h

    def words(self, text: str) -> list[str]:
        """The text with a space before it, in parts that no piece crosses."""
        return _WORD.findall(" " + text.replace(SPACE, " "))

    def char_ids(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in c.encode("utf-8", "replace"))

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words one after the other: arc start, end, id (-1: a character without a piece), score; each position's word and place in it.

        Words are separated by one node more than they have characters.
        """
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer(("\0".join(words) + "\0").replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        first = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        word = np.repeat(np.arange(len(words)), sizes + 1)
        place = np.arange(len(codes)) - first[word]
        left = sizes[word] - place
        at = np.flatnonzero(left > 0)
        h = np.zeros(len(at), np.uint64)
        alone = np.zeros(len(codes), bool)
        starts, ends, ids = [], [], []
        for n in range(1, self.longest + 1):
            h = (h + codes[at + (n - 1)] + np.uint64(1)) * _PRIME
            maybe = np.flatnonzero(self.seen[h >> np.uint64(64 - _SEEN_BITS)])
            i = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            good = self.hashes[i] == h[maybe]
            s = at[maybe[good]]
            starts.append(s)
            ends.append(s + n)
            ids.append(self.hash_ids[i[good]])
            if n == 1:
                alone[s] = True
                missing = at[~alone[at]]
                starts.append(missing)
                ends.append(missing + 1)
                ids.append(np.full(len(missing), -1))
            more = left[at] > n
            at, h = at[more], h[more]
            if not len(at):
                break
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        order = np.lexsort((start, end))  # of equal scores the longest last piece wins
        start, end, piece = start[order], end[order], piece[order]
        return start, end, piece, np.where(piece < 0, self.unknown, self.score[piece]), word, place

    def learn(self, words: list[str]) -> None:
        """Remember the best segmentation (ids) of each word, its score, and the loss of its second best."""
        words = sorted(words, key=len)
        for lo in range(0, len(words), 8192):
            some = words[lo : lo + 8192]
            parts, best, loss = self._segment(some)
            n = len(self.ids)
            self.known.update(zip(some, range(n, n + len(some)), strict=True))
            self.ids += parts
            if n + len(some) > len(self.best):
                self.best, self.loss = (np.concatenate([x, np.zeros(len(x) + len(some))]) for x in (self.best, self.loss))
            self.best[n : n + len(some)], self.loss[n : n + len(some)] = best, loss

    def _segment(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        start, end, piece, score, word, place = self.arcs(words)
        nodes = len(place)
        forward = np.where(place == 0, 0.0, -np.inf)
        best_arc = np.zeros(nodes, np.int64)
        by_place = np.argsort(place[end], kind="stable")
        bounds = np.searchsorted(place[end][by_place], np.arange(place.max() + 2))
        for k in range(1, int(place.max()) + 1):
            arcs = by_place[bounds[k] : bounds[k + 1]]
            if len(arcs):
                got = forward[start[arcs]] + score[arcs]
                heads = np.flatnonzero(np.r_[True, end[arcs][1:] != end[arcs][:-1]])
                top = np.maximum.reduceat(got, heads)
                forward[end[arcs[heads]]] = top
                counts = np.diff(np.r_[heads, len(arcs)])
                hit = np.flatnonzero(got == np.repeat(top, counts))
                group = np.repeat(np.arange(len(heads)), counts)[hit]
                firsts = hit[np.r_[True, group[1:] != group[:-1]]]
                best_arc[end[arcs[heads]]] = arcs[firsts]
        sizes = np.array([len(w) for w in words])
        last = np.r_[0, np.cumsum(sizes + 1)[:-1]] + sizes
        backward = np.full(nodes, -np.inf)
        backward[last] = 0.0
        order = np.lexsort((start, -place[start]))
        down = place[start][order]
        bounds = np.searchsorted(-down, -np.arange(place.max() + 1)[::-1], side="left")
        bounds = np.r_[bounds, len(order)]
        for b in range(len(bounds) - 1):
            arcs = order[bounds[b] : bounds[b + 1]]
            if len(arcs):
                got = backward[end[arcs]] + score[arcs]
                heads = np.flatnonzero(np.r_[True, start[arcs][1:] != start[arcs][:-1]])
                backward[start[arcs[heads]]] = np.maximum(np.maximum.reduceat(got, heads), backward[start[arcs[heads]]])
        used = np.zeros(len(start), bool)
        at, steps, owners = last.copy(), [], []
        live = np.flatnonzero(place[at] > 0)
        while len(live):
            arcs = best_arc[at[live]]
            steps.append(arcs)
            owners.append(live)
            at[live] = start[arcs]
            live = live[place[at[live]] > 0]
        taken, owner = np.concatenate(steps), np.concatenate(owners)
        used[taken] = True
        through = np.where(used, -np.inf, forward[start] + score + backward[end])
        second = np.full(len(words), -np.inf)
        np.maximum.at(second, word[start], through)
        best = forward[last]
        order = np.lexsort((start[taken], owner))
        taken, owner = taken[order], owner[order]
        ids = piece[taken].astype("<i4")
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        raw, cuts = ids.tobytes(), (bounds * 4).tolist()
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for w in np.unique(owner[ids < 0]).tolist():
            lo, hi, zero = bounds[w], bounds[w + 1], last[w] - sizes[w]
            own = [i for p, s in zip(ids[lo:hi].tolist(), (start[taken[lo:hi]] - zero).tolist(), strict=True) for i in ((p,) if p >= 0 else self.char_ids(words[w][s]))]
            parts[w] = np.array(own, "<i4").tobytes()
        return parts, best, best - second

    def search(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of one word by A-star: score and ids.

        Of equal scores the one with the longer last pieces comes first. An entry
        stands for the paths that end with its arcs, the best of which loses what
        it says, and no two share a path; so as many entries are kept as paths are
        wanted, with longer last pieces first, each linked to the entry before.
        """
        if (text, n) in self.found:
            return self.found[text, n]
        shown, size = text.replace(" ", SPACE), len(text)
        forward = [0.0] + [-np.inf] * size
        into: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(size + 1)]
        for e in range(1, size + 1):
            for s in range(max(0, e - self.longest), e):
                p = self.piece.get(shown[s:e])
                if p is not None:
                    into[e].append((s, (p,), self.plain_score[p]))
                elif s == e - 1:
                    into[e].append((s, self.char_ids(text[s]), self.unknown))
            forward[e] = max(forward[s] + v for s, _, v in into[e])
        # loss, place, score, link (ids of the last arc, link before it)
        queue: list[tuple[float, int, float, tuple | None]] = [(-forward[size], size, 0.0, None)]
        out: list[tuple[float, bytes]] = []
        while queue and len(out) < n:
            i = min(range(len(queue)), key=lambda k: queue[k][0])
            _, at, score, link = queue[i]
            if at == 0:
                own: list[int] = []
                while link is not None:
                    own += link[0]
                    link = link[1]
                out.append((score, np.array(own, "<i4").tobytes()))
                del queue[i]
                continue
            queue[i : i + 1] = [(-(forward[s] + v + score), s, v + score, (ids, link)) for s, ids, v in into[at]]
            if len(queue) > n - len(out):
                kept = sorted(range(len(queue)), key=lambda k: queue[k][0])[: n - len(out)]
                queue = [queue[k] for k in sorted(kept)]
        if len(self.found) > REMEMBERED // 10:
            self.found.clear()
        self.found[text, n] = out
        return out

    def remember(self, texts: list[list[str]]) -> None:
        """Learn the unknown words of some texts; only theirs are at hand then."""
        words = set().union(*texts)
        need = [w for w in words if w not in self.known]  # set difference would go through all that is known
        if len(self.known) + len(need) > REMEMBERED:
            self.forget()
            need = list(words)
        self.learn(need)
        at = np.array(list(map(self.known.__getitem__, words)), np.int64)
        self.near = dict(zip(words, range(len(at)), strict=True))  # far smaller than all that is known, so faster
        self.near_ids = list(map(self.ids.__getitem__, at.tolist()))
        self.near_best, self.near_loss = self.best[at], self.loss[at]

    def n_best(self, words: list[str], n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a whole text, whose words are known.

        Of equal scores the one that differs from the best in fewer words comes
        first, then the one that differs in earlier words.
        """
        at = list(map(self.near.__getitem__, words))
        ids = list(map(self.near_ids.__getitem__, at))
        places = np.array(at)
        total, loss = float(self.near_best[places].sum()), self.near_loss[places]
        near = np.flatnonzero(loss < np.inf)
        if len(near) >= n:
            near = near[loss[near] <= np.partition(loss[near], n - 2)[n - 2]] if n > 1 else near[:0]
            near = np.sort(near[np.argsort(loss[near], kind="stable")[: n - 1]])
        arcs = [self.search(words[i], n) for i in near.tolist()]
        # loss, words that differ, (word, rank) of those; words not yet decided. The heuristic is exact: they can be at their best
        queue: list[tuple[float, int, tuple, int]] = [(0.0, 0, (), len(arcs))]
        out: list[tuple[float, bytes]] = []
        while queue and len(out) < n:
            lost, count, where, left = heapq.heappop(queue)
            if left:
                others = arcs[left - 1]
                for r, (score, _) in enumerate(others):
                    heapq.heappush(queue, (lost + others[0][0] - score, count + (r > 0), ((left - 1, r), *where) if r else where, left - 1))
                continue
            own = list(ids) if where else ids
            for k, r in where:
                own[near[k]] = arcs[k][r][1]
            out.append((total - lost, b"".join(own)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space that encoding puts before it is left out."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


_lattices: dict[str, Lattice] = {}


def lattice(path: str | None = None) -> Lattice:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def _batches(it: Iterator[pd.DataFrame], model: str | None, n: int) -> Iterator[tuple[pd.DataFrame, list[list[tuple[float, bytes]]]]]:
    own = lattice(model)
    for pdf in it:
        for lo in range(0, len(pdf), 64):
            some = pdf.iloc[lo : lo + 64]
            texts = [own.words(t) for t in some["text"]]
            own.remember(texts)
            yield some, [own.n_best(words, n) for words in texts]


def _with_text(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))


def encode(docs: DataFrame, n: int = BEST, model: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, rank, score and ids of the n best segmentations.

    Fewer where a text has fewer; rank 0 is the best. Null text counts as empty,
    whose segmentation is that of the space put before every text.
    """

    def rows(it):
        for some, found in _batches(it, model, n):
            out = [(d, r, s, np.frombuffer(ids, "<i4")) for d, best in zip(some["doc_id"], found, strict=True) for r, (s, ids) in enumerate(best)]
            yield pd.DataFrame(out, columns=["doc_id", "rank", "score", "ids"])

    out = _with_text(docs).mapInPandas(rows, "doc_id string, rank int, score double, ids array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Add the text of ``ids`` as column text; null ids give null."""
    from pyspark.sql.functions import pandas_udf

    def texts(ids: pd.Series) -> pd.Series:
        own = lattice(model)
        return pd.Series([None if x is None else own.decode(np.asarray(x, np.int64)) for x in ids], dtype="object")

    return encoded.withColumn("text", pandas_udf(texts, "string")("ids"))


def encode_and_decode(docs: DataFrame, n: int = BEST, model: str | None = None) -> DataFrame:
    """Digest of the n best segmentations of every row of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_pieces and score (of the best), n_best (how many there
    are), losses (of all, semicolon-joined, against the best), ids_crc32 (of the
    best ids as little-endian 32-bit integers), n_best_crc32 (of all, one after
    the other), decoded_sha256 (of the text decoded from the best) and same
    (whether that is the text; a literal U+2581 decodes to a space). Null
    and empty texts are the lone space put before every text. A null doc_id stays
    null; repeated rows each get a row; an empty table gives an empty result;
    other columns are ignored.
    """
    columns = ["doc_id", "n_pieces", "score", "n_best", "losses", "ids_crc32", "n_best_crc32", "decoded_sha256", "same"]

    def rows(it):
        own = lattice(model)
        for some, found in _batches(it, model, n):
            out = []
            for doc_id, text, best in zip(some["doc_id"], some["text"], found, strict=True):
                decoded = own.decode(np.frombuffer(best[0][1], "<i4"))
                crc = zlib.crc32(best[0][1])
                all_crc = crc
                for _, ids in best[1:]:
                    all_crc = zlib.crc32(ids, all_crc)
                out.append((doc_id, len(best[0][1]) // 4, best[0][0], len(best), ";".join(f"{best[0][0] - s:g}" for s, _ in best), crc, all_crc, hashlib.sha256(decoded.encode()).hexdigest(), decoded == text.replace(SPACE, " ")))
            yield pd.DataFrame(out, columns=columns)

    out = _with_text(docs).mapInPandas(rows, "doc_id string, n_pieces bigint, score double, n_best int, losses string, ids_crc32 bigint, n_best_crc32 bigint, decoded_sha256 string, same boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
