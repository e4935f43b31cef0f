"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours differ in few
bits. Runs of neighbours with a common prefix become leaves, leaves buckets,
buckets chunks, chunks groups, groups the root; every node keeps the bits that
all fingerprints below it share (mask and pattern). The index is joined with
itself from the root down: a pair of nodes adds the differences in newly shared
bits to those counted above, and goes with all that is below it once they are too
many. Members of leaves that are left are compared one by one, and each
comparison hands on only a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, cut, whole_text
from .components import components

WIDTH = 3
DISTANCE = 2
SEED = 42
#: Fingerprints of a leaf, a bucket and a chunk at most; partitions of a group.
LEAF, BUCKET, CHUNK, GROUP = 64, 4096, 1 << 20, 256
#: Pairs of leaves compared at once, links held before they are reduced to a forest.
_TOGETHER, _HELD = 64, 1 << 20
#: Pairs of buckets for each task, and tasks, at most.
_PAIRS, _TASKS = 16, 100_000
_SHINGLES = 1 << 15


def fingerprint_bytes(raw: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of UTF-8 bytes as a signed integer; no words give zero."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
        total = len(words) - width + 1
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for start in range(0, total, _SHINGLES):
        packed = b"".join([digest(next(grams), SEED) for _ in range(min(_SHINGLES, total - start))])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > total).view(">i8")[0])


def _fingerprints(raw: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_bytes(x) for x in raw], dtype="int64")


def fingerprint(text: Column) -> Column:
    """SimHash of a text column; null counts as empty."""
    return pandas_udf(_fingerprints, "bigint")(F.coalesce(text, F.lit("")).cast("binary"))


def _gray_rank(fp: Column) -> Column:
    """Place of a code word in Gray order, flipped to sort as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _rank_of(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _runs(rank: np.ndarray, lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """The longest runs of at most ``size`` ascending ranks that are all of one prefix."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            out.append((lo, hi))
            continue
        bit = int(rank[lo] ^ rank[hi - 1]).bit_length() - 1
        half = np.uint64((int(rank[lo]) >> bit | 1) << bit)
        middle = lo + int(np.searchsorted(rank[lo:hi], half))
        todo += [(middle, hi), (lo, middle)]
    return out


def _shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of codes the bits that all of it share (mask) and what they are (pattern)."""
    ones, any_ = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    mask = ~(ones ^ any_)
    return mask, ones & mask


_TREE = "level int, id bigint, parent bigint, mask bigint, pattern bigint, members array<bigint>, starts array<int>, masks array<bigint>, patterns array<bigint>"
_TREE_COLUMNS = [c.split()[0] for c in _TREE.split(", ")]


def _subtrees(batches: Iterator[pd.DataFrame], bucket: int = BUCKET, chunk: int = CHUNK, leaf: int = LEAF) -> Iterator[pd.DataFrame]:
    """Chunks (level 1) and their buckets (level 0) of one partition in Gray order.

    A bucket also has its leaves: where each starts, its mask and its pattern. At
    most ``chunk`` codes and a batch are held.
    """
    part = TaskContext.get().partitionId()
    ident = part << 36

    def subtree(codes: np.ndarray) -> pd.DataFrame:
        nonlocal ident
        rank, signed = _rank_of(codes), codes.view(np.int64)
        ident += 1
        root, rows = ident, []
        for lo, hi in _runs(rank, 0, len(codes), bucket):
            ident += 1
            starts = np.array([at for at, _ in _runs(rank, lo, hi, leaf)]) - lo
            masks, patterns = _shared(codes[lo:hi], starts)
            (mask,), (pattern,) = _shared(codes[lo:hi], np.array([0]))
            rows.append((0, ident, root, int(mask.view(np.int64)), int(pattern.view(np.int64)), signed[lo:hi], starts.astype(np.int32), masks.view(np.int64), patterns.view(np.int64)))
        (mask,), (pattern,) = _shared(codes, np.array([0]))
        rows.append((1, root, part // GROUP, int(mask.view(np.int64)), int(pattern.view(np.int64)), None, None, None, None))
        return pd.DataFrame(rows, columns=_TREE_COLUMNS)

    held = np.zeros(0, np.uint64)
    for pdf in batches:
        held = np.concatenate([held, pdf["fp"].to_numpy(np.int64).view(np.uint64)])
        if len(held) > chunk:
            *full, (last, _) = _runs(_rank_of(held), 0, len(held), chunk)
            for lo, hi in full:
                yield subtree(held[lo:hi])
            held = held[last:]
    if len(held):
        yield subtree(held)


def _above(nodes: DataFrame, level: int, parent: Column) -> DataFrame:
    """The nodes over ``nodes``, by their parents, with what all of them share."""
    ones, any_, mask = F.bit_and("pattern"), F.bit_or("pattern"), F.bit_and("mask")
    up = nodes.groupBy(F.col("parent").alias("id")).agg(mask.bitwiseAND(F.bitwise_not(ones.bitwiseXOR(any_))).alias("mask"), ones.alias("ones"))
    return up.select(F.lit(level).alias("level"), "id", parent.alias("parent"), "mask", F.col("ones").bitwiseAND(F.col("mask")).alias("pattern"))


def tree(fingerprints: DataFrame, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """``fp`` (distinct) -> nodes of the index: root (level 3), groups, chunks, buckets (level 0).

    A chunk belongs to one partition of the Gray order, a group to ``GROUP``
    partitions that follow each other. Each node has the bits that all
    fingerprints below it share; what its parent shares is among them.
    """
    ordered = fingerprints.select("fp", _gray_rank(F.col("fp")).alias("rank")).repartitionByRange("rank").sortWithinPartitions("rank").select("fp")
    local = cut(ordered.mapInPandas(lambda it: _subtrees(it, bucket, chunk), _TREE))
    groups = _above(local.where("level = 1"), 2, F.lit(0).cast("bigint"))
    root = _above(groups, 3, F.lit(None).cast("bigint"))
    return cut(local.unionByName(groups.unionByName(root), allowMissingColumns=True))


def descend(nodes: DataFrame, distance: int = DISTANCE, levels: int = 3) -> DataFrame:
    """Pairs ``(l, r)`` of nodes ``levels`` below the root that the index can't rule out.

    A pair carries the bits that both sides share (``done``) and in how many of
    them they differ (``apart``). Of a pair of children only bits that are newly
    shared are compared, and their differences added; a pair that differs too
    often goes with everything below it.
    """
    pairs = nodes.where("level = 3").select(F.col("id").alias("l"), F.col("id").alias("r"), F.col("mask").alias("done"), F.lit(0).alias("apart"))
    for level in range(2, 2 - levels, -1):
        below = nodes.where(F.col("level") == level).select("id", "parent", "mask", "pattern")
        left = below.select(F.col("parent").alias("l"), F.col("id").alias("l_id"), F.col("mask").alias("l_mask"), F.col("pattern").alias("l_pattern"))
        right = below.select(F.col("parent").alias("r"), F.col("id").alias("r_id"), F.col("mask").alias("r_mask"), F.col("pattern").alias("r_pattern"))
        both = F.col("l_mask").bitwiseAND(F.col("r_mask"))
        more = F.bit_count(F.col("l_pattern").bitwiseXOR(F.col("r_pattern")).bitwiseAND(both).bitwiseAND(F.bitwise_not("done")))
        pairs = (
            pairs.join(left, "l")
            .join(right, "r")
            .where(((F.col("l") < F.col("r")) | (F.col("l_id") <= F.col("r_id"))) & (F.col("apart") + more <= distance))
            .select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), both.alias("done"), (F.col("apart") + more).alias("apart"))
        )
    return pairs


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of the component of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        if (a == b).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


class _Leaves:
    """The leaves of a bucket as rows of one width; a short leaf repeats its last member."""

    def __init__(self, members, starts, masks, patterns):
        self.codes = np.asarray(members, np.int64).view(np.uint64)
        starts = np.asarray(starts, np.int64)
        ends = np.r_[starts[1:], len(self.codes)]
        self.at = np.minimum(starts[:, None] + np.arange((ends - starts).max()), ends[:, None] - 1)
        self.rows = self.codes[self.at]
        self.masks, self.patterns = (np.asarray(x, np.int64).view(np.uint64) for x in (masks, patterns))


def linked(left: _Leaves, right: _Leaves, same: bool, distance: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of linked members of two buckets (or twice one), and how many pairs of leaves were compared.

    Links are reduced to a spanning forest on the way, places of the right
    bucket following those of the left.
    """
    shared = left.masks[:, None] & right.masks[None, :]
    near = np.bitwise_count((left.patterns[:, None] ^ right.patterns[None, :]) & shared) <= distance
    li, ri = np.nonzero(np.triu(near) if same else near)
    base = 0 if same else len(left.codes)
    total = base + len(right.codes)
    us, vs, held = [], [], 0
    for lo in range(0, len(li), _TOGETHER):
        l, r = li[lo : lo + _TOGETHER], ri[lo : lo + _TOGETHER]
        pair, i, j = np.nonzero(np.bitwise_count(left.rows[l][:, :, None] ^ right.rows[r][:, None, :]) <= distance)
        us.append(left.at[l[pair], i])
        vs.append(base + right.at[r[pair], j])
        held += len(pair)
        if held > _HELD:
            label = _forest(total, np.concatenate(us), np.concatenate(vs))
            us, vs, held = [np.arange(total)], [label], 0
    label = _forest(total, np.concatenate(us), np.concatenate(vs)) if us else np.arange(total)
    tied = np.flatnonzero(label != np.arange(total))
    return tied, label[tied], len(li)


_SIDE = ("members", "starts", "masks", "patterns")


def _links_of_pairs(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            left = _Leaves(*(getattr(row, f"l_{c}") for c in _SIDE))
            same = row.l == row.r
            right = left if same else _Leaves(*(getattr(row, f"r_{c}") for c in _SIDE))
            u, v, _ = linked(left, right, same, distance)
            codes = (left.codes if same else np.concatenate([left.codes, right.codes])).view(np.int64)
            yield pd.DataFrame({"u": codes[u], "v": codes[v]})


def links(fingerprints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """``fp`` (distinct) -> ``(u, v)``: links that connect what is in reach.

    The links span every component of the graph "at most ``distance`` bits
    apart", and no more; u and v themselves can be further apart.
    """
    nodes = tree(fingerprints, bucket, chunk)
    pairs = cut(descend(nodes, distance).select("l", "r"))
    buckets = nodes.where("level = 0")
    left = buckets.select(F.col("id").alias("l"), *[F.col(c).alias(f"l_{c}") for c in _SIDE])
    right = buckets.select(F.col("id").alias("r"), *[F.col(c).alias(f"r_{c}") for c in _SIDE])
    tasks = min(max(pairs.count() // _PAIRS, 1), _TASKS)
    # a number, as adaptive execution would go by bytes, which tell little of the work
    both = pairs.join(left, "l").join(right, "r").repartition(tasks, "l", "r")
    return both.mapInPandas(lambda it: _links_of_pairs(it, distance), "u bigint, v bigint")


def _placed(docs: DataFrame, distance: int) -> DataFrame:
    """doc_id, text_hash and fp of every row, with its class (root, component_id)."""
    bounded_batches(docs.sparkSession)
    marked = cut(docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), fingerprint(F.col("text")).alias("fp")))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("fp"), distance))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(placed.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Fingerprint and component of every row of ``docs(doc_id, text, ...)``.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest
    doc_id in reach over links of at most ``distance`` differing bits. Null text
    counts as empty; texts without words have fingerprint zero and link like any
    other. A null doc_id takes part but never names a component, unless all ids
    of the component are null (then null). Repeated rows each get a row; an empty
    table gives an empty one; other columns are ignored.
    """
    return _placed(docs, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns.

    It is the row with the smallest doc_id; where texts repeat that id, the one
    with the smallest hash; where a component has null ids only, one of those.
    Rows that repeat both id and text are reduced to any one of them. Other
    columns may have any names. Null and empty texts have fingerprint zero and are
    linked like others; an empty table stays empty. Rows are chosen on ids and
    hashes alone, so that texts are shuffled once.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("first")
    key = [F.col("first.unknown").alias("unknown"), F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("id"), F.col("first.text_hash").alias("hash")]
    chosen = _placed(docs, distance).groupBy("root").agg(least).select(*key)
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("unknown"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(whole_text()).alias("hash"))
    once = own.groupBy("unknown", "id", "hash").agg(F.first("row").alias("row"))  # repeated rows go before the shuffle
    return once.join(chosen, ["unknown", "id", "hash"], "left_semi").select("row.*")
