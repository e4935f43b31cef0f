"""Prefix tries of conversations.

A node of depth d is a distinct sequence of first d turns; its members are the
conversations that start with it. Turns become 64-bit hashes early on, so texts
never move, and a node's key is its depth and 128 bits: the exclusive or of the
hashes of (place, turn) up to it, twice with different seeds. Different
sequences share a key with a chance of about N^2 / 2^129 for N nodes.

Tries are built in shards. A node with more than ``SHARD`` turns of members at or
below it is heavy; what is above a heavy node is heavy. Heavy nodes are the upper
levels. A prefix whose own node is the first light one on its path has at most
``SHARD`` turns below, and such prefixes are dealt out to shards of about that
many. A shard is a level-order unary degree sequence (LOUDS): for each node, level
by level, a 1 for every child and a 0, after the roots' own, and an array of
labels. Its parents come from ranks of bits, and sums over subtrees from adding
each level to the one above, the deepest first. Upper levels are merged from the
sums at the shards' roots by Spark: each upper node's value belongs to its
smallest member, values run along that member's path from below, and members'
sums add up at each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import bounded_batches, cut

#: Turns of a shard, about, and of the prefixes in it, at most.
SHARD = 1 << 14
_PIECE = 1 << 16
_KEY = ["d", "x", "y"]
_EMPTY = hashlib.sha256(b"").hexdigest()


class Louds:
    """A forest in level order as bits and labels."""

    def __init__(self, roots: int, degrees: np.ndarray, labels: np.ndarray):
        ones = np.concatenate([[roots], degrees])
        bits = np.ones(int(ones.sum()) + len(ones), np.uint8)
        bits[np.cumsum(ones + 1) - 1] = 0
        self.size, self.bits, self.labels = len(bits), np.packbits(bits), labels

    def parents(self) -> np.ndarray:
        """Number of each node's parent, -1 for roots: the zeros before its 1, less that of the roots."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        """Children of each node: the ones between its zero and the zero before."""
        zeros = np.flatnonzero(np.unpackbits(self.bits, count=self.size) == 0)
        return np.diff(zeros) - 1

    def levels(self) -> list[tuple[int, int]]:
        """First node of each level and that after its last."""
        ends = np.concatenate([[0], np.cumsum(self.degrees())])
        lo, hi = 0, len(self.labels) - int(ends[-1])
        out = []
        while lo < hi:
            out.append((lo, hi))
            lo, hi = hi, hi + int(ends[hi] - ends[lo])
        return out

    def rolled_up(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums of values over the subtree of each node."""
        parents, levels = self.parents(), self.levels()
        out = [v.astype(np.int64) for v in values]
        for lo, hi in reversed(levels[1:]):
            for v in out:
                np.add.at(v, parents[lo:hi], v[lo:hi])
        return out


def _codes(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each row such that equal rows have equal ones, and how many there are."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1


def level_order(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, Louds]:
    """Nodes (parent: a node or -1) in level order, siblings by label, and their trie."""
    by_parent = np.lexsort((label, parent))
    counts = np.bincount(parent[parent >= 0], minlength=len(parent))
    roots = int(np.count_nonzero(parent < 0))
    starts = roots + np.cumsum(counts) - counts
    order, now = [], by_parent[:roots]
    while len(now):
        order.append(now)
        n = counts[now]
        now = by_parent[np.repeat(starts[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    order = np.concatenate([np.zeros(0, np.int64), *order])
    return order, Louds(roots, counts[order], label[order])


_NODES = "d bigint, x bigint, y bigint, px bigint, py bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, top boolean"


def shard_nodes(rows: pa.Table) -> pa.Table:
    """Nodes of a shard from its turns (conv_id, d, x, y, gx, gy, size), with sums over subtrees."""
    conv, d, x, y, gx, gy, size = (rows.column(c).to_numpy() for c in ("conv_id", "d", "x", "y", "gx", "gy", "size"))
    px, py = x ^ gx, y ^ gy
    n = len(d)
    codes, _ = _codes(np.concatenate([d, d - 1]), np.concatenate([x, px]), np.concatenate([y, py]))
    held, node = np.unique(codes[:n], return_inverse=True)
    first = np.full(len(held), n)
    np.minimum.at(first, node, np.arange(n))
    least = np.full(len(held), np.iinfo(np.int64).max)
    np.minimum.at(least, node, conv)
    at = np.searchsorted(held, codes[n:][first])
    at[at == len(held)] = 0
    parent = np.where(held[at] == codes[n:][first], at, -1)
    order, trie = level_order(parent, gx[first])
    members = np.bincount(node, minlength=len(held))[order]
    first, least = first[order], least[order]
    degrees, above = trie.degrees(), trie.parents()
    leaves, saved = trie.rolled_up(degrees == 0, (members - 1) * size[first])
    root = above < 0
    columns = [d[first], x[first], y[first], px[first], py[first], least, pa.array(least[above] if len(above) else above, mask=root), members, degrees, leaves, saved, root]
    types = [pa.int64()] * 11 + [pa.bool_()]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _NODES.split(", ")])


def labels(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text, ...)`` -> conv_id, d (from 1), hx, hy, size (bytes of the text).

    Turns are numbered in order of turn, null first; turns of one number in order
    of their hashes, which is arbitrary but fixed. Null role and text are empty;
    rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("hx"), F.xxhash64(F.lit(2), role, text).alias("hy"), F.octet_length(text).cast("bigint").alias("size"))
    return running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("hx"), F.col("hy")], {"d": ("sum", F.lit(1))}).drop("turn")


def mixed(own: DataFrame) -> DataFrame:
    """Rebuild conversations of ``labels``: c begins with the first h turns of c - c mod 5, and goes on with its own after its first h.

    h is the CRC-32 of c in decimal, mod 9. The remainder is never negative. Every
    conversation also gets a row of depth 0.
    """
    own = cut(own)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(5))
    lengths = own.groupBy("conv_id").agg(F.max("d").alias("n")).select("conv_id", "n", h.alias("h"), base.alias("base"))
    held = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    all_ = cut(lengths.join(held, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    # at most 8 turns are taken, by at most 5 conversations
    lent = own.where("d <= 8 and pmod(conv_id, 5) = 0").select(F.col("conv_id").alias("base"), "d", "hx", "hy", "size").join(all_, "base").where("d <= h").select("conv_id", "d", "hx", "hy", "size")
    rest = own.join(all_, "conv_id").where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "hx", "hy", "size")
    zero = F.lit(0).cast("bigint")
    return lent.unionByName(rest).unionByName(all_.select("conv_id", zero.alias("d"), zero.alias("hx"), zero.alias("hy"), zero.alias("size")))


def with_root(own: DataFrame) -> DataFrame:
    """Conversations of ``labels`` as they are, each with a row of depth 0."""
    zero = F.lit(0).cast("bigint")
    return own.unionByName(own.select("conv_id").distinct().select("conv_id", zero.alias("d"), zero.alias("hx"), zero.alias("hy"), zero.alias("size")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, x, y, conv_id) -> key, first conv_id and comma-joined ids, in pieces of bounded size."""
    key, first, ids, length = None, None, [], 0
    for batch in batches:
        out = []
        for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "conv_id")), strict=True):
            if own != key or length >= _PIECE:
                if key is not None:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, length = own, conv, [], 0
            ids.append(str(conv))
            length += len(ids[-1]) + 1
        yield _batch(out, [pa.int64()] * 4 + [pa.string()], [*_KEY, "first", "piece"])
    if key is not None:
        yield _batch([(*key, first, ",".join(ids))], [pa.int64()] * 4 + [pa.string()], [*_KEY, "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> SHA-256 of each key's pieces, comma-joined, one piece at a time."""
    key, digest = None, None
    for batch in batches:
        out = []
        for *own, piece in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "piece")), strict=True):
            if own == key:
                digest.update(b"," + piece.encode())
                continue
            if key is not None:
                out.append((*key, digest.hexdigest()))
            key, digest = own, hashlib.sha256(piece.encode())
        yield _batch(out, [pa.int64()] * 3 + [pa.string()], [*_KEY, "ends"])
    if key is not None:
        yield _batch([(*key, digest.hexdigest())], [pa.int64()] * 3 + [pa.string()], [*_KEY, "ends"])


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _ends(rows: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at a node; ids are joined by range, so that a node at which very many end is dealt out."""
    last = rows.where("d = length").select(*_KEY, "conv_id")
    pieces = last.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(_pieces, "d bigint, x bigint, y bigint, first bigint, piece string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "d bigint, x bigint, y bigint, ends string")


def _upper(heavy: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the upper levels from their members' rows and the roots of shards."""
    nodes = heavy.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), F.max(F.col("x").bitwiseXOR(F.col("gx"))).alias("px"), F.max(F.col("y").bitwiseXOR(F.col("gy"))).alias("py"))
    nodes = cut(nodes)
    of_parent = [(F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")]
    zero = F.lit(0).cast("bigint")
    below = tops.select(*of_parent, "n_leaves", "saved").unionByName(nodes.where("d > 0").select(*of_parent, zero.alias("n_leaves"), zero.alias("saved")))
    below = below.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("below_leaves"))
    saved = (F.col("n_convs") - 1) * F.col("size") + F.coalesce("below_saved", F.lit(0))
    nodes = cut(nodes.join(below, _KEY, "left").select(*_KEY, "px", "py", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), leaf.cast("bigint").alias("leaf"), saved.alias("saved")))
    owned = nodes.select(*_KEY, "conv_id", "leaf", "saved")
    paths = heavy.join(owned.select("conv_id").distinct(), "conv_id", "left_semi").select(*_KEY, "conv_id").join(owned, [*_KEY, "conv_id"], "left")
    sums = running(paths, ["conv_id"], [F.col("d").desc()], {"leaves": ("sum", F.col("leaf")), "all_saved": ("sum", F.col("saved"))})
    sums = sums.groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("all_saved").alias("saved"))
    return nodes.drop("leaf", "saved").join(sums, _KEY)


#: Parts that the rows of a key are dealt out to in joins with the few rows that very many others may match.
SALTS = 32


def _salted(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which no key's rows meet in one task."""
    spread = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(spread, [*keys, "__salt"], "left").drop("__salt")


def trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of the trie of ``turns(conv_id, d, hx, hy, size)``, which ``with_root`` or ``mixed`` make.

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, the bytes of a
    node's last text for all members but one) and ends_sha256. No turns give no
    nodes, and no root.
    """
    bounded_batches(turns.sparkSession)
    mark = lambda h, seed: F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), "d", h)).otherwise(F.lit(0).cast("bigint"))
    rows = turns.select("conv_id", "d", mark("hx", 1).alias("gx"), mark("hy", 2).alias("gy"), "size")
    rows = running(rows, ["conv_id"], ["d"], {"x": ("xor", F.col("gx")), "y": ("xor", F.col("gy"))})
    lengths = turns.groupBy("conv_id").agg(F.max("d").alias("length"))
    rows = cut(rows.join(lengths, "conv_id"))
    heavy = rows.groupBy(*_KEY).agg(F.sum(F.col("length") - F.col("d") + 1).alias("below")).where(F.col("below") > shard).select(*_KEY, F.lit(True).alias("heavy"))
    rows = cut(_salted(rows, heavy, _KEY).withColumn("heavy", F.coalesce("heavy", F.lit(False))))
    light, heavy = rows.where("not heavy"), rows.where("heavy")
    prefix = light.groupBy("conv_id").agg(F.min(F.struct("d", "x", "y")).alias("prefix"))
    shards = -(-light.count() // shard) or 1
    dealt = light.join(prefix, "conv_id").withColumn("shard", F.pmod(F.xxhash64("prefix.d", "prefix.x", "prefix.y"), F.lit(shards)))
    nodes = cut(dealt.select("shard", "conv_id", "d", "x", "y", "gx", "gy", "size").groupBy("shard").applyInArrow(shard_nodes, _NODES))
    upper = cut(_upper(heavy, nodes.where("top and d > 0")))
    above = upper.select((F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("above"))
    columns = [*_KEY, "px", "py", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    inner = nodes.where("not top").select(*columns, "parent_conv_id")
    outer = _salted(nodes.where("top").select(*columns).unionByName(upper.select(*columns)), above, ["d", "px", "py"]).select(*columns, F.col("above").alias("parent_conv_id"))
    found = inner.unionByName(outer).join(_ends(rows), _KEY, "left")
    return found.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text, ...)`` as they are; see ``labels`` and ``trie``."""
    return trie(with_root(cut(labels(conversations))), shard)


def mixed_trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """The trie of rebuilt conversations; see ``labels``, ``mixed`` and ``trie``.

    Repeated turns are turns of their own; extra columns are ignored; an empty
    table gives an empty result.
    """
    return trie(cut(mixed(labels(conversations))), shard)
