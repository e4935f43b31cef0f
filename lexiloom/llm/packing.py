"""Best-fit-decreasing packing into sequences of several permitted lengths.

How items fill bins depends on their lengths alone, so the plan is made on the
histogram of lengths, which has at most ``max(capacities)`` rows whatever the
corpus holds. Spark counts the histogram, ranks the items of each length (in
hashed buckets, so that a length that a third of all items share is dealt out)
and looks each rank up in the plan.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, cut, whole_text

CAPACITIES = (2048, 4096, 8192, 16384)
BUCKETS = 1024


def bin_cost(capacity: int) -> float:
    """Cost of one sequence: a fixed part, its tokens, and attention over them."""
    return 256.0 + capacity * (1.0 + capacity / 65536.0)


@dataclass
class Run:
    """Items ``first .. first + count - 1`` of one length, ``per_bin`` to a bin."""

    length: int
    first: int
    count: int
    per_bin: int
    bin_start: int
    offset: int


@dataclass
class Bins:
    """``count`` bins from ``start`` on that hold the same and are alike."""

    start: int
    count: int
    used: int
    capacity: int


def cheapest(capacities: tuple[int, ...], length: int, left: int, cost=bin_cost) -> int:
    """Permitted size with the least cost for each unit it can still be filled with."""
    return min((c for c in capacities if c >= length), key=lambda c: (cost(c) / min(c, left), c))


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost=bin_cost) -> tuple[list[Run], list[Bins]]:
    """Best-fit decreasing over a histogram of lengths.

    Each item goes to the open bin with the least space that holds it; of bins
    with equal space to the smallest, and of those to the one opened first. If
    none holds it, the bin size that is cheapest for what is left is opened. At
    the end each bin shrinks to the smallest permitted size that holds its
    contents. Equal to placing item by item, in steps that place many alike items
    at once.
    """
    longest = max(capacities)
    runs: list[Run] = []
    spaces: list[int] = []
    open_: dict[int, list[tuple[int, int, Bins]]] = {}
    closed: list[Bins] = []
    left = sum(n * k for n, k in histogram.items())
    next_bin = 0

    def put(bins: Bins) -> None:
        space = bins.capacity - bins.used
        if not space:
            closed.append(bins)
            return
        if space not in open_:
            insort(spaces, space)
            open_[space] = []
        heapq.heappush(open_[space], (bins.capacity, bins.start, bins))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                capacity = cheapest(capacities, length, left, cost)
                per_bin = capacity // length
                # so many that the choice of size can't change on the way: less than the longest is never left before the last
                opened = max(1, min(todo // per_bin, (left - longest) // (per_bin * length) + 1))
                put(Bins(next_bin, opened, 0, capacity))
                next_bin += opened
                continue
            space = spaces[at]
            bins = heapq.heappop(open_[space])[2]
            if not open_[space]:
                del open_[space], spaces[at]
            per_bin = min(space // length, todo)
            filled = min(bins.count, todo // per_bin)
            runs.append(Run(length, rank, filled * per_bin, per_bin, bins.start, bins.used))
            put(Bins(bins.start, filled, bins.used + per_bin * length, bins.capacity))
            if filled < bins.count:
                put(Bins(bins.start + filled, bins.count - filled, bins.used, bins.capacity))
            todo, rank, left = todo - filled * per_bin, rank + filled * per_bin, left - filled * per_bin * length
    final = closed + [b for group in open_.values() for _, _, b in group]
    for b in final:
        b.capacity = min(c for c in capacities if c >= b.used)
    return runs, sorted((b for b in final if b.used), key=lambda b: b.start)


def byte_length(column: str = "text") -> Column:
    """Length of a text in bytes, for models that read bytes, with its end."""
    return F.octet_length(whole_text(column)).cast("bigint") + 1


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, cost=bin_cost) -> DataFrame:
    """Place every document of ``docs(doc_id, text, ...)`` in bins.

    Returns doc_id, piece, start (of the piece in the document), length, bin_id,
    bin_offset and bin_capacity. A document longer than the largest capacity is
    cut into pieces of that size and a rest. ``length`` is a column of positive
    lengths, by default the bytes of the text and an end; null and empty texts
    have that end alone. Repeated rows and equal or null ids are items of
    their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    capacities = tuple(sorted(set(capacities)))
    longest = capacities[-1]
    total = byte_length() if length is None else length
    items = cut(
        docs.select("doc_id", total.alias("total"))
        .select("doc_id", "total", F.explode(F.expr(f"sequence(0L, (total - 1) div {longest})")).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.expr(f"least({longest}L, total - piece * {longest})").alias("length"))
    )
    # a number of each row, which the checkpoint fixes: repeated and null ids are dealt out like others
    items = items.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)))
    counts = items.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `longest` rows
    runs, bins = plan(histogram, capacities, cost)
    runs.sort(key=lambda r: (r.length, r.first))
    table = np.array([(r.length, r.first, r.per_bin, r.bin_start, r.offset) for r in runs], np.int64).reshape(-1, 5)
    sizes = np.array([(b.start, b.capacity) for b in bins], np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((table, sizes))

    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, sizes = shared.value
        out = np.zeros((len(length), 3), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        order = np.lexsort((r, n))
        for size, at in zip(*np.unique(n[order], return_index=True), strict=True):
            rows = order[at : at + np.count_nonzero(n == size)]
            lo, hi = np.searchsorted(table[:, 0], [size, size + 1])
            own = table[lo + np.searchsorted(table[lo:hi, 1], r[rows], side="right") - 1]
            i = r[rows] - own[:, 1]
            out[rows, 0] = own[:, 3] + i // own[:, 2]
            out[rows, 1] = own[:, 4] + i % own[:, 2] * size
        if len(out):
            out[:, 2] = sizes[np.searchsorted(sizes[:, 0], out[:, 0], side="right") - 1, 1]
        return pd.DataFrame(out, columns=["bin_id", "bin_offset", "bin_capacity"])

    place = pandas_udf(look_up, "bin_id bigint, bin_offset bigint, bin_capacity bigint")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    bases = counts.select("length", "bucket", before.alias("before"))
    ranked = (
        items.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")))
        .join(bases, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", (F.col("before") + F.col("nth") - 1).alias("rank"))
    )
    return ranked.withColumn("p", place("length", "rank")).select("doc_id", "piece", "start", "length", "p.bin_id", "p.bin_offset", "p.bin_capacity")
