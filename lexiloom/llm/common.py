"""Shared helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, new_folder, shared_dir

__all__ = ["FLAGS", "all_passing", "bounded_batches", "cut", "flag_bits", "flags", "let", "new_folder", "one_task_a_file", "passes", "read_table", "shared_dir", "whole_text"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB at most, where neither the session nor its configuration sets a bound.

    Spark's own 64 MB take a worker several hundred megabytes as Python strings.
    The bound stays for the session, as plans read it when they run.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, "2m")


#: Tasks that read the files of a manifest, at most.
READERS = 20_000


def one_task_a_file(manifest: DataFrame) -> DataFrame:
    """Deal the rows of a manifest out, one to a task up to ``READERS`` tasks.

    The number is fixed, as adaptive execution would merge so few bytes of paths
    into one task, however large the files.
    """
    return manifest.repartition(min(max(manifest.count(), 1), READERS))


#: Hash buckets of a membership test; a full table only means that all rows pass it.
FLAGS = 1 << 22


def flags(rows: DataFrame, value: Column) -> bytes:
    """A byte for each of ``FLAGS`` buckets of ``value``: 1 if a row falls into it."""
    bucket = F.pmod(value, F.lit(FLAGS))
    words = rows.groupBy((bucket / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bucket % 32).cast("int"))).alias("bits")).collect()  # FLAGS / 32 rows at most
    out = np.zeros((FLAGS // 32, 32), np.uint8)
    for r in words:
        out[r["w"]] = r["bits"] >> np.arange(32) & 1
    return out.tobytes()


#: Bits of a membership test that follows the data: for each row, at least, and at most; and the parts of a hash that name a row's bits.
BITS_A_ROW, FEWEST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
PARTS = (0, 12, 24, 36)


def flag_bits(rows: DataFrame, value: Column) -> bytes:
    """A Bloom filter of the 64-bit hashes ``value`` of ``rows``, of as many bits (a power of two) as they ask for.

    About one other hash in 5,000 passes; beyond ``MOST_BITS / BITS_A_ROW`` rows
    more and more of them do, up to all.
    """
    size = min(max(1 << (BITS_A_ROW * rows.count()).bit_length(), FEWEST_BITS), MOST_BITS)
    bits = rows.select(value.alias("h")).select(F.explode(F.array(*[F.shiftrightunsigned("h", p).bitwiseAND(F.lit(size - 1)) for p in PARTS])).alias("b"))
    words = bits.groupBy((F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("b") % 64).cast("int"))).alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, "<i8")
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def passes(bits: bytes, h: int) -> bool:
    """Whether an unsigned hash has all of its bits in ``flag_bits``."""
    mask = 8 * len(bits) - 1
    for p in PARTS:
        at = h >> p & mask
        if not bits[at >> 3] >> (at & 7) & 1:
            return False
    return True


def all_passing(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """The same of many signed hashes."""
    flat, out = np.frombuffer(bits, np.uint8), np.ones(len(hashes), bool)
    for p in PARTS:
        at = hashes.view(np.uint64) >> np.uint64(p) & np.uint64(8 * len(bits) - 1)
        out &= (flat[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
