"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of integer nodes -> ``(node, root)``, root = smallest node.

    Every node of an edge that is not itself a root gets one row; nodes without
    edges and roots get none. Only two numbers a round reach the driver.
    Self-loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    cur = cut(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        .distinct()
    )
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .distinct()
        )
        cur = cut(small)
        last, state = state, _state(cur)
        if last == state:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
