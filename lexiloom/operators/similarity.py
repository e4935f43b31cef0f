"""Similarity of predicate paths by their shared slot fillers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .templates import normalize


def vectors(mi: DataFrame) -> DataFrame:
    """pid, slot, word, mi: one value for a word; where ``ord`` tells of repeated rows, the last."""
    if "ord" in mi.columns:
        return mi.groupBy("pid", "slot", "word").agg(F.max_by("mi", "ord").alias("mi"))
    return mi.select("pid", "slot", "word", "mi")


def slot_sums(mi: DataFrame) -> DataFrame:
    """Sum of all rows of a path's slot, repeated ones too, and the size of its vector."""
    return mi.groupBy("pid", "slot").agg(F.sum("mi").alias("total"), F.count_distinct("word").alias("words"))


def slot_similarity(mi: DataFrame, sides: DataFrame) -> DataFrame:
    """``sides(key, p1, s1, p2, s2)`` -> those and sim, words1, words2, shared.

    sim is the sum of both values over shared words by the sum over all; 0 where
    a vector is missing. Vectors meet in equi-joins on path, slot and word.
    """
    sums, own = slot_sums(mi), vectors(mi)
    first = sums.select(F.col("pid").alias("p1"), F.col("slot").alias("s1"), F.col("total").alias("t1"), F.col("words").alias("words1"))
    second = sums.select(F.col("pid").alias("p2"), F.col("slot").alias("s2"), F.col("total").alias("t2"), F.col("words").alias("words2"))
    asked = sides.select("p1", "s1", "p2", "s2").distinct()
    left = own.select(F.col("pid").alias("p1"), F.col("slot").alias("s1"), "word", F.col("mi").alias("m1"))
    right = own.select(F.col("pid").alias("p2"), F.col("slot").alias("s2"), "word", F.col("mi").alias("m2"))
    overlap = asked.join(left, ["p1", "s1"]).join(right, ["p2", "s2", "word"]).groupBy("p1", "s1", "p2", "s2").agg(F.sum(F.col("m1") + F.col("m2")).alias("both"), F.count(F.lit(1)).alias("shared"))
    out = sides.join(first, ["p1", "s1"], "left").join(second, ["p2", "s2"], "left").join(overlap, ["p1", "s1", "p2", "s2"], "left")
    whole = F.col("t1") + F.col("t2")
    return out.select(*sides.columns, F.coalesce(F.when(whole > 0, F.col("both") / whole), F.lit(0.0)).alias("sim"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("words1", "words2", "shared")])


def _physical(swapped: str, slot: str) -> Column:
    return F.when(F.col(swapped), "Y" if slot == "X" else "X").otherwise(slot)


def normalized_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs(ord, lhs, rhs, label)`` with pid, swapped and logical of both sides."""
    forms = normalize(pairs.select(F.explode(F.array("lhs", "rhs")).alias("template")).distinct())
    for side, n in (("lhs", "1"), ("rhs", "2")):
        own = forms.select(F.col("template").alias(side), F.col("pid").alias(f"p{n}"), F.col("swapped").alias(f"swapped{n}"), F.col("logical").alias(f"norm_{side}"))
        pairs = pairs.join(own, side)
    return pairs


#: Which logical slots of the two sides meet.
_ALIGNMENTS = {"xx": ("X", "X"), "yy": ("Y", "Y"), "xy": ("X", "Y"), "yx": ("Y", "X")}


def slot_details(mi: DataFrame, pairs: DataFrame, by_roles: bool = True, crossed: bool = False) -> DataFrame:
    """One row for each pair, with sim, words1, words2 and shared of each alignment as sim_xx, words1_xx and so on."""
    pairs = normalized_pairs(pairs)
    chosen = _ALIGNMENTS if crossed else {k: v for k, v in _ALIGNMENTS.items() if k in ("xx", "yy")}
    one = [pairs.select("ord", F.lit(k).alias("align"), "p1", (_physical("swapped1", a) if by_roles else F.lit(a)).alias("s1"), "p2", (_physical("swapped2", b) if by_roles else F.lit(b)).alias("s2")) for k, (a, b) in chosen.items()]
    sims = slot_similarity(mi, reduce(DataFrame.unionByName, one))
    wide = sims.groupBy("ord").agg(*[F.max(F.when(F.col("align") == k, F.col(c))).alias(f"{c}_{k}") for k in chosen for c in ("sim", "words1", "words2", "shared")])
    return pairs.join(wide, "ord")


def path_similarity(mi: DataFrame, pairs: DataFrame, by_roles: bool = True, use_max_swap: bool = False) -> DataFrame:
    """ord, lhs, rhs, label, norm_lhs, norm_rhs, score = sqrt(simX simY), or the best of both alignments."""
    rows = slot_details(mi, pairs, by_roles, use_max_swap)
    score = F.sqrt(F.col("sim_xx") * F.col("sim_yy"))
    if use_max_swap:
        score = F.greatest(score, F.sqrt(F.col("sim_xy") * F.col("sim_yx")))
    return rows.select("ord", "lhs", "rhs", "label", "norm_lhs", "norm_rhs", score.alias("score"))
