"""Evaluation of scored pairs: threshold sweep, curve, errors and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import six
from .scan import running
from .similarity import slot_details


def sweep(scores: DataFrame) -> DataFrame:
    """One row for each distinct score as threshold (score >= it is positive).

    Counts run from the highest score down, within ranges that follow the scores,
    so that no task gets all distinct scores, however close together they lie.
    NaN counts as the greatest.
    """
    runs = scores.groupBy("score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    rows = running(runs, [], [F.col("score").desc()], {"tp": ("sum", F.col("pos")), "seen": ("sum", F.col("n"))})
    rows = rows.join(F.broadcast(scores.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("all_pos"), F.count(F.lit(1)).alias("all_n"))))  # one row
    counts = rows.select(F.col("score").alias("threshold"), F.col("tp").cast("bigint").alias("tp"), (F.col("seen") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("seen") - F.col("all_pos") + F.col("tp")).alias("tn"), "all_pos")
    p = F.when(F.col("tp") + F.col("fp") == 0, 0.0).otherwise(F.try_divide("tp", F.col("tp") + F.col("fp")))
    r = F.when(F.col("all_pos") == 0, 0.0).otherwise(F.try_divide("tp", "all_pos"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).drop("all_pos")


def pr_curve(scores: DataFrame) -> DataFrame:
    return sweep(scores).select("threshold", "precision", "recall")


def best_threshold(scores: DataFrame) -> DataFrame:
    """The row with the greatest F1, and of those the highest threshold.

    Without any scores: one row with a NaN threshold and F1 0.
    """
    best = sweep(scores).orderBy(F.col("f1").desc(), F.col("threshold").desc()).limit(1).select("threshold", "f1", "tp", "fp", "fn", "tn")
    none = scores.sparkSession.createDataFrame([(float("nan"), 0.0, 0, 0, 0, 0)], "threshold double, f1 double, tp bigint, fp bigint, fn bigint, tn bigint")
    return none.join(best.select(F.lit(1).alias("any")), F.lit(True), "left_anti").unionByName(best)


def error_analysis(scores: DataFrame, k: int = 5, previous: DataFrame | None = None) -> DataFrame:
    """The k most telling pairs of each outcome, by score and then order.

    With ``previous(lhs, rhs, label, score)`` (one row for a pair) its score is
    shown beside, or NA.
    """
    at = best_threshold(scores).select(F.col("threshold").alias("at"))
    hit, gold = F.col("score") >= F.col("at"), F.col("label") == 1
    rows = scores.join(F.broadcast(at)).withColumn("category", F.when(hit & gold, "TP").when(hit, "FP").when(gold, "FN").otherwise("TN"))
    signed = F.when(F.col("category").isin("TP", "FP"), -F.col("score")).otherwise(F.col("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(signed, "ord"))).where(F.col("rank") <= k)
    columns = ["category", "rank", "lhs", "rhs", "label", six(F.col("score")).alias("score")]
    if previous is not None:
        rows = rows.join(previous.select("lhs", "rhs", "label", F.col("score").alias("before")), ["lhs", "rhs", "label"], "left")
        columns.append(F.coalesce(F.when(F.col("before").isNotNull(), six(F.col("before"))), F.lit("NA")).alias("compare_score"))
    return rows.select(*columns)


def diagnostics(scores: DataFrame) -> DataFrame:
    """Counts, zeros and range of the scores of each label."""
    return scores.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") == 0).alias("zeros"), F.min("score").alias("low"), F.max("score").alias("high"))


def zero_breakdown(mi: DataFrame, pairs: DataFrame) -> DataFrame:
    """Why positive pairs score zero: missing paths, empty slots, nothing shared."""
    rows = slot_details(mi, pairs).where((F.col("label") == 1) & (F.sqrt(F.col("sim_xx") * F.col("sim_yy")) == 0))

    def empty(slot: str):
        return (F.col(f"words1_{slot}") == 0) | (F.col(f"words2_{slot}") == 0)

    return rows.agg(
        F.count(F.lit(1)).alias("zero_positives"),
        F.count_if((F.col("words1_xx") == 0) & (F.col("words1_yy") == 0)).alias("missing_1"),
        F.count_if((F.col("words2_xx") == 0) & (F.col("words2_yy") == 0)).alias("missing_2"),
        F.count_if(empty("xx")).alias("empty_x"),
        F.count_if(empty("yy")).alias("empty_y"),
        F.count_if(~empty("xx") & (F.col("shared_xx") == 0)).alias("apart_x"),
        F.count_if(~empty("yy") & (F.col("shared_yy") == 0)).alias("apart_y"),
    )
