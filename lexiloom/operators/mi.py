"""Marginals and positive pointwise mutual information of (path, slot, word) counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept


def aggregate(triples: DataFrame) -> DataFrame:
    return triples.groupBy("pid", "slot", "word").agg(F.sum("cnt").alias("cnt"))


def slot_word_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("slot", "word").agg(F.sum("cnt").alias("c"))


def slot_totals(counts: DataFrame) -> DataFrame:
    """From ``slot_word_counts``, which is far smaller than the triples."""
    return counts.where(F.col("slot").isin("X", "Y")).groupBy("slot").agg(F.sum("c").alias("d"))


def path_slot_totals(triples: DataFrame) -> DataFrame:
    return triples.groupBy("pid", "slot").agg(F.sum("cnt").alias("b"))


def keep_paths(rows: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Rows whose pid is listed; Spark broadcasts the list only if it is small."""
    return rows.join(whitelist.select("pid").distinct(), "pid", "left_semi")


def mutual_information(triples: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """pid, slot, word, mi, cnt where mi = ln(A D / (B C)) is positive.

    The word and slot marginals need all triples; a whitelist of paths restricts
    what comes after them. B and C are aggregates that are joined back, which
    Spark can split where a path or word is hot, as it can't a window. All of them
    come from one aggregate, which is written once, so that triples are read once.
    Null words and other slots than X and Y have no information.
    """
    return of_aggregate(kept(aggregate(triples)), whitelist)


def of_aggregate(own: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """The same from triples that are aggregated and written already."""
    rows = own if whitelist is None else keep_paths(own, whitelist)
    return _positive(_with_marginals(rows, slot_word_counts(own)))


def _with_marginals(rows: DataFrame, counts: DataFrame) -> DataFrame:
    return rows.join(path_slot_totals(rows), ["pid", "slot"]).join(counts, ["slot", "word"]).join(slot_totals(counts), "slot")


def _positive(rows: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x).cast("double") for x in ("cnt", "b", "c", "d"))
    rows = rows.where("b != 0 and d != 0 and c > 0").withColumn("mi", F.log((a * d) / (b * c)))
    return rows.where((F.col("mi") > 0) & ~F.isnan("mi")).select("pid", "slot", "word", "mi", "cnt")


def store(triples: DataFrame, path: str) -> None:
    """Write summed triples beside their marginals as Parquet, in ranges of (pid, slot, word) and in their order.

    Marginals are joined once, here; a marginal's column has one value for many
    rows, which Parquet keeps once. ``of_stored`` then only scans: a path's rows
    stand together, so that a list of paths skips most of each file.
    """
    own = kept(aggregate(triples))
    rows = _with_marginals(own, slot_word_counts(own)).select("pid", "slot", "word", "cnt", "b", "c", "d")
    rows.repartitionByRange("pid", "slot", "word").sortWithinPartitions("pid", "slot", "word").write.mode("overwrite").parquet(path)


def of_stored(spark: SparkSession, path: str, whitelist: DataFrame | None = None) -> DataFrame:
    """``mutual_information`` of triples that ``store`` wrote, without a shuffle."""
    rows = spark.read.parquet(path)
    return _positive(rows if whitelist is None else keep_paths(rows, whitelist))
