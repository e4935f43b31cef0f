"""Readers and writers of the formats that the jobs exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fields, trim_control, whole_number
from .keyed import write_keyed


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, paths: str | list[str], exclude: str | None = None) -> DataFrame:
    """``value``: lines of comma-separated or listed paths, blank paths dropped, one may be excluded."""
    wanted = [p.strip() for p in (paths.split(",") if isinstance(paths, str) else paths)]
    return spark.read.text([p for p in wanted if p and p != exclude])


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their place: line (in their file, from 0), ord (over all files in order of their names, from 0) and value.

    A file is read by as many tasks as it has splits. Within a split rows have
    ascending ids; the lines of the splits before are counted and added. Counts
    are one row a split.
    """
    rows = text_lines(spark, paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    counts = rows.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = lambda *by: Window.partitionBy(*by).orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "split", "first", *[F.coalesce(F.sum("n").over(w), F.lit(0)).alias(c) for c, w in (("in_file", before("file")), ("in_all", before()))])
    nth = F.col("id") - F.col("first")
    return rows.join(starts, ["file", "split"]).select((nth + F.col("in_file")).alias("line"), (nth + F.col("in_all")).alias("ord"), "value")


def read_triples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    f = fields(F.col("value"))
    rows = text_lines(spark, paths).where(F.size(f) >= 4)
    return rows.select(F.get(f, F.lit(0)).alias("pid"), F.get(f, F.lit(1)).alias("slot"), F.get(f, F.lit(2)).alias("word"), whole_number(F.get(f, F.lit(3))).alias("cnt")).where("cnt is not null")


def read_mi(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """pid, slot, word, mi, cnt and ``ord`` (order of files and lines); only positive or NaN values."""
    f = fields(F.col("value"))
    # a file's splits are told apart by where they begin; within one split the ids ascend
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    rows = text_lines(spark, paths).select(at.alias("ord"), f.alias("f")).where(F.size("f") >= 5)
    rows = rows.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("pid", "slot", "word"))], F.get("f", F.lit(3)).try_cast("double").alias("mi"), whole_number(F.get("f", F.lit(4))).alias("cnt"), "ord")
    return rows.where((F.col("mi") > 0) | F.isnan("mi"))


def read_pairs(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """ord, lhs, rhs, label: positive pairs first, in file order, repeated ones too."""

    def one(path: str, label: int) -> DataFrame:
        f = fields(F.col("value"))
        rows = numbered_lines(spark, path).where(F.size(f) >= 2)
        return rows.select((F.col("ord") + ((1 - label) << 40)).alias("ord"), F.get(f, F.lit(0)).alias("lhs"), F.get(f, F.lit(1)).alias("rhs"), F.lit(label).alias("label"))

    return one(positive, 1).unionByName(one(negative, 0))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark, path).select(trim_control(F.col("value")).alias("pid")).where("pid != ''").distinct()


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """lhs, rhs, label, score of an earlier run; the last row of a pair wins."""
    f = fields(F.col("value"))
    rows = numbered_lines(spark, path).where((F.col("line") > 0) & (F.size(f) >= 6))
    rows = rows.select("ord", F.get(f, F.lit(0)).alias("lhs"), F.get(f, F.lit(1)).alias("rhs"), F.get(f, F.lit(2)).try_cast("int").alias("label"), F.get(f, F.lit(5)).try_cast("double").alias("score"))
    return rows.where("label is not null and score is not null").groupBy("lhs", "rhs", "label").agg(F.max_by("score", "ord").alias("score"))


def read_tasks(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    return numbered_lines(spark, path).select(F.lit(task_id).alias("task_id"), F.col("ord").alias("line_no"), F.col("value").alias("line"))


def write_tsv(df: DataFrame, path: str, header: bool = False, one_file: bool = False) -> None:
    """Overwrite ``path`` with tab-separated text; ``one_file`` for results that are small by nature."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", escape="", emptyValue="")


def write_reports(reports: DataFrame, path: str) -> None:
    """One file for each job, under exactly its report key below ``path``; all or none."""
    write_keyed(reports.select(F.col("report_key").alias("key"), F.col("html").alias("value")), path)


def fetch_files(tasks: DataFrame, folder: str, most_bytes: int = 64 << 20) -> DataFrame:
    """``tasks(url, ...)`` with the text of the file that each address names below ``folder``, or an error.

    Only names and lengths of files are read for those that are longer than
    ``most_bytes``, which fail, as do addresses without a file, and files that
    are not UTF-8. Spark's scans leave out files of no bytes, so these count as
    not there. Errors are those of a job's result; text is then null.
    """
    spark = tasks.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    named = files.select(F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(root.replace("file:///", "file:/")) + 2, 1 << 30).alias("url"), "length", "content")
    small = named.where(F.col("length") <= most_bytes).select("url", F.lit(True).alias("here"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    large = named.where(F.col("length") > most_bytes).select("url", "length")
    failed = F.lit("Failed to download file from URL: ")
    rows = tasks.join(small, "url", "left").join(large, "url", "left")
    error = (
        F.when(F.col("length").isNotNull(), F.concat(failed, F.lit(f"longer than {most_bytes} bytes")))
        .when(F.col("here").isNull(), F.concat(failed, F.coalesce("url", F.lit(""))))
        .when(F.col("text").isNull(), F.lit("Failed to analyze file: "))
    )
    return rows.select(*tasks.columns, "text", error.alias("error"))
