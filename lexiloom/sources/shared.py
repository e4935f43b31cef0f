"""What is written once to the folder that driver and executors share.

Checkpoints go with Spark's own cleaner (spark.cleaner.referenceTracking.cleanCheckpoints);
all other files stand below ``run_dir`` until ``clean_up`` removes them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` or the context names it.

    Only a local session without one (tests) gets a temporary folder; on a cluster
    that would be a folder of the driver's machine alone, so it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once for what reads it more than once; lost executors don't matter then."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def run_dir(spark: SparkSession) -> str:
    """The folder below the shared one that all files of this application go to."""
    return f"{shared_dir(spark)}/lexiloom-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the run's folder that nothing else uses."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove all files of this application once nothing reads its results any more."""
    forget(spark, run_dir(spark))


def kept(df: DataFrame) -> DataFrame:
    """``cut`` for large or wide tables: Parquet, which is compressed, has sizes that joins are planned by, and is read by column."""
    return stored(df, "kept")[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to a folder of its own below the shared one; what reads it, and the folder.

    Unlike ``cut`` it is compressed, and reads can leave out columns. ``forget``
    removes it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``stored`` that nothing reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
