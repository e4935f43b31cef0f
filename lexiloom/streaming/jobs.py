"""Streams of the same operators: results, leases and reports over files that arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

from ..operators import ledger, tasks
from ..sources.shared import cut, forget, kept


def stream_table(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A Parquet folder as a stream of its files."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet; offsets follow the sink."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def first_results(results: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """First terminal result of each subtask, whatever files it is repeated in.

    A batch's own first is folded before it is written; the reader's fold then
    settles batches, so writing a batch again changes nothing.
    """
    spark = results.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        tasks.first_terminal(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    results.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return tasks.first_terminal(spark.read.parquet(path).drop("batch"))


#: Batches after which all states are written anew; until then only those that a batch changes.
COMPACT = 16


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def lease_states(spark: SparkSession, path: str, upto: int) -> DataFrame:
    """State of every subtask after batch ``upto`` of ``lease_outcomes``."""
    first = upto - upto % COMPACT if upto >= 0 else 0
    folders = [x for x in (f"{path}/states/all={first}", *(f"{path}/states/batch={n}" for n in range(first + 1, upto + 1))) if _exists(spark, x)]
    names = [c.split()[0] for c in ledger.STATE.split(", ")]
    if not folders:
        return spark.createDataFrame([], "task_id string, sub_task_id string, " + ledger.STATE)
    rows = [spark.read.parquet(x).withColumn("__n", F.lit(i)) for i, x in enumerate(folders)]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy(*ledger.KEY).agg(F.max_by(F.struct(*names), "__n").alias("s")).select(*ledger.KEY, "s.*")


def lease_outcomes(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Outcome of every lease event of a stream whose batches follow each other in time.

    A batch folds its events, sorted by Spark, onto the states that the batches
    before have left, so no task holds a key's events. It writes its outcomes, the
    states that it changes (all states, every ``COMPACT`` batches) and the leases
    that have run out by its latest event, which is the stream's clock: those
    need no event of their own (``expired_leases``). Each has a folder of the
    batch's number, so a batch that is run again writes the same.
    """
    spark = events.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        own = cut(batch)
        states = lease_states(spark, path, number - 1)
        touched = states.join(own.select(*ledger.KEY).distinct(), ledger.KEY, "left_semi")
        outcomes = kept(ledger.fold_onto(own, touched))
        changed = ledger.states_after(outcomes)
        outcomes.select(*[c.split()[0] for c in ledger.OUTCOMES.split(", ")]).write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
        every = states.join(changed.select(*ledger.KEY), ledger.KEY, "left_anti").unionByName(changed)
        (every if number % COMPACT == 0 else changed).write.mode("overwrite").parquet(f"{path}/states/{'all' if number % COMPACT == 0 else 'batch'}={number}")
        now = own.agg(F.max("at").alias("now"))
        ledger.expired(every.join(F.broadcast(now)), F.col("now")).write.mode("overwrite").parquet(f"{path}/expired/batch={number}")  # one row is sent
        old = number - 2 * COMPACT  # the states since then are read if this batch is run again
        for n in range(old, old + COMPACT) if number % COMPACT == 0 and old >= 0 else ():
            forget(spark, f"{path}/states/{'all' if n == old else 'batch'}={n}")

    events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/outcomes").drop("batch")


def expired_leases(spark: SparkSession, path: str) -> DataFrame:
    """Leases of ``lease_outcomes`` that ran out, and the batch by which each was first seen to have."""
    return spark.read.parquet(f"{path}/expired").groupBy(*ledger.KEY, "owner", "expires").agg(F.min("batch").alias("batch"))


class JobResults(StatefulProcessor):
    """State of a job: the first result of each subtask so far, how many there are, and whether the job was reported.

    Emits the job's rows once, with the result that completes it; its results are
    let go of then. Later results change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "sub_task_id string", "a bigint, b bigint, analysis string, url string, output string")
        self.count = handle.getValueState("count", "n bigint")
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.told.exists():
            return
        count, expected = (self.count.get()[0] if self.count.exists() else 0), None
        for pdf in rows:
            expected = int(pdf["expected"].iloc[0])
            # one call of the state for each subtask of a batch, however often its result is repeated
            for r in pdf.sort_values(["a", "b"], kind="stable").drop_duplicates("sub_task_id").itertuples(index=False):
                own = (r.sub_task_id,)
                if not self.first.containsKey(own):
                    count += 1
                elif tuple(self.first.getValue(own)[:2]) <= (r.a, r.b):
                    continue
                self.first.updateValue(own, (r.a, r.b, r.analysis, r.url, r.output))
        if count < expected:
            self.count.update((count,))
            return
        self.told.update((True,))
        held = [(key[0], k[0], *v[2:]) for k, v in self.first.iterator()]
        self.first.clear()
        self.count.clear()
        yield pd.DataFrame(held, columns=["task_id", "sub_task_id", "analysis", "url", "output"])

    def close(self) -> None:
        pass


_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within use the RocksDB state store."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def complete_jobs(results: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``tasks.summary_rows`` of each job, in the batch of ``results`` that completes it.

    Results of unknown subtasks are dropped. ``arrival`` is a number or time, or a
    struct of two, whose order tells which result is first; one that arrives by an
    earlier number, but after its job was reported, is too late. The session must
    use the RocksDB state store.
    """
    spark = results.sparkSession
    if spark.conf.get(_PROVIDER) != _ROCKS:
        raise ValueError(f"set {_PROVIDER} to {_ROCKS}")
    kind = results.schema["arrival"].dataType
    parts = [(F.col(f"arrival.{f.name}"), f.dataType) for f in kind.fields] if isinstance(kind, StructType) else [(F.col("arrival"), kind)]
    whole = [F.unix_micros(c.cast("timestamp")) if isinstance(t, (TimestampType, TimestampNTZType)) else c.cast("bigint") for c, t in parts] + [F.lit(0).cast("bigint")]
    whole = [F.coalesce(c, F.lit((1 << 63) - 1)) for c in whole]  # a result that arrived at no known time is the last
    expected = known.groupBy("task_id").agg(F.count(F.lit(1)).alias("expected"))
    rows = results.join(known.select("task_id", "sub_task_id", "analysis", "url"), ["task_id", "sub_task_id"]).join(expected, "task_id")
    rows = rows.select("task_id", "sub_task_id", whole[0].alias("a"), whole[1].alias("b"), "analysis", "url", tasks.output_cell().alias("output"), "expected")
    return rows.groupBy("task_id").transformWithStateInPandas(JobResults(), "task_id string, sub_task_id string, analysis string, url string, output string", "append", "none")


def reports(results: DataFrame, known: DataFrame, bucket: str, path: str, checkpoint: str) -> DataFrame:
    """Write the report of every job in the batch that completes it; returns all reports.

    What is known of open jobs stands in the state store, so a batch reads its own
    results alone. Reports have a folder of their batch's number: readers never see
    one replaced, and a batch that is run again writes the same.
    """
    spark = results.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        tasks.html_report(batch, bucket).write.mode("overwrite").parquet(f"{path}/reports/batch={number}")

    complete_jobs(results, known).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/reports").drop("batch")


def requests(lines: DataFrame, shutdown: bool = False) -> DataFrame:
    """Job requests from JSON ``value`` lines, with accepted and, where a manager that shuts down turns one away, blocked."""
    parsed = F.from_json("value", "type string, taskId string, s3Bucket string, key string, outputFile string, workers int, terminate boolean")
    rows = lines.select(parsed.alias("r")).select("r.*")
    known = (F.coalesce(F.trim("taskId"), F.lit("")) != "") & F.col("type").eqNullSafe(F.lit("newTask"))
    blocked = F.when(known & F.lit(shutdown), F.concat(F.lit("Unable to receive task "), "taskId", F.lit("\nManager will be terminating soon...")))
    return rows.withColumn("terminate", F.coalesce("terminate", F.lit(False))).withColumn("accepted", known & F.lit(not shutdown)).withColumn("blocked", blocked)


def worker_tasks(lines: DataFrame) -> DataFrame:
    """Task messages to workers from JSON ``value`` lines; without taskId, url or analysis they are not ``parsed``."""
    rows = lines.select(F.from_json("value", "taskId string, subTaskId string, url string, analysis string").alias("r")).select("r.*")
    whole = F.col("taskId").isNotNull() & F.col("url").isNotNull() & F.col("analysis").isNotNull()
    return rows.select(F.col("taskId").alias("task_id"), F.coalesce("subTaskId", "taskId").alias("sub_task_id"), "analysis", "url", whole.alias("parsed"))


def worker_results(lines: DataFrame) -> DataFrame:
    """Results from JSON ``value`` lines: optional fields are empty where missing. Without taskId, subTaskId or type they are not ``parsed`` and have no status: they are kept for another try, not failed."""
    rows = lines.select(F.from_json("value", "type string, taskId string, subTaskId string, analysis string, url string, result string, error string").alias("r")).select("r.*")
    whole = F.col("taskId").isNotNull() & F.col("subTaskId").isNotNull() & F.col("type").isNotNull()
    status = F.when(~whole, None).when(F.col("type") == "jobDone", "SUCCEEDED").otherwise("FAILED")
    return rows.select(F.col("taskId").alias("task_id"), F.col("subTaskId").alias("sub_task_id"), status.alias("status"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("analysis", "url", "result", "error")], whole.alias("parsed"))
