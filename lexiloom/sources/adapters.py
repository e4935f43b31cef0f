"""The driver's tables in the shapes that the operators read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table


def _two_slots(rows: DataFrame) -> DataFrame:
    two = F.array(F.struct(F.lit("X").alias("slot"), F.col("x").alias("word")), F.struct(F.lit("Y").alias("slot"), F.col("y").alias("word")))
    return rows.select("pid", F.explode(two).alias("s"), "cnt").select("pid", "s.slot", "s.word", "cnt")


def triples_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("pid"), F.col("user_id").cast("string").alias("x"), F.get_json_object("props", "$.k").alias("y"), F.lit(1).cast("bigint").alias("cnt"))
    return _two_slots(rows)


def triples_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are part types and sizes, as ``X standard s3 Y``."""
    pid = F.concat(F.lit("X "), F.lower("p_type"), F.lit(" s"), (F.col("p_size") % 8).cast("string"), F.lit(" Y"))
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), pid.alias("pid"), F.col("p_brand").alias("y"))
    supplier = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("x"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("cnt"))
    return _two_slots(lines.join(part, "l_partkey").join(supplier, "l_suppkey").select("pid", "x", "y", "cnt"))


def dealt_out(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores where the files have fewer parts than that: each row becomes thousands."""
    wanted = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= wanted else docs.repartition(wanted)


def ngrams_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the n-gram format from every window of four words of every text."""
    docs = dealt_out(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    # neighbours side by side, cut before the explode, which copies whole arrays
    four = F.arrays_zip(*[F.slice("w", i + 1, F.size("w") - 3).alias(f"w{i}") for i in range(4)])
    window = docs.select("doc_id", words.alias("w")).where("size(w) >= 4").select("doc_id", F.explode(four).alias("v")).select("doc_id", "v.*")
    w = [F.col(c) for c in window.columns[1:]]
    forms = [
        F.concat(w[0], F.lit("/NN/nsubj/2 "), w[1], F.lit("/VBD/ROOT/0 "), w[2], F.lit("/NN/dobj/2")),
        F.concat(w[0], F.lit("/NN/nsubj/2 "), w[1], F.lit("/VBD/ROOT/0 "), w[2], F.lit("/IN/prep/2 "), w[3], F.lit("/NN/pobj/3")),
        F.concat(w[0], F.lit("/NN/nsubj/2 "), w[1], F.lit("/VBD/ROOT/0 "), w[3], F.lit("/NN/prep_with/2")),
        F.concat(w[2], F.lit("/NN/dobj/2 "), w[1], F.lit("/VBD/ROOT/0 "), w[0], F.lit("/NN/nsubj/2")),
    ]
    form = reduce(lambda out, i: F.when(F.col("doc_id") % 4 == i, forms[i]).otherwise(out), (1, 2, 3), forms[0])
    return window.select(F.concat(w[1], F.lit("\t"), form, F.lit("\t"), (1 + F.col("doc_id") % 7).cast("string"), F.lit("\t1999,1")).alias("value"))


def pairs_from_paths(triples: DataFrame, ahead: int = 3) -> DataFrame:
    """Pairs of each path with the next few, labelled by rule; some are written Y ... X.

    Paths are distinct part types or event types, a small and fixed set.
    """
    paths = triples.select("pid").distinct()
    in_order = Window.orderBy("pid")
    rows = paths.select("pid", F.row_number().over(in_order).alias("n"), *[F.lead("pid", k).over(in_order).alias(f"p{k}") for k in range(1, ahead + 1)])
    long = rows.select("pid", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("other")) for k in range(1, ahead + 1)])).alias("o")).where("o.other is not null")
    turned = F.regexp_replace(F.regexp_replace("o.other", "^X ", "Y "), " Y$", " X")
    return long.select(
        (F.col("n") * 10 + F.col("o.k")).cast("bigint").alias("ord"),
        F.col("pid").alias("lhs"),
        F.when(F.col("o.k") == 2, turned).otherwise(F.col("o.other")).alias("rhs"),
        F.when((F.length("pid") + F.length("o.other")) % 3 == 0, 1).otherwise(0).alias("label"),
    )


def task_lines_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("POS", "CONSTITUENCY", "DEPENDENCY", "SENTIMENT")])
    page = F.col("page_id")
    line = F.when(page % 10 == 7, F.lit("missing-url-only\t")).when(page % 10 == 3, F.lit("  ")).otherwise(F.concat(F.get(kinds, (page % 4).cast("int")), F.lit("\t "), "url", F.lit(" ")))
    return read_table(spark, sf_dir, "pages").select(F.concat(F.lit("job-"), (page % 5).cast("string")).alias("task_id"), page.alias("line_no"), line.alias("line"))


def results_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and conflicting results of the jobs of ``tasks_from_events``."""
    e = read_table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    job = F.concat(F.lit("job-"), (F.col("user_id") % 20).cast("string"))
    return e.select(
        job.alias("task_id"),
        F.concat(job, F.lit(":"), (F.col("event_id") % 7).cast("string")).alias("sub_task_id"),
        F.struct("ts", "event_id").alias("arrival"),
        F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.when(~failed, F.concat(F.lit("results/"), F.col("event_id").cast("string"), F.lit(".txt"))).alias("result"),
        F.when(failed, F.concat(F.lit("<bad> & "), F.col("event_id").cast("string"))).alias("error"),
    )


def tasks_from_events(spark: SparkSession) -> DataFrame:
    """Subtasks 0 to 5 of each of 20 jobs; results of a seventh are unknown."""
    job = F.concat(F.lit("job-"), (F.col("id") % 20).cast("string"))
    n = F.floor(F.col("id") / 20).cast("string")
    return spark.range(120).select(job.alias("task_id"), F.concat(job, F.lit(":"), n).alias("sub_task_id"), F.lit("POS").alias("analysis"), F.concat(F.lit("https://example.com/"), n, F.lit(".txt")).alias("url"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lease events of subtasks, by rule from events: one create, then claims, renewals and results."""
    e = read_table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(x) for x in ("claim", "renew", "dispatch", "claim", "complete", "renew", "claim", "result")])
    job = F.concat(F.lit("job-"), (F.col("user_id") % 50).cast("string"))
    first = F.col("event_id") % 5 == 0
    return e.select(
        job.alias("task_id"),
        F.concat(job, F.lit(":"), (F.col("event_id") % 3).cast("string")).alias("sub_task_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"),
        F.when(first, "create").otherwise(F.get(kinds, (F.col("event_id") % 8).cast("int"))).alias("kind"),
        F.concat(F.lit("worker-"), (F.col("user_id") % 2).cast("string")).alias("actor"),
        F.lit(3.6e9).alias("lease"),
        (F.col("event_type") != "error").alias("success"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the jobs of ``ledger_events``, by rule from events, between those of their subtasks."""
    e = read_table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(x) for x in ("lease", "save", "parsed", "finalize", "complete", "notify", "finalize", "lease", "complete", "create", "finalize")])
    kind = F.when(F.col("event_id") % 7 == 0, "create").when(F.col("event_id") % 501 == 0, "fail").otherwise(F.get(kinds, (F.col("event_id") % 11).cast("int")))
    return e.select(
        F.concat(F.lit("job-"), (F.col("user_id") % 50).cast("string")).alias("task_id"),
        (F.col("event_id") + (1 << 40)).alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"),
        kind.alias("kind"),
        F.concat(F.lit("manager-"), (F.col("user_id") % 2).cast("string")).alias("actor"),
        F.lit(3.6e9).alias("lease"),
        (F.lit(2) + F.col("event_id") % 2).cast("bigint").alias("expected"),
    )


def subtask_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtasks in all states, by rule from events."""
    e = read_table(spark, sf_dir, "events")
    states = F.array(*[F.lit(x) for x in ("PENDING", "DISPATCHED", "PROCESSING", "SUCCEEDED", "FAILED")])
    job = F.concat(F.lit("job-"), (F.col("user_id") % 20).cast("string"))
    return e.select(job.alias("task_id"), F.concat(job, F.lit(":"), F.col("event_id").cast("string")).alias("sub_task_id"), F.get(states, (F.col("event_id") % 5).cast("int")).alias("status"), F.col("ts").alias("dispatched_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("lease_expires_at"))


def result_messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON results by rule from events: whole, failed, without optional fields, without a subtask, and no JSON."""
    e, n = read_table(spark, sf_dir, "events"), F.col("event_id")
    job, sub = F.concat(F.lit("job-"), (F.col("user_id") % 20).cast("string")), F.concat(F.lit("s"), (n % 7).cast("string"))
    key = F.concat(F.lit("results/"), n.cast("string"))
    none = F.lit(None).cast("string")

    def message(type_, sub_task, result, error, url=F.lit("https://x.org/a"), analysis=F.lit("POS")):
        return F.to_json(F.struct(type_.alias("type"), job.alias("taskId"), sub_task.alias("subTaskId"), result.alias("result"), error.alias("error"), url.alias("url"), analysis.alias("analysis")))

    done, failed = F.lit("jobDone"), F.lit("failedjob")
    value = F.when(n % 5 == 0, message(done, sub, key, none)).when(n % 5 == 1, message(failed, sub, none, F.concat(F.lit('"bad" '), n.cast("string")))).when(n % 5 == 2, message(done, sub, key, none, none, none)).when(n % 5 == 3, message(done, none, key, none)).otherwise(F.concat(F.lit("no json "), n.cast("string")))
    return e.select(value.alias("value"))


def request_messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON requests by rule from events; some have another type, a blank id, or say when to stop."""
    e, n = read_table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(n % 9 == 4, F.lit("other")).otherwise("newTask")
    job = F.when(n % 11 == 5, F.lit("  ")).otherwise(F.concat(F.lit("t"), n.cast("string")))
    fields = F.struct(kind.alias("type"), job.alias("taskId"), F.lit("b").alias("s3Bucket"), F.concat(F.lit("in/"), n.cast("string")).alias("key"), F.lit("out").alias("outputFile"), (n % 4).cast("int").alias("workers"), F.when(n % 3 == 0, F.lit(True)).alias("terminate"))
    return e.select(F.to_json(fields).alias("value"))


def message_states_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of worker messages by rule from events: parsed, claim, lost, completion and success."""
    e, n = read_table(spark, sf_dir, "events"), F.col("event_id")
    named = lambda names, by: F.get(F.array(*[F.lit(x) for x in names]), (by % (len(names) + 1)).cast("int"))  # noqa: E731  one more is null
    claims = ("CLAIMED", "ALREADY_OWNED", "CLAIMED", "OWNED_BY_ANOTHER_WORKER", "ALREADY_TERMINAL", "CLAIMED", "NOT_FOUND")
    completions = ("COMPLETED", "COMPLETED", "STALE_OWNER", "ALREADY_TERMINAL", "NOT_FOUND")
    return e.select((n % 13 != 0).alias("parsed"), named(claims, n).alias("claim"), (F.col("user_id") % 6 == 0).alias("lost"), named(completions, F.floor(n / 8)).alias("completion"), (F.col("event_type") != "error").alias("success"))
