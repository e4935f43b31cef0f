"""Task lists, keys, reports, leases, and streams against batch."""

import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import hash31, is_http
from lexiloom.operators import ledger, tasks
from lexiloom.operators.ledger import Subtask, step
from lexiloom.plans.catalogue import QUERIES
from lexiloom.sources import adapters
from lexiloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_task_lists(spark):
    text = ["bad", "POS\thttps://example.com/a.txt", "  ", "missing-url-only\t", "POS\thttps://example.com/a.txt"]
    rows = tasks.parse(spark.createDataFrame([("job-1", i, x) for i, x in enumerate(text)], "task_id string, line_no int, line string")).orderBy("sub_task_id").collect()
    assert [(r.sub_task_id, r.analysis) for r in rows] == [("job-1:0", "POS"), ("job-1:1", "POS")]


def test_task_lists_by_ranges(spark, many_ranges):
    lines = [(job, i, "  " if i % 4 == 1 else f"POS\tu{i}") for job in ("a", "b") for i in range(20) if (job, i % 7) != ("b", 2)]
    rows = tasks.parse(spark.createDataFrame(lines, "task_id string, line_no bigint, line string").repartition(5)).collect()
    want = {}
    for job, i, line in lines:
        if line.strip():
            n = sum(k[0] == job for k in want)
            want[job, f"{job}:{n}"] = f"u{i}"
    assert {(r.task_id, r.sub_task_id): r.url for r in rows} == want and len(rows) == len(want)


def test_keys_and_links(spark):
    url = F.lit("https://example.com/a.txt")
    r = spark.range(1).select(hash31(url).alias("h"), hash31(F.lit("")).alias("e"), *[is_http(F.lit(u)).alias(n) for n, u in (("a", "https://x.org/y"), ("b", "javascript:alert(1)"), ("c", "not a url"), ("d", "https://example .com/<bad>"))]).first()
    assert tuple(r) == ("992a8ae2", "0", True, False, False, False)


def test_report_escapes(spark):
    row = [("<job>", "<s>", "<script>", "javascript:x", "ERROR: <b>'&\"")]
    html = tasks.html_report(spark.createDataFrame(row, "task_id string, sub_task_id string, analysis string, url string, output string"), "b").first().html
    assert "<script>" not in html and "&lt;b&gt;&#x27;&amp;&quot;" in html and "<a href" not in html


def test_first_result_wins(spark):
    rows = [("j", "j:0", 2, "SUCCEEDED", "k", None), ("j", "j:0", 1, "FAILED", None, "e"), ("j", "j:9", 1, "SUCCEEDED", "k", None)]
    results = spark.createDataFrame(rows, "task_id string, sub_task_id string, arrival int, status string, result string, error string")
    known = spark.createDataFrame([("j", "j:0", "POS", "u")], "task_id string, sub_task_id string, analysis string, url string")
    assert tuple(tasks.progress(known, results).first()) == ("j", 1, 1, 1, True)
    assert tasks.summary_rows(known, results).first().output == "ERROR: e"
    assert tasks.unknown_results(results, known).count() == 1


def test_leases():
    s = Subtask()
    assert step(s, "claim", 0, "a", 30, True) == "NOT_FOUND"
    assert step(s, "create", 0, "", 0, True) == "CREATED"
    assert step(s, "claim", 0, "a", 30, True) == "CLAIMED"
    assert step(s, "claim", 10, "b", 30, True) == "OWNED_BY_ANOTHER_WORKER"
    assert step(s, "renew", 10, "b", 30, True) == "LOST_OWNERSHIP"
    assert step(s, "claim", 31, "b", 30, True) == "CLAIMED" and s.attempts == 2
    assert step(s, "complete", 32, "a", 0, True) == "STALE_OWNER"
    assert step(s, "complete", 99, "b", 0, True) == "COMPLETED" and s.status == "SUCCEEDED"
    assert step(s, "result", 99, "b", 0, False) == "DUPLICATE_OR_CONFLICT" and s.status == "SUCCEEDED"
    assert step(s, "dispatch", 99, "", 0, True) == "ALREADY_TERMINAL"


def test_leases_hold_no_group(spark):
    events = adapters.ledger_events(spark, SF)
    want = []
    for key, own in events.toPandas().groupby(ledger.KEY):
        state = Subtask()
        for e in own.sort_values(["at", "seq"]).itertuples(index=False):
            outcome = step(state, e.kind, e.at, e.actor, e.lease, bool(e.success))
            want.append((*key, e.seq, e.at, e.kind, outcome, state.status, state.owner, state.attempts))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    folded = ledger.fold(events)
    got = folded.collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(want)
    assert "InPandas" in (plan := folded._jdf.queryExecution().toString()) and "GroupsInPandas" not in plan


def test_streams_equal_batch(spark, tmp_path):
    events = adapters.ledger_events(spark, SF)
    events.orderBy("at").coalesce(1).write.parquet(f"{tmp_path}/events")
    out = jobs.lease_outcomes(jobs.stream_table(spark, f"{tmp_path}/events"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(out.collect()) == sorted(ledger.fold(events).collect())
    adapters.results_from_events(spark, SF).repartition(3).write.parquet(f"{tmp_path}/results")
    first = jobs.first_results(jobs.stream_table(spark, f"{tmp_path}/results"), f"{tmp_path}/firsts", f"{tmp_path}/cp2")
    batch = QUERIES["first_terminal_result"](spark, SF).select("sub_task_id", "event_id")
    assert sorted(first.select("sub_task_id", "arrival.event_id").collect()) == sorted(batch.collect())


def test_leases_of_a_stream_onto_held_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 3)
    events = adapters.ledger_events(spark, SF).orderBy("at", "seq").toPandas()
    size = len(events) // 8 + 1
    for i in range(8):
        spark.createDataFrame(events[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    out = jobs.lease_outcomes(jobs.stream_table(spark, f"{tmp_path}/events"), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = ledger.fold(spark.createDataFrame(events))
    assert sorted(out.collect()) == sorted(want.collect())
    states = sorted(map(tuple, jobs.lease_states(spark, f"{tmp_path}/out", 7).collect()))
    whole = ledger.fold_onto(spark.createDataFrame(events), jobs.lease_states(spark, f"{tmp_path}/none", -1))
    assert states == sorted(map(tuple, ledger.states_after(whole).collect())) and len(states) > 40
    folders = {p.name for p in (tmp_path / "out" / "states").iterdir()}
    assert folders == {"all=3", "batch=4", "batch=5", "all=6", "batch=7"}  # old ones are gone
    gone = jobs.expired_leases(spark, f"{tmp_path}/out").collect()
    late = {(r.task_id, r.sub_task_id) for r in ledger.expired(jobs.lease_states(spark, f"{tmp_path}/out", 7), F.lit(float(events["at"].max()))).collect()}
    assert late <= {(r.task_id, r.sub_task_id) for r in gone} and late


def test_a_hot_subtask_of_a_stream(spark, tmp_path):
    kinds = F.array(*[F.lit(k) for k in ("claim", "renew", "dispatch", "renew", "claim", "create")])
    rows = spark.range(0, 300_000, 1, 8).select(F.lit("j").alias("task_id"), F.lit("j:0").alias("sub_task_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("at"), F.get(kinds, F.pmod(F.xxhash64("id"), F.lit(6)).cast("int")).alias("kind"), F.concat(F.lit("w"), (F.col("id") % 2).cast("string")).alias("actor"), F.lit(5.0).alias("lease"), F.lit(True).alias("success"))
    rows.where("id < 200000").write.parquet(f"{tmp_path}/in")
    rows.where("id >= 200000").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = jobs.lease_outcomes(jobs.stream_table(spark, f"{tmp_path}/in", 100), f"{tmp_path}/out", f"{tmp_path}/cp")
    digest = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first()
    assert digest(out.select(*ledger.fold(rows).columns)) == digest(ledger.fold(rows))


def test_worker_actions(spark):
    rows = [(False, None, False, None, True, "keep"), (True, "OWNED_BY_ANOTHER_WORKER", False, None, True, "delay"), (True, "ALREADY_TERMINAL", False, None, True, "delete"), (True, "CLAIMED", True, None, True, "keep"), (True, "CLAIMED", False, "STALE_OWNER", True, "keep"), (True, "CLAIMED", False, "COMPLETED", False, "report failure, delete")]
    df = spark.createDataFrame(rows, "parsed boolean, claim string, lost boolean, completion string, success boolean, want string")
    assert all(r.a == r.want for r in df.withColumn("a", tasks.message_action()).collect())
    assert (tasks.workers_needed(10, 3, 1, 7), tasks.workers_needed(100, 1, 2, 7), tasks.workers_needed(1, 1, 5, 7)) == (3, 5, 0)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(jobs._PROVIDER)
    spark.conf.set(jobs._PROVIDER, jobs._ROCKS)
    yield
    spark.conf.set(jobs._PROVIDER, before)


def test_reports_of_a_stream(spark, tmp_path, rocks):
    known = spark.createDataFrame([(f"j{j}", f"j{j}:{n}", "POS", "u") for j in range(4) for n in range(2)], "task_id string, sub_task_id string, analysis string, url string")
    schema = "task_id string, sub_task_id string, arrival int, status string, result string, error string"
    batches = [[("j0", 0), ("j1", 0)], [("j0", 1), ("j0", 1), ("j2", 0)], [("j0", 0), ("j1", 1), ("j9", 1)], [("j2", 0), ("j2", 1), ("j1", 1)]]
    for i, own in enumerate(batches):
        rows = [(j, f"{j}:{n}", 10 * i + k, "SUCCEEDED", f"k{i}", None) for k, (j, n) in enumerate(own)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = jobs.reports(jobs.stream_table(spark, f"{tmp_path}/in"), known, "b", f"{tmp_path}/out", f"{tmp_path}/cp")
    every = tasks.html_report(tasks.summary_rows(known, spark.read.parquet(f"{tmp_path}/in")), "b").where("task_id != 'j3'")
    assert sorted(map(tuple, got.select("task_id", "report_key", "html").collect())) == sorted(map(tuple, every.collect()))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"reports"}  # no results are kept to be read again
    written = [len(spark.read.parquet(str(p)).collect()) for p in sorted((tmp_path / "out" / "reports").iterdir())]
    assert sum(written) == 3 and max(written) == 1  # each once, in the batch that completes it


def test_messages(spark):
    def lines(*texts):
        return spark.createDataFrame([(t,) for t in texts], "value string")

    got = jobs.worker_results(lines('{"type":"jobDone","taskId":"j","subTaskId":"j:0","result":"k"}', '{"type":"jobFailed","taskId":"j","subTaskId":"j:1"}', '{"type":"jobDone","taskId":"j"}', "no json")).collect()
    assert [(r.sub_task_id, r.status, r.result, r.error, r.parsed) for r in got] == [("j:0", "SUCCEEDED", "k", "", True), ("j:1", "FAILED", "", "", True), (None, None, "", "", False), (None, None, "", "", False)]
    got = jobs.worker_tasks(lines('{"taskId":"j","url":"u","analysis":"POS"}', '{"taskId":"j","subTaskId":"j:3","url":"u"}')).collect()
    assert [(r.sub_task_id, r.parsed) for r in got] == [("j", True), ("j:3", False)]
    text = lines('{"type":"newTask","taskId":"j","s3Bucket":"b"}', '{"type":"newTask","taskId":" "}', '{"type":"x","taskId":"j"}')
    assert [(r.accepted, r.blocked) for r in jobs.requests(text).collect()] == [(True, None), (False, None), (False, None)]
    assert [(r.accepted, r.blocked) for r in jobs.requests(text, shutdown=True).collect()] == [(False, "Unable to receive task j\nManager will be terminating soon..."), (False, None), (False, None)]


def test_fetched_documents(spark):
    known = spark.createDataFrame([("j", "j:0", "u"), ("j", "j:1", "v"), ("j", "j:2", None)], "task_id string, sub_task_id string, url string")
    docs = spark.createDataFrame([("u", "text"), ("u", "text"), (None, "x")], "url string, text string")
    assert {(r.sub_task_id, r.text) for r in tasks.fetch(known, docs).collect()} == {("j:0", "text"), ("j:1", None), ("j:2", None)}


def test_analyses_of_lines(spark):
    rows = [(1, "CONSTITUENCY", "Dogs chased 3 cats. They ran"), (2, "DEPENDENCY", "Dogs chased cats. They ran"), (3, "NEW", "x"), (4, "POS", "  \n\n"), (5, "DEPENDENCY", "no verb here")]
    got = {r.doc_id: r.output for r in tasks.analyze(spark.createDataFrame(rows, "doc_id int, analysis string, text string")).collect()}
    assert got[1] == "INPUT: Dogs chased 3 cats. They ran\nOUTPUT: (ROOT (FRAG (NNP Dogs) (VBD chased) (CD 3) (NN cats.)))\n\n"
    assert got[2].split("OUTPUT: ")[1] == "dep(chased-2, Dogs-1)\nroot(ROOT-0, chased-2)\ndep(chased-2, cats.-3)\n\n"
    assert got[3].endswith("OUTPUT: Unknown analysis type: NEW\n\n") and got[4] == "" and "root(ROOT-0, no-1)" in got[5]


def test_job_events():
    j = ledger.Job()
    say = lambda kind, at=0, actor="m", n=0: ledger.job_step(j, kind, at, actor, 30, n)
    assert say("lease") == "NOT_FOUND" and say("create", 5) == "CREATED" and say("create") == "EXISTS" and j.created == 5
    assert say("lease", 10) == "LEASED" and say("lease", 20, "other") == "REFUSED" and say("lease", 41, "other") == "LEASED"
    assert say("save") == "SAVED" and j.status == "DISPATCHING" and say("finalize") == "REFUSED"
    assert say("parsed", n=2) == "PARSED" and say("sent") == "RUNNING" and say("done") == "COUNTED" and say("finalize") == "REFUSED"
    assert say("done") == "COUNTED" and say("finalize", 50) == "FINALIZING" and say("finalize", 60) == "REFUSED" and say("finalize", 81, "other") == "FINALIZING"
    assert say("complete") == "REFUSED" and say("notify") == "REFUSED" and say("complete", 90, "other") == "COMPLETED" and j.notification == "PENDING"
    assert say("notify") == "NOTIFIED" and j.notification == "SENT" and say("fail") == "FAILED" and j.status == "FAILED"


def test_long_line_is_analysed_in_proportion_to_its_words(spark):
    words = [*[f"w{i}" for i in range(20_000)], "walked", "end.", "more"]
    began = time.time()
    (row,) = tasks.analyze(spark.createDataFrame([(1, "DEPENDENCY", " ".join(words))], "doc_id bigint, analysis string, text string")).collect()
    lines = row.output.split("\nOUTPUT: ")[1].strip("\n").split("\n")
    assert lines[0] == "dep(walked-20001, w0-1)" and lines[20_000:] == ["root(ROOT-0, walked-20001)", "dep(walked-20001, end.-20002)"]
    assert time.time() - began < 30
