"""Text-analysis jobs as tables: tasks, results, progress and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html, fields, hash31, link_or_text, safe_segment, trim_control
from .scan import running

# Style of the report.
_STYLE = "body{font-family:Arial,sans-serif;margin:25px;background:#f9f9f9;}h1{color:#333;border-bottom:2px solid #007bff;padding-bottom:8px;}table{width:100%;border-collapse:collapse;margin-top:20px;}th,td{border:1px solid #ddd;padding:8px;text-align:left;}th{background:#007bff;color:white;}.error{background:#fdd;color:#900;font-weight:bold;}"
TERMINAL = ("SUCCEEDED", "FAILED")


def parse(lines: DataFrame) -> DataFrame:
    """``lines(task_id, line_no, line)`` -> task_id, sub_task_id, analysis, url.

    Valid lines alone are numbered, from 0, within ranges that follow the lists,
    so that no task gets a whole list. Lines of one number follow each other by
    their text.
    """
    f = fields(F.col("line"))
    rows = lines.where((trim_control(F.col("line")) != "") & (F.size(f) >= 2)).select("task_id", "line_no", "line")
    rows = running(rows, ["task_id"], ["line_no", "line"], {"upto": ("sum", F.lit(1))})
    rows = rows.select("task_id", (F.col("upto") - 1).alias("n"), trim_control(F.get(f, F.lit(0))).alias("analysis"), trim_control(F.get(f, F.lit(1))).alias("url"))
    return rows.select("task_id", F.concat("task_id", F.lit(":"), F.col("n").cast("string")).alias("sub_task_id"), "analysis", "url")


def result_keys(tasks: DataFrame) -> DataFrame:
    sub = safe_segment(F.col("sub_task_id"))
    key = F.concat(F.lit("results/"), safe_segment(F.col("task_id")), F.lit("/"), sub, F.lit("_"), safe_segment(F.col("analysis")), F.lit("_"), hash31(F.col("url")), F.lit(".txt"))
    return tasks.select("task_id", "sub_task_id", key.alias("result_key"), F.concat(sub, F.lit("_inputfile")).alias("input_file"), F.concat(sub, F.lit("_output.txt")).alias("output_file"))


def known_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results of subtasks that exist; ``unknown_results`` has the others."""
    return results.join(tasks.select("task_id", "sub_task_id"), ["task_id", "sub_task_id"], "left_semi")


def unknown_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    return results.join(tasks.select("task_id", "sub_task_id"), ["task_id", "sub_task_id"], "left_anti")


def first_terminal(results: DataFrame) -> DataFrame:
    """The first result of each subtask, by arrival; later ones change nothing.

    An aggregate rather than a window, so that a subtask whose result was sent
    over and over is folded before the shuffle. A message without a status is no
    result (it could not be parsed).
    """
    results = results.where("status is not null")
    rest = [c for c in results.columns if c not in ("task_id", "sub_task_id")]
    folded = results.groupBy("task_id", "sub_task_id").agg(F.min_by(F.struct(*rest), "arrival").alias("r"))
    return folded.select("task_id", "sub_task_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def progress(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Expected and completed subtasks of each job, and whether it can be finalised."""
    done = first_terminal(known_results(results, tasks)).select("task_id", "sub_task_id", "status")
    rows = tasks.join(done, ["task_id", "sub_task_id"], "left").groupBy("task_id")
    out = rows.agg(F.count(F.lit(1)).alias("expected"), F.count("status").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return out.withColumn("complete", F.col("expected") == F.col("completed"))


def output_cell() -> Column:
    """The output key of a result, or its error."""
    return F.when(F.col("status") == "FAILED", F.concat(F.lit("ERROR: "), F.coalesce("error", F.lit("")))).otherwise(F.coalesce("result", F.lit("")))


def summary_rows(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """task_id, sub_task_id, analysis, url and the output key or error of finished subtasks."""
    done = first_terminal(known_results(results, tasks))
    return tasks.join(done, ["task_id", "sub_task_id"]).select("task_id", "sub_task_id", "analysis", "url", output_cell().alias("output"))


def _row(bucket: str) -> Column:
    # Markup of the report.
    link = F.concat(F.lit(f"https://{bucket}.s3.us-east-1.amazonaws.com/"), F.url_encode(F.coalesce("output", F.lit(""))))
    cell = F.when(F.startswith("output", F.lit("ERROR:")), F.concat(F.lit("<td class='error'>"), escape_html(F.col("output")), F.lit("</td>")))
    cell = cell.otherwise(F.concat(F.lit("<td>"), link_or_text(link, F.lit("View Output")), F.lit("</td>")))
    plain = [F.concat(F.lit("<td>"), escape_html(F.col(c)), F.lit("</td>")) for c in ("sub_task_id", "analysis")]
    return F.concat(F.lit("<tr>"), *plain, F.lit("<td>"), link_or_text(F.col("url"), F.col("url")), F.lit("</td>"), cell, F.lit("</tr>"))


def html_report(rows: DataFrame, bucket: str) -> DataFrame:
    """One page for each job: task_id, report_key, html; rows in order of sub_task_id as text.

    A report is one string by nature, as large as its job's task list.
    """
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub_task_id", _row(bucket).alias("h")))), lambda x: x["h"]), "")
    out = rows.groupBy("task_id").agg(body.alias("body"))
    title = escape_html(F.col("task_id"))
    # Markup of the report.
    html = F.concat(
        F.lit("<html><head><title>Task "), title, F.lit(f" - Analysis Summary</title><style>{_STYLE}</style></head><body><h1>Results for Task: "), title,
        F.lit("</h1><table><tr><th>Subtask</th><th>Analysis Type</th><th>Input File</th><th>Output / Error</th></tr>"), "body", F.lit("</table></body></html>"),
    )
    return out.select("task_id", F.concat(F.lit("reports/"), "task_id", F.lit("/summary.html")).alias("report_key"), html.alias("html"))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, "[ \\t]+"), "")


def _tag(w: Column) -> Column:
    """Part of speech by a word's shape."""
    return F.when(w.rlike("^[0-9][0-9.,]*$"), "CD").when(w.rlike("^[A-Z]"), "NNP").when(w.rlike("ing$"), "VBG").when(w.rlike("ed$"), "VBD").when(w.rlike("ly$"), "RB").otherwise("NN")


def tag_words(line: Column) -> Column:
    """``word (TAG) `` of every word: a stand-in for a trained tagger, by the word's shape."""
    return F.array_join(F.transform(_words(line), lambda w: F.concat(w, F.lit(" ("), _tag(w), F.lit(") "))), "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _over_first_sentence(line: Column, body) -> Column:
    """``body`` of the words up to the first that ends in a stop; without words the empty text."""

    def sentence(words: Column) -> Column:
        stop = F.array_position(F.transform(words, lambda w: w.rlike("[.!?]$")), True)
        size = _let(stop, lambda n: F.when(n == 0, F.size(words)).otherwise(n).cast("int"))
        return F.when(F.size(words) > 0, _let(F.slice(words, F.lit(1), size), body)).otherwise("")

    return _let(_words(line), sentence)


def constituents(line: Column) -> Column:
    """A flat tree over the first sentence: a stand-in for a trained parser, with its output's form."""
    leaf = lambda w: F.concat(F.lit("("), _tag(w), F.lit(" "), w, F.lit(")"))
    return _over_first_sentence(line, lambda words: F.concat(F.lit("(ROOT (FRAG "), F.array_join(F.transform(words, leaf), " "), F.lit("))")))


def dependencies(line: Column) -> Column:
    """Each word of the first sentence under its first verb (else its first word), one to a line: a stand-in likewise."""

    at = lambda w, i: F.concat(w, F.lit("-"), i.cast("string"))

    def under(words: Column, head: Column) -> Column:
        def relations(name: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                return F.when(i + 1 == head, F.concat(F.lit("root(ROOT-0, "), at(w, i + 1), F.lit(")"))).otherwise(F.concat(F.lit("dep("), name, F.lit(", "), at(w, i + 1), F.lit(")")))

            return F.array_join(F.transform(words, one), "\n")

        return _let(at(F.get(words, head - 1), head), relations)

    def listed(words: Column) -> Column:
        # the head is found once a line, not once a word
        verb = F.array_position(F.transform(words, lambda w: _tag(w).isin("VBD", "VBG")), True)
        return _let(verb, lambda v: _let(F.when(v == 0, 1).otherwise(v).cast("int"), lambda head: under(words, head)))

    return _over_first_sentence(line, listed)


def fetch(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """``tasks`` with the text of ``documents(url, text)``; null where there is none. One row a task, however often an address is held."""
    held = documents.where("url is not null").groupBy("url").agg(F.max("text").alias("text"))
    return tasks.join(held, "url", "left").select(*tasks.columns, "text")


def analyze(documents: DataFrame, analyzers: dict | None = None) -> DataFrame:
    """``documents(doc_id, analysis, text)`` -> doc_id, output: line by line, blanks left out.

    An unknown analysis is no error: its name is the output. ``analyzers`` adds
    or replaces column functions of a line by name.
    """
    known = {"POS": tag_words, "CONSTITUENCY": constituents, "DEPENDENCY": dependencies} | (analyzers or {})

    def output(line: Column) -> Column:
        out = F.concat(F.lit("Unknown analysis type: "), F.col("analysis"))
        for name, function in known.items():
            out = F.when(F.col("analysis") == name, function(line)).otherwise(out)
        return F.concat(F.lit("INPUT: "), line, F.lit("\nOUTPUT: "), out, F.lit("\n\n"))

    lines = F.filter(F.split("text", "\r\n|\r|\n"), lambda x: x.rlike(r"[^\p{javaWhitespace}]"))
    return documents.select("doc_id", F.array_join(F.transform(lines, output), "").alias("output"))


def dispatch_plan(subtasks: DataFrame, now: Column, stale_after: str = "300 seconds") -> DataFrame:
    """Subtasks that a recovery sweep sends again, each with the reason."""
    stale = (F.col("status") == "DISPATCHED") & (F.col("dispatched_at") < now - F.expr(f"interval {stale_after}"))
    expired = (F.col("status") == "PROCESSING") & (F.col("lease_expires_at") < now)
    reason = F.when(F.col("status") == "PENDING", "pending").when(stale, "stale").when(expired, "expired")
    return subtasks.select("task_id", "sub_task_id", reason.alias("reason")).where("reason is not null")


def message_action() -> Column:
    """What a worker does with a message, from columns parsed, claim, lost, completion, success."""
    return (
        F.when(~F.col("parsed"), "keep")
        .when(F.col("claim").isNull() | (F.col("claim") == "NOT_FOUND"), "keep")
        .when(F.col("claim") == "OWNED_BY_ANOTHER_WORKER", "delay")
        .when(F.col("claim") == "ALREADY_TERMINAL", "delete")
        .when(F.col("lost"), "keep")
        .when(F.col("completion").isNull() | F.col("completion").isin("STALE_OWNER", "NOT_FOUND"), "keep")
        .when(F.col("completion") == "ALREADY_TERMINAL", "delete")
        .when(F.col("success"), "report success, delete")
        .otherwise("report failure, delete")
    )


def workers_needed(tasks: int, tasks_per_worker: int, running: int, limit: int) -> int:
    """How many workers to start: tasks by ratio, less those running, up to the limit."""
    return max(0, min(-(-tasks // tasks_per_worker), limit) - running)


def workers_column(tasks: Column, tasks_per_worker: int, running: int, limit: int) -> Column:
    """``workers_needed`` of a column of task counts."""
    wanted = F.ceil(tasks / F.lit(tasks_per_worker))
    return F.greatest(F.lit(0), F.least(wanted, F.lit(limit)) - F.lit(running)).cast("bigint")
