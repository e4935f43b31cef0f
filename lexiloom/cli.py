"""Command line: the six commands of the similarity pipeline, and job reports."""

from __future__ import annotations

import sys
from types import SimpleNamespace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import six
from .operators import evaluation, mi, ngrams, similarity, tasks, templates
from .sources import tables
from .sources.shared import cut


#: Options of each command: those that it must have, and others with what they are without.
COMMANDS: dict[str, tuple[tuple[str, ...], dict[str, str | None]]] = {
    "extract-triples": (("input", "output"), {"stemAll": "true", "filterAux": "true", "exclude": None}),
    "global-counts": (("input", "output"), {}),
    "store-triples": (("triples", "output"), {}),
    "compute-mi": (("output",), {"triples": None, "stored": None, "paths": None}),
    "make-test-path-list": (("pos", "neg", "output"), {}),
    "filter-mi": (("mi", "paths", "output"), {}),
    "score-eval": (("mi", "pos", "neg", "out"), {"compareWith": None, "useMaxSwap": "false"}),
    "submit": (("input", "taskId", "output"), {}),
    "report": (("tasks", "results", "bucket", "output"), {}),
}


def options(words: list[str]) -> dict[str, str]:
    """``--name value`` pairs; a name without a value is true, the last of a name counts, other words don't."""
    out, name = {}, None
    for w in words:
        if w.startswith("--"):
            name = w[2:]
            out[name] = "true"
        elif name is not None:
            out[name], name = w, None
    return out


def arguments(argv: list[str]) -> SimpleNamespace:
    """Command and options; unknown options are left out. Raises ValueError for wrong usage."""
    if not argv or argv[0] not in COMMANDS:
        raise ValueError(f"commands: {', '.join(COMMANDS)}")
    required, optional = COMMANDS[argv[0]]
    given = options(argv[1:])
    if "out" in required:
        given.setdefault("out", given.get("output"))
    if argv[0] == "compute-mi" and "stored" not in given:
        required += ("triples",)
    if missing := [f"--{r}" for r in required if given.get(r) is None]:
        raise ValueError(f"{argv[0]} needs {', '.join(missing)}")
    return SimpleNamespace(command=argv[0], **optional | {k: v for k, v in given.items() if k in required or k in optional})


def _yes(value: str) -> bool:
    return value.lower() == "true"


def run(spark: SparkSession, argv: list[str]) -> int:
    """0: done; 2: wrong usage. A failed job raises."""
    try:
        a = arguments(argv)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    if a.command == "extract-triples":
        out = ngrams.triples(tables.text_lines(spark, a.input, a.exclude), _yes(a.stemAll), _yes(a.filterAux))
        tables.write_tsv(out, a.output)
    elif a.command == "global-counts":
        counts = mi.slot_word_counts(tables.read_triples(spark, a.input))
        tables.write_tsv(counts, f"{a.output}/slot_word")
        tables.write_tsv(mi.slot_totals(counts), f"{a.output}/slot_totals", one_file=True)
    elif a.command == "store-triples":
        mi.store(tables.read_triples(spark, a.triples), a.output)
    elif a.command == "compute-mi":
        paths = tables.read_paths(spark, a.paths) if a.paths else None
        out = mi.of_stored(spark, a.stored, paths) if a.stored else mi.mutual_information(tables.read_triples(spark, a.triples), paths)
        tables.write_tsv(out, a.output)
    elif a.command == "make-test-path-list":
        tables.write_tsv(templates.whitelist(tables.read_pairs(spark, a.pos, a.neg)).orderBy("pid"), a.output, one_file=True)
    elif a.command == "filter-mi":
        rows = tables.read_mi(spark, a.mi).select("pid", "slot", "word", "mi", "cnt")
        tables.write_tsv(mi.keep_paths(rows, tables.read_paths(spark, a.paths)), a.output)
    elif a.command == "score-eval":
        scores = cut(similarity.path_similarity(tables.read_mi(spark, a.mi), tables.read_pairs(spark, a.pos, a.neg), use_max_swap=_yes(a.useMaxSwap)))
        shown = scores.orderBy("ord").select("lhs", "rhs", "label", "norm_lhs", "norm_rhs", six(F.col("score")).alias("score"))
        tables.write_tsv(shown, f"{a.out}/scores", header=True, one_file=True)
        curve = evaluation.pr_curve(scores).orderBy(F.col("threshold").desc()).select(*[six(F.col(c)).alias(c) for c in ("threshold", "precision", "recall")])
        tables.write_tsv(curve, f"{a.out}/pr_curve", header=True, one_file=True)
        tables.write_tsv(evaluation.best_threshold(scores), f"{a.out}/best_threshold", header=True, one_file=True)
        before = tables.read_scores(spark, a.compareWith) if a.compareWith else None
        tables.write_tsv(evaluation.error_analysis(scores, previous=before).orderBy("category", "rank").drop("rank"), f"{a.out}/errors", header=True, one_file=True)
    elif a.command == "submit":
        tasks.parse(tables.read_tasks(spark, a.input, a.taskId)).write.mode("overwrite").parquet(a.output)
    else:
        known, results = spark.read.parquet(a.tasks), spark.read.parquet(a.results)
        tables.write_reports(tasks.html_report(tasks.summary_rows(known, results), a.bucket), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("lexiloom").getOrCreate(), sys.argv[1:]))
