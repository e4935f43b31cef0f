"""Jobs, leases and results as folds of events, in batch and in streams.

An event of a subtask has task_id, sub_task_id, seq, at (seconds), kind, actor,
lease (seconds) and success; one of a job has task_id, seq, at, kind, actor, lease
and expected. ``step`` and ``job_step`` are the whole rules; keys are independent,
so Spark deals them out and runs a rule over each key's events in order of (at,
seq). In batch only the state is held, not the events of a key. What a job must
know of its subtasks (one was sent, one is done) comes as events from the fold of
subtasks, so a job's state is small however many subtasks it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["task_id", "sub_task_id"]
OUTCOMES = "task_id string, sub_task_id string, seq bigint, at double, kind string, outcome string, status string, owner string, attempts bigint"
JOB_OUTCOMES = "task_id string, seq bigint, at double, kind string, outcome string, status string, owner string, expires double, created double, parsed boolean, expected bigint, completed bigint, notification string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class Subtask:
    """State of one subtask; unknown until it is created."""

    status: str = ""
    owner: str = ""
    expires: float = 0.0
    started: float = 0.0
    dispatched: float = 0.0
    attempts: int = 0

    @property
    def terminal(self) -> bool:
        return self.status in ("SUCCEEDED", "FAILED")

    def leased(self, now: float) -> bool:
        return self.status == "PROCESSING" and self.expires >= now


def step(s: Subtask, kind: str, at: float, actor: str, lease: float, success: bool) -> str:
    """Apply one event to a subtask; returns the outcome's name."""
    if kind == "create":
        if s.status:
            return "EXISTS"
        s.status = "PENDING"
        return "CREATED"
    if not s.status:
        return "UNKNOWN_JOB_OR_SUBTASK" if kind == "result" else "NOT_FOUND"
    if s.terminal:
        return "DUPLICATE_OR_CONFLICT" if kind == "result" else "ALREADY_TERMINAL"
    if kind == "dispatch":
        if s.leased(at):
            return "REFUSED"
        s.status, s.owner, s.expires, s.dispatched = "DISPATCHED", "", 0.0, at
        s.attempts += 1
        return "DISPATCHED"
    if kind == "claim":
        if s.leased(at):
            if s.owner != actor:
                return "OWNED_BY_ANOTHER_WORKER"
            s.expires = at + lease
            return "ALREADY_OWNED"
        s.status, s.owner, s.expires, s.started = "PROCESSING", actor, at + lease, s.started or at
        s.attempts += 1
        return "CLAIMED"
    if kind == "renew":
        if not s.leased(at) or s.owner != actor:
            return "LOST_OWNERSHIP"
        s.expires = at + lease
        return "RENEWED"
    if kind == "complete" and (s.status != "PROCESSING" or s.owner != actor):
        return "STALE_OWNER"
    if kind in ("complete", "result"):
        s.status = "SUCCEEDED" if success else "FAILED"
        return "COMPLETED" if kind == "complete" else "ACCEPTED"
    raise ValueError(f"no such event: {kind}")


@dataclass
class Job:
    """State of one job; unknown until it is created."""

    status: str = ""
    owner: str = ""
    expires: float = 0.0
    created: float = 0.0
    parsed: bool = False
    expected: int = 0
    completed: int = 0
    notification: str = "NONE"


def job_step(j: Job, kind: str, at: float, actor: str, lease: float, expected: int) -> str:
    """Apply one event to a job; returns the outcome's name."""
    if kind == "create":
        if j.status:
            return "EXISTS"
        j.status, j.created = "RECEIVED", at
        return "CREATED"
    if not j.status:
        return "NOT_FOUND"
    if kind == "save":
        j.status = "DISPATCHING"
        return "SAVED"
    if kind == "parsed":
        j.parsed, j.expected, j.status = True, expected, "RUNNING"
        return "PARSED"
    if kind == "sent":
        j.status = "RUNNING"
        return "RUNNING"
    if kind == "done":
        j.completed += 1
        return "COUNTED"
    if kind == "fail":
        j.status = "FAILED"
        return "FAILED"
    if kind == "lease":
        if j.owner.strip() and j.owner != actor and j.expires >= at:
            return "REFUSED"
        j.owner, j.expires = actor, at + lease
        return "LEASED"
    if kind == "finalize":
        ready = j.status == "RUNNING" and j.completed == j.expected
        if not j.parsed or not (ready or (j.status == "FINALIZING" and j.expires < at)):
            return "REFUSED"
        j.status, j.owner, j.expires = "FINALIZING", actor, at + lease
        return "FINALIZING"
    if kind == "complete":
        if j.status != "FINALIZING" or j.owner != actor:
            return "REFUSED"
        j.status, j.notification = "COMPLETED", "PENDING"
        return "COMPLETED"
    if kind == "notify":
        if j.status != "COMPLETED":
            return "REFUSED"
        j.notification = "SENT"
        return "NOTIFIED"
    raise ValueError(f"no such event: {kind}")


def _in_order(batches: Iterator[pd.DataFrame], keys: list[str], fresh: Callable, apply: Callable, taken: list[str], schema: str) -> Iterator[pd.DataFrame]:
    """Outcomes of events that are sorted by key, at and seq, carrying the last key's state on; a row of a held state sets it and has no outcome."""
    names = _names(schema)
    shown = names[names.index("outcome") + 1 :]
    last, state = None, fresh()
    for pdf in batches:
        own = zip(*[pdf[k].astype("object").where(pdf[k].notna(), None).tolist() for k in keys], strict=True)
        held = pdf["held"].tolist() if "held" in pdf else repeat(None, len(pdf))
        out = []
        for key, kept, seq, at, kind, *args in zip(own, held, *[pdf[c].tolist() for c in ("seq", "at", "kind", *taken)], strict=True):
            if key != last:
                last, state = key, fresh()
            if kept is not None:
                state = fresh(**kept)
                continue
            outcome = apply(state, kind, at, *args)
            out.append((*key, seq, at, kind, outcome, *[getattr(state, c) for c in shown]))
        yield pd.DataFrame(out, columns=names)


def _folded(events: DataFrame, keys: list[str], fresh: Callable, apply: Callable, taken: list[str], schema: str) -> DataFrame:
    held = [c for c in events.columns if c == "held"]
    order = [*keys, *[F.col(c).isNull() for c in held], F.col("at").asc_nulls_last(), F.col("seq").asc_nulls_last()]
    rows = events.select(*keys, "seq", "at", "kind", *taken, *held).repartition(*keys).sortWithinPartitions(*order)
    return rows.mapInPandas(lambda it: _in_order(it, keys, fresh, apply, taken, schema), schema)


def fold(events: DataFrame) -> DataFrame:
    """Outcome of every event of subtasks, and the state after it."""
    return _folded(events, KEY, Subtask, step, ["actor", "lease", "success"], OUTCOMES)


def fold_jobs(events: DataFrame) -> DataFrame:
    """Outcome of every event of jobs, and the state after it; ``job_ticks`` has the events that come from subtasks."""
    return _folded(events, ["task_id"], Job, job_step, ["actor", "lease", "expected"], JOB_OUTCOMES)


def job_ticks(outcomes: DataFrame) -> DataFrame:
    """Events of jobs that those of subtasks bring about (``fold``): one was sent, one is done."""
    kind = F.when(F.col("outcome") == "DISPATCHED", "sent").when(F.col("outcome").isin("COMPLETED", "ACCEPTED"), "done")
    return outcomes.select("task_id", "seq", "at", kind.alias("kind"), F.lit("").alias("actor"), F.lit(0.0).alias("lease"), F.lit(0).cast("bigint").alias("expected")).where("kind is not null")


def latest(outcomes: DataFrame) -> DataFrame:
    """Each job that was created, after its last event."""
    rest = [c for c in _names(JOB_OUTCOMES) if c not in ("task_id", "seq", "at", "kind", "outcome")]
    last = outcomes.where("status != ''").groupBy("task_id").agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("j"))
    return last.select("task_id", "j.*")


STATE = "status string, owner string, expires double, started double, dispatched double, attempts bigint"
_WHOLE = OUTCOMES + ", expires double, started double, dispatched double"


def fold_onto(events: DataFrame, states: DataFrame) -> DataFrame:
    """``fold`` of events that follow those of ``states(task_id, sub_task_id, and the columns of STATE)``; outcomes with the whole state after each."""
    kind = {f.name: f.dataType for f in events.schema}
    columns = ["seq", "at", "kind", "actor", "lease", "success"]
    own = events.select(*KEY, *columns, F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':', 1) for c in STATE.split(', '))}>").alias("held"))
    before = states.select(*KEY, *[F.lit(None).cast(kind[c]).alias(c) for c in columns], F.struct(*_names(STATE)).alias("held"))
    return _folded(own.unionByName(before), KEY, Subtask, step, ["actor", "lease", "success"], _WHOLE)


def states_after(outcomes: DataFrame) -> DataFrame:
    """The state of each key of ``fold_onto`` after its last event."""
    last = outcomes.groupBy(*KEY).agg(F.max_by(F.struct(*_names(STATE)), F.struct(F.col("at").isNull(), "at", F.col("seq").isNull(), "seq")).alias("s"))
    return last.select(*KEY, "s.*")


def expired(states: DataFrame, now: Column) -> DataFrame:
    """Subtasks whose lease has run out at ``now`` without an event that says so: task_id, sub_task_id, owner, expires."""
    return states.where((F.col("status") == "PROCESSING") & (F.col("expires") < now)).select(*KEY, "owner", "expires")


def recoverable(jobs: DataFrame) -> DataFrame:
    """Jobs that a recovery sweep takes up, in order of creation."""
    open_ = F.col("status").isin("RECEIVED", "DISPATCHING", "RUNNING", "FINALIZING")
    unsaid = (F.col("status") == "COMPLETED") & (F.col("notification") == "PENDING")
    return jobs.where(open_ | unsaid).orderBy("created", "task_id")


def recovery_sweep(jobs: DataFrame, manager: str, now: Column) -> DataFrame:
    """What a sweep by ``manager`` does with each recoverable job: task_id, created and action.

    finalize (take over), notify, skip (another manager's lease holds), or
    dispatch, after parsing first where that is not done; whether it can then be
    finalised is ``ready``. ``tasks.dispatch_plan`` has what is dispatched.
    """
    held = (F.trim("owner") != "") & (F.col("owner") != manager) & (F.col("expires") >= now)
    action = (
        F.when(F.col("status") == "FINALIZING", "finalize")
        .when(F.col("status") == "COMPLETED", "notify")
        .when(held, "skip")
        .when(~F.col("parsed"), "parse, dispatch")
        .otherwise("dispatch")
    )
    over = (F.col("status") == "FINALIZING") & (F.col("expires") < now)
    ready = F.col("parsed") & (F.col("completed") == F.col("expected")) & ((F.col("status") == "RUNNING") | over)
    return recoverable(jobs).select("task_id", "created", action.alias("action"), ready.alias("ready"))
