"""Append-only ledgers: chains, attempts and their ends, budgets, folds of ordered events.

A record has sequence, record_id, record_type, attempt_id, outcome, reserved_bytes, accepted_bytes;
``run_id`` parts one ledger from another.  Folds that only look back are windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import broken, together, unique

_STARTED, _FINISHED = "attempt-started", "attempt-finished"


def _run(order: str = "sequence"):
    return Window.partitionBy("run_id").orderBy(order)


def graph_faults(records: DataFrame) -> DataFrame:
    """What breaks a ledger: repeated ids, a missing opening, ends without starts, anything after the terminal record."""
    key = F.concat_ws("|", "run_id", "record_id")
    nth = records.withColumns({"nth": F.row_number().over(_run()), "closed": F.coalesce(F.sum((F.col("record_type") == "run-terminal").cast("int")).over(_run().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    per = Window.partitionBy("run_id", "attempt_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    seen = records.where("attempt_id IS NOT NULL").withColumns({"starts": F.coalesce(F.count_if(F.col("record_type") == _STARTED).over(per), F.lit(0)), "ends": F.coalesce(F.count_if(F.col("record_type") == _FINISHED).over(per), F.lit(0))})
    is_ = lambda t: F.col("record_type") == t
    return together(
        unique(records, "record_id_unique", ["run_id", "record_id"]),
        broken(nth, "sequence_contiguous", key, F.col("sequence") != F.col("nth")),
        broken(nth, "opened_first", key, is_("run-opened") != (F.col("nth") == 1)),
        broken(nth, "nothing_after_terminal", key, F.col("closed") > 0),
        broken(seen, "start_once", key, is_(_STARTED) & (F.col("starts") > 0)),
        broken(seen, "finish_after_start", key, is_(_FINISHED) & ((F.col("starts") != 1) | (F.col("ends") > 0))),
    )


def unfinished(records: DataFrame) -> DataFrame:
    """Attempts that started and never finished."""
    done = records.where(F.col("record_type") == _FINISHED).select("run_id", "attempt_id")
    return records.where(F.col("record_type") == _STARTED).join(done, ["run_id", "attempt_id"], "left_anti")


def reconciled(records: DataFrame) -> DataFrame:
    """The records that close unfinished attempts as crashed, and an issue for each; none if they are closed already."""
    open_ = unfinished(records).select("run_id", "attempt_id")
    row = lambda kind, suffix: open_.select("run_id", F.concat("attempt_id", F.lit(suffix)).alias("record_id"), F.lit(kind).alias("record_type"), "attempt_id", F.lit("crash_unknown").alias("outcome"))
    known = records.select("run_id", "record_id")
    return row(_FINISHED, "-finish").unionByName(row("issue", "-issue")).join(known, ["run_id", "record_id"], "left_anti")


def reserved(records: DataFrame, most_attempts: int, most_bytes: int) -> DataFrame:
    """Attempts and bytes held by each run: what an attempt accepted once it is known, what it reserved before; and whether that is within the limits."""
    ends = records.where(F.col("record_type") == _FINISHED).select("run_id", "attempt_id", F.when(F.col("outcome") != "crash_unknown", F.col("accepted_bytes")).alias("known"))
    starts = records.where(F.col("record_type") == _STARTED).select("run_id", "attempt_id", "reserved_bytes").join(ends, ["run_id", "attempt_id"], "left")
    sums = starts.groupBy("run_id").agg(F.count("*").alias("attempts"), F.sum(F.coalesce("known", "reserved_bytes")).cast("long").alias("bytes"))
    return sums.withColumn("within", (F.col("attempts") <= most_attempts) & (F.col("bytes") <= most_bytes))


def open_actions(events: DataFrame) -> DataFrame:
    """Events (run_id, sequence, action_id, state) with how many other actions of the run are open then; STARTED opens, COMPLETED closes, a start while another is open is a fault."""
    step = F.when(F.col("state") == "STARTED", 1).when(F.col("state") == "COMPLETED", -1).otherwise(0)
    before = F.coalesce(F.sum("step").over(_run().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("step", step).withColumn("open_before", before).drop("step").withColumn("fault", (F.col("state") == "STARTED") & (F.col("open_before") > 0))


def unresolved(events: DataFrame) -> DataFrame:
    """Actions whose last state is not COMPLETED."""
    return events.groupBy("run_id", "action_id").agg(F.max_by("state", "sequence").alias("state")).where("state <> 'COMPLETED'")


def journal(events: DataFrame, planned: DataFrame) -> DataFrame:
    """For each run: checks passed and failed (their last outcome counts), whether it stopped, and planned checks not run."""
    last = events.where("kind = 'outcome'").groupBy("run_id", "check_id").agg(F.max_by("result", "sequence").alias("result"))
    stop = events.groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("kind") == "stop"), F.lit(False)).alias("stopped"))
    done = last.groupBy("run_id").agg(F.count_if(F.col("result") == "PASS").alias("passed"), F.count_if(F.col("result") != "PASS").alias("failed"))
    grid = events.select("run_id").distinct().crossJoin(F.broadcast(planned.select("check_id")))  # the plan of a run: a fixed list
    left = grid.join(last, ["run_id", "check_id"], "left_anti").groupBy("run_id").agg(F.array_sort(F.collect_list("check_id")).alias("not_run"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return stop.join(done, "run_id", "left").join(left, "run_id", "left").select("run_id", "stopped", n("passed"), n("failed"), F.coalesce("not_run", F.array().cast("array<string>")).alias("not_run"))


def schedule_faults(observed: DataFrame, planned: DataFrame) -> DataFrame:
    """Observations (run_id, step, start, end) against a plan (step): missing and extra steps, and steps that begin before the one before has ended."""
    w = Window.partitionBy("run_id").orderBy("step")
    late = observed.withColumn("before", F.lag("end").over(w)).where(F.col("start") < F.col("before")).select("run_id", "step", F.lit("overlap").alias("fault"))
    grid = observed.select("run_id").distinct().crossJoin(F.broadcast(planned.select("step")))  # the plan: a fixed list
    missing = grid.join(observed, ["run_id", "step"], "left_anti").select("run_id", "step", F.lit("missing").alias("fault"))
    extra = observed.join(F.broadcast(planned.select("step")), "step", "left_anti").select("run_id", "step", F.lit("extra").alias("fault"))
    return late.unionByName(missing).unionByName(extra)


def classify_observation(expected, observed, complete):
    """PASS, FAIL or INCONCLUSIVE of an observed operation, with the reason."""
    from .checks import first_rule

    state = first_rule((~complete, "INCONCLUSIVE"), (observed.isNull(), "INCONCLUSIVE"), (observed == expected, "PASS"), otherwise="FAIL")
    reason = first_rule((~complete, "evidence_incomplete"), (observed.isNull(), "not_observed"), (observed == expected, "as_expected"), otherwise="differs")
    return state, reason


def action_plan(*parts: DataFrame) -> DataFrame:
    """Actions (run_id, place, action) of several parts in one contiguous sequence for each run: part by part, then by place."""
    both = None
    for k, part in enumerate(parts):
        one = part.select("run_id", F.lit(k).alias("part"), "place", "action")
        both = one if both is None else both.unionByName(one)
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("part", "place", "action"))
    return both.select("run_id", nth.alias("sequence"), "action")
