"""Checks over ordered rows: numbering gaps, heading levels, phases, attempt lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimgrid.functions import text as T
from claimgrid.functions.numbers import seconds_between
from claimgrid.functions.ordered import last_known, next_row, previous_row, running_sum
from claimgrid.operators.extract import K, headings
from claimgrid.rules import values as V


def section_gaps(sections: DataFrame) -> DataFrame:
    """Jumps between consecutive section numbers of the same depth and parent."""
    d = previous_row(sections, [K], "line", F.col("section"), "prev")
    same = (T.id_depth("prev") == T.id_depth("section")) & (T.id_parent("prev") == T.id_parent("section"))
    d = d.where(same).withColumn("missing", (T.id_leaf("section") - T.id_leaf("prev") - 1).cast("long")).where("missing > 0")
    return d.select(K, "line", "prev", "section", "missing").withColumn("severity", F.when(F.col("missing") >= 3, "CRITICAL").otherwise("WARNING"))


def two_line_context(lines: DataFrame, keys: list[str] = [K]) -> DataFrame:
    return next_row(lines, keys, "line", F.col("text"), "_n").withColumn("context", F.concat_ws(" ", "text", "_n")).drop("_n")


def number_gaps(ids: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Missing runs inside the numbers of each key, as ranges: a gap of any width is one row."""
    d = next_row(ids.select(*keys, number).distinct(), keys, number, F.col(number), "_next")
    gap = (F.col("_next") - F.col(number) - 1).cast("long")
    d = d.withColumn("n", gap).where("n > 0")
    return d.select(*keys, (F.col(number) + 1).cast("long").alias("gap_start"), (F.col("_next") - 1).cast("long").alias("gap_end"), "n")


def sequence_gaps(ids: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Keys whose numbers are not consecutive. The missing count needs no list: span minus distinct numbers."""
    d = ids.groupBy(*keys).agg(F.min(number).alias("lowest"), F.max(number).alias("highest"), F.countDistinct(number).alias("present"))
    d = d.withColumn("missing", (F.col("highest") - F.col("lowest") + 1 - F.col("present")).cast("long")).where("present >= 2 and missing > 0")
    return d.withColumn("severity", F.when(F.col("missing") >= 3, "CRITICAL").otherwise("WARNING"))


def heading_checks(lines: DataFrame) -> DataFrame:
    """Heading levels that jump by more than one, and headings with neither text nor child."""
    h = headings(lines)
    filled = lines.where(~T.is_blank("text")).select(K, "line").withColumn("_t", F.lit(1))
    marks = filled.join(h.select(K, "line", "level", "title"), [K, "line"], "left")
    # among the non-blank lines the next one tells both: text, or the next heading and its level
    d = next_row(marks, [K], "line", F.coalesce(F.col("level"), F.lit(0)), "_next_level")
    d = d.where("level is not null")
    d = previous_row(d, [K], "line", F.col("level"), "_prev_level")
    jump = d.where("level - _prev_level > 1").select(K, "line", "title", F.lit("heading_jump").alias("problem"))
    empty = d.where("_prev_level is not null and (_next_level is null or (_next_level > 0 and _next_level <= level))")
    return jump.unionByName(empty.select(K, "line", "title", F.lit("empty_section").alias("problem"))).withColumn("severity", F.lit("warning"))


def h1_count(lines: DataFrame) -> DataFrame:
    n = headings(lines).groupBy(K).agg(F.count_if(F.col("level") == 1).alias("h1"))
    return n.withColumn("passed", F.col("h1") <= 1)


def phases(states: DataFrame) -> DataFrame:
    """Phase status: completed; the first open phase is in progress, later open ones are blocked."""
    first = states.groupBy(K).agg(F.min(F.when(~F.col("complete"), F.col("ord"))).alias("_first"))
    status = F.when(F.col("complete"), "completed").when(F.col("ord") == F.col("_first"), "in_progress").otherwise("blocked")
    return states.join(first, K).select(K, "ord", "complete", status.alias("status"))


def phase_summary(states: DataFrame) -> DataFrame:
    s = states.groupBy(K).agg(F.bool_and("complete").alias("all_completed"), F.min(F.when(~F.col("complete"), F.col("ord"))).alias("current_phase"),
                              F.count_if("complete").alias("completed"), F.count(F.lit(1)).alias("phases"))
    return s


ATTEMPT_FIELDS = [
    "dispatches", "terminals", "completions", "failures", "polls", "start", "finish", "first_poll", "last_poll", "redispatch", "failed_at", "event_start",
]


def attempt_facts(events: DataFrame) -> DataFrame:
    """One row of counts and times per (task, attempt).

    Everything is a sum, minimum or maximum, so events of a busy task are combined before the shuffle.
    ``events``: task_id, attempt, event (dispatched, polled, completed, failed, redispatched), ts.
    """
    e, ts = F.col("event"), F.col("ts")
    end = e.isin("completed", "failed")
    return events.groupBy("task_id", "attempt").agg(
        F.count_if(e == "dispatched").alias("dispatches"), F.count_if(end).alias("terminals"),
        F.count_if(e == "completed").alias("completions"), F.count_if(e == "failed").alias("failures"), F.count_if(e == "polled").alias("polls"),
        F.min(F.when(e == "dispatched", ts)).alias("start"), F.min(F.when(end, ts)).alias("finish"),
        F.min(F.when(e == "polled", ts)).alias("first_poll"), F.max(F.when(e == "polled", ts)).alias("last_poll"),
        F.min(F.when(e == "redispatched", ts)).alias("redispatch"), F.min(F.when(e == "failed", ts)).alias("failed_at"))


def attempt_status(facts: DataFrame, limit: int = V.TASK_SECONDS_MAX) -> DataFrame:
    """Verdict on each attempt: count, poll order and duration rules."""
    seconds = seconds_between("start", "finish")
    problem = (
        F.when((F.col("dispatches") != 1) | (F.col("terminals") != 1), "not_one_dispatch_and_terminal")
        .when((F.col("polls") == 0) | (F.col("first_poll") < F.col("start")) | (F.col("last_poll") > F.col("finish")), "poll_missing_or_out_of_order")
        .when((seconds < 0) | (seconds > limit), "duration_out_of_range"))
    return facts.withColumn("seconds", F.round(seconds, 6)).withColumn("problem", problem)


def task_lifecycle(events: DataFrame, limit: int = V.TASK_SECONDS_MAX) -> DataFrame:
    """Verdict on each task: an attempt that completed and is the last, and orderly redispatches between attempts."""
    a = attempt_status(attempt_facts(events), limit)
    one = F.col("dispatches").eqNullSafe(1) & (F.col("terminals") == 1)
    done = F.when(one & (F.col("completions") == 1), F.col("attempt"))
    nxt = next_row(a, ["task_id"], "attempt", F.struct("attempt", "start", "redispatch", "dispatches"), "_n", span=10_000)
    re = F.coalesce("redispatch", "_n.redispatch")
    ok = (F.col("failed_at") <= re) & (re <= F.col("_n.start"))
    nxt = nxt.withColumn("_bad_order", F.col("_n").isNotNull() & ~F.coalesce(ok, F.lit(False)))
    t = nxt.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("problem").isNotNull()).alias("bad_attempts"), F.max(done).alias("_done"),
        F.max("attempt").alias("_last"), F.count_if("_bad_order").alias("bad_redispatches"),
        F.max_by("seconds", F.when(done.isNotNull(), F.col("attempt"))).alias("_sec"))
    status = F.when(F.col("_done").isNull(), "no_completed_attempt").when(F.col("_last") > F.col("_done"), "events_after_completion").otherwise("completed")
    return t.withColumn("status", status).select(
        "task_id", "attempts", "bad_attempts", "bad_redispatches", "status", F.when(F.col("status") == "completed", F.col("_sec")).alias("seconds"))


def island_ids(lines: DataFrame, keys: list[str], is_start, out: str = "block") -> DataFrame:
    """Running number of the block a row belongs to; 0 before the first start."""
    return running_sum(lines, keys, "line", is_start.cast("long"), out)
