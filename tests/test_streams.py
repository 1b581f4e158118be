"""Streams over several batches: one verdict for each attempt, receipts and audits that read no more than they touch."""

import glob

from pyspark.sql import Row, functions as F

from claimgrid.operators.ordered_checks import attempt_facts, attempt_status
from claimgrid.streaming import tasks as R

EVENT = "task_id string, attempt long, event string, ts string"


def files(spark, path, batches, schema):
    """One file for each batch, in the order of their time of writing."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_one_verdict_for_each_attempt(spark, tmp_path):
    whole = lambda t, day, end="completed": [(t, 1, "dispatched", f"2024-01-{day:02d} 10:00:00"), (t, 1, "polled", f"2024-01-{day:02d} 10:05:00"), (t, 1, end, f"2024-01-{day:02d} 10:20:00")]
    batches = [
        whole("a", 1)[1:], whole("a", 1)[:1] + whole("b", 1)[:2],  # the first event comes last
        whole("b", 1, "failed")[2:] + [("c", 1, "redispatched", "2024-01-01 11:00:00")],  # nothing but a redispatch
        whole("d", 8), [("a", 1, "completed", "2024-01-08 12:00:00"), ("b", 1, "polled", "2024-01-08 13:00:00")],  # long after the verdict
        whole("e", 9) + [("e", 2, "dispatched", "2024-01-09 23:59:59"), ("f", 1, "failed", "2024-01-09 23:59:58"), (None, 1, "polled", "2024-01-09 00:00:00")]]
    stream = files(spark, tmp_path / "log", batches, EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.task_id, r.attempt, r.status, r.polls) for r in R.closed_attempts(spark, stream, keep=30 * 86_400).collect()]
    assert sorted(got) == [("a", 1, "completed", 1), ("b", 1, "failed", 1), ("c", 1, "not_one_dispatch_and_terminal", 0), ("d", 1, "completed", 1),
                           ("e", 1, "completed", 1), ("e", 2, "timed_out", 0), ("f", 1, "not_one_dispatch_and_terminal", 0)]
    in_time = [r for rows in batches for r in rows if r[0] and not (r[0] in "ab" and r[3] > "2024-01-08")]
    facts = attempt_facts(spark.createDataFrame(in_time, EVENT).withColumn("ts", F.col("ts").cast("timestamp")))
    sound = {(r.task_id, r.attempt) for r in attempt_status(facts).where("problem is null").collect()}
    assert {g[:2] for g in got if g[2] in ("completed", "failed")} == sound


RECEIPT = "decision_sha256 string, body_sha256 string, channel string, status string, ts long, note string"


def test_receipts_read_nothing_that_was_written(spark, tmp_path):
    batches = [[(f"d{n % 7}", "b", "mail", "sent" if (n + k) % 3 else "pending", 100 * k + n, f"n{k}") for n in range(40 * k, 40 * k + 40)] for k in range(5)]
    batches.append([("d0", "b", "mail", "sent", -5, "late"), ("new", "b", "mail", "sent", 2, "y"), ("new", "b", "mail", "sent", 2, "x"), (None, "b", "mail", "sent", 1, "z")])
    stream = files(spark, tmp_path / "receipts", batches, RECEIPT)
    q = R.first_receipts(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    want, seen = [], set()
    for rows in batches:
        for r in sorted((r for r in rows if r[3] == "sent"), key=lambda r: (r[4], r[5])):
            if r[:3] not in seen:
                seen.add(r[:3])
                want.append(r)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.decision_sha256, r.body_sha256, r.channel, r.status, r.ts, r.note) for r in out.collect()), key=repr) == sorted(want, key=repr)
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in done] == [len(b) for b in batches]  # what a batch reads is what it brings
    assert all(p["stateOperators"][0]["numRowsUpdated"] <= 7 for p in done)


def test_audits_read_their_own_buckets(spark, tmp_path):
    schema = "project_id long, line long, text string"
    batches = [[(p, 1, f"first of {p}") for p in range(60)], [(p, 2, f"second {p}") for p in range(30)], [(3, 3, "third of 3"), (3, 4, "none"), (70, 1, "of")]]
    stream = files(spark, tmp_path / "lines", batches, schema)
    read = []

    def check(lines):
        read.append(sorted(lines.inputFiles()))
        return lines.where("text like '% of %'").groupBy("project_id").agg(F.count("*").alias("n"))

    out = str(tmp_path / "out")
    R.audit_new_projects(stream, check, out, str(tmp_path / "state"), 64).awaitTermination()
    got = {r.project_id: r.n for r in R.current_findings(spark, out).collect()}
    assert got == {p: 2 if p == 3 else 1 for p in range(60)}
    buckets = {r.b for r in spark.createDataFrame([(3,), (70,)], "project_id long").select(R.project_bucket("project_id", 64).alias("b")).collect()}
    met = {int(f.split("_bucket=")[1].split("/")[0]) for f in read[-1] if "_bucket=" in f}
    assert met == buckets and len(glob.glob(f"{out}/lines/_bucket=*")) > 30  # the rest of the history is not read


def test_attempts_ask_the_state_once_and_store_nothing_that_is_over(spark):
    class Stored:
        def __init__(self, value=None):
            self.value, self.calls = value, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.calls.append("clear")
            self.value = None

        def registerTimer(self, at):
            self.calls.append(f"timer {at}")

        def deleteTimer(self, at):
            self.calls.append(f"no timer {at}")

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    def row(at, dispatches=0, polls=0, done=0):
        us = at * 1_000_000
        return Row(dispatches=dispatches, terminals=done, completions=done, polls=polls, start_us=us if dispatches else None, finish_us=us if done else None,
                   first_poll_us=us if polls else None, last_poll_us=us if polls else None, first_us=us)

    whole = [row(10, dispatches=1), row(20, polls=1), row(30, done=1)]
    p = R.AttemptProcessor(1800, wait=100, keep=1000)
    p.handle = p.state = Stored()
    assert [(r.status, r.polls, r.seconds) for r in p.handleInputRows(("t", 1), iter(whole), Now(2_000_000))] == [("completed", 1, 20.0)]
    assert p.state.calls == ["get"]  # over and past its mark: nothing is stored
    p.handle = p.state = Stored()
    assert [r.status for r in p.handleInputRows(("t", 1), iter(whole), Now(500_000))] == ["completed"]
    assert p.state.calls == ["get", "update", "timer 1110000"] and list(p.handleInputRows(("t", 1), iter(whole), Now(500_000))) == []
    p.handle = p.state = Stored()
    assert [list(p.handleInputRows(("t", 1), iter([r]), Now(0))) for r in reversed(whole)] == [[], [], []]
    assert [c for c in p.state.calls if "timer" in c] == ["timer 130000", "no timer 130000", "timer 120000", "no timer 120000", "timer 110000"]
