"""Event logs: parsing, lifecycles, streams."""

from pyspark.sql import functions as F

from claimgrid.operators import contracts as Q, ordered_checks as W
from claimgrid.plans.queries.base import VIEWS, query
from claimgrid.session import shared_path
from claimgrid.sources.events import field_errors, parse_events, scan_events, task_events
from claimgrid.streaming import tasks as R

K = "project_id"

# Task events: task = user, attempt = day of the log.
VIEWS["v_task_events"] = """
select cast(user_id as varchar(20)) as task_id, cast(datediff(cast(ts as date), date '2024-01-01') + 1 as bigint) as attempt,
  case event_type when 'signup' then 'dispatched' when 'click' then 'polled' when 'view' then 'redispatched' when 'purchase' then 'completed' else 'failed' end as event, cast(ts as timestamp) as ts, event_id from {events}"""

DUCK_TASKS = """(select cast(user_id as varchar) as task_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as bigint) as attempt,
  case event_type when 'signup' then 'dispatched' when 'click' then 'polled' when 'view' then 'redispatched' when 'purchase' then 'completed' else 'failed' end as event, ts from events)"""
FACTS = f"""(select task_id, attempt, count(*) filter (event = 'dispatched') as d, count(*) filter (event in ('completed', 'failed')) as t, count(*) filter (event = 'completed') as c, count(*) filter (event = 'polled') as p,
  min(ts) filter (event = 'dispatched') as s, min(ts) filter (event in ('completed', 'failed')) as f, min(ts) filter (event = 'polled') as p0, max(ts) filter (event = 'polled') as p1, min(ts) filter (event = 'redispatched') as r, min(ts) filter (event = 'failed') as fl from {DUCK_TASKS} e group by 1, 2)"""
STATUS = f"""(select *, round((epoch_us(f) - epoch_us(s)) / 1e6, 6) as seconds, case when d <> 1 or t <> 1 then 'not_one_dispatch_and_terminal' when p = 0 or p0 < s or p1 > f then 'poll_missing_or_out_of_order'
  when (epoch_us(f) - epoch_us(s)) / 1e6 < 0 or (epoch_us(f) - epoch_us(s)) / 1e6 > 1800 then 'duration_out_of_range' end as problem from {FACTS} x)"""


@query("W08_attempts", f"select task_id, attempt, cast(d as bigint) as dispatches, cast(t as bigint) as terminals, cast(p as bigint) as polls, seconds, problem from {STATUS} y")
def _(s):
    return W.attempt_status(W.attempt_facts(s.v_task_events)).select("task_id", "attempt", "dispatches", "terminals", "polls", "seconds", "problem")


@query("W08_task_lifecycle", f"""
with a as (select *, lead(attempt) over w as na, lead(s) over w as ns, lead(r) over w as nr from {STATUS} y window w as (partition by task_id order by attempt)),
g as (select task_id, count(*) as attempts, count(problem) as bad, max(case when d = 1 and t = 1 and c = 1 then attempt end) as done, max(attempt) as last, count(*) filter (na is not null and not coalesce(fl <= coalesce(r, nr) and coalesce(r, nr) <= ns, false)) as br,
  arg_max(seconds, attempt) filter (d = 1 and t = 1 and c = 1) as sec from a group by 1)
select task_id, cast(attempts as bigint) as attempts, cast(bad as bigint) as bad_attempts, cast(br as bigint) as bad_redispatches, case when done is null then 'no_completed_attempt' when last > done then 'events_after_completion' else 'completed' end as status,
  case when done is not null and last <= done then sec end as seconds from g""")
def _(s):
    return W.task_lifecycle(s.v_task_events)


@query("V10_supervision", f"""
with a as (select * from {STATUS} y), g as (select task_id, max(case when d = 1 and t = 1 and c = 1 then attempt end) as done, max(attempt) as last from a group by 1), l as (select task_id, case when done is null then 'n' when last > done then 'e' else 'completed' end as status from g),
c as (select distinct user_id % 10 as project_id, cast(user_id as varchar) as task_id from events), j as (select c.*, l.status from c left join l on l.task_id = c.task_id), k as (select project_id, count(*) as n, count(*) filter (status = 'completed') as ok from j group by 1)
select project_id, cast(project_id as varchar) as subject, 'too_few_completed' as code, 'error' as kind from k where n < 3 union all select project_id, cast(project_id as varchar), 'timing_coverage', 'error' from k where ok < n
union all select project_id, task_id, 'task_not_completed', 'error' from j where status <> 'completed'""")
def _(s):
    c = s.events.select((F.col("user_id") % 10).alias(K), F.col("user_id").cast("string").alias("task_id")).distinct()
    sm = c.select(K).distinct().select(K, F.lit("done").alias("status"), F.lit(True).alias("passed"), F.lit("lead").alias("leader_role"))
    return Q.supervision(sm, s.v_task_events, c)


def raw_log(s):
    """The events as JSON lines, with damaged lines and missing fields as they occur in logs."""
    e = s.events
    typ = F.when(F.col("event_type") == "signup", "subagent_dispatched").when(F.col("event_type") == "click", "subagent_polled").when(F.col("event_type") == "purchase", "subagent_completed").otherwise("note")
    j = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), typ.alias("event_type"), F.col("user_id").cast("string").alias("task_id"),
                           F.when(F.col("value") < 50, 1).otherwise(0).alias("attempt"), F.lit("p").alias("phase"), F.when(F.col("event_type") == "click", " ").otherwise("a").alias("agent")))
    return e.select(F.col("event_id").alias("line"), F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "event_id")).otherwise(j).alias("value"))


@query("S04_event_log", """
select event_id as line, case event_type when 'signup' then 'subagent_dispatched' when 'click' then 'subagent_polled' when 'purchase' then 'subagent_completed' when 'error' then null else 'note' end as event_type,
  case when event_type <> 'error' then cast(user_id as varchar) end as task_id, case when event_type = 'error' then '{broken ' || event_id end as bad from events""")
def _(s):
    return parse_events(raw_log(s)).select("line", "event_type", "task_id", "bad")


@query("S04_folder_log", """
select event_id % 64 as log, row_number() over (partition by event_id % 64 order by event_id) as line, case event_type when 'signup' then 'subagent_dispatched' when 'click' then 'subagent_polled' when 'purchase' then 'subagent_completed' when 'error' then null else 'note' end as event_type,
  case when event_type <> 'error' then cast(user_id as varchar) end as task_id, case when event_type = 'error' then '{broken ' || event_id end as bad from events""")
def _(s):
    logs = shared_path(s.spark, "event-logs")
    raw = raw_log(s).withColumn("log", F.col("line") % 64)
    raw.repartition("log").sortWithinPartitions("log", "line").select("log", "value").write.partitionBy("log").text(logs)
    return scan_events(s.spark, logs).select(F.col("log").cast("long").alias("log"), "line", "event_type", "task_id", "bad")


@query("R01_event_field_errors", """
select event_id as line, case when event_type = 'error' then 'not_json' when event_type = 'click' then case when value < 50 then 'agent' else 'agent,attempt' end when value >= 50 then 'attempt' end as problem from events
where event_type = 'error' or event_type = 'click' or (event_type in ('signup', 'purchase') and value >= 50)""")
def _(s):
    return field_errors(parse_events(raw_log(s))).select("line", "problem")


@query("R01_task_events", """
select cast(user_id as varchar) as task_id, cast(1 as bigint) as attempt, case event_type when 'signup' then 'dispatched' else 'completed' end as event, cast(count(*) as bigint) as n from events where event_type in ('signup', 'purchase') and value < 50 group by 1, 3""")
def _(s):
    return task_events(parse_events(raw_log(s))).groupBy("task_id", "attempt", "event").agg(F.count(F.lit(1)).alias("n"))


def event_stream(s):
    schema = s.events.schema
    raw = s.spark.readStream.schema(schema).parquet(f"{s.sf}/events.parquet*")
    kind = F.when(F.col("event_type") == "signup", "dispatched").when(F.col("event_type") == "click", "polled").when(F.col("event_type") == "view", "redispatched").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    day = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("long")
    return raw.select(F.col("user_id").cast("string").alias("task_id"), day.alias("attempt"), kind.alias("event"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("R02_attempt_stream", f"""
select task_id, attempt, case when d <> 1 or t > 1 then 'not_one_dispatch_and_terminal' when t = 0 then 'timed_out' when p = 0 or p0 < s or p1 > f then 'poll_missing_or_out_of_order'
  when (epoch_us(f) - epoch_us(s)) / 1e6 < 0 or (epoch_us(f) - epoch_us(s)) / 1e6 > 1800 then 'duration_out_of_range' when c = 1 then 'completed' else 'failed' end as status, cast(p as bigint) as polls
from {FACTS} x""")
def _(s):
    return R.closed_attempts(s.spark, event_stream(s)).select("task_id", "attempt", "status", "polls")


@query("R03_first_receipts", """
select distinct 'F' || user_id as decision_sha256, 'b' || (user_id % 3) as body_sha256, 'mail' as channel from events where event_type = 'purchase'""")
def _(s):
    raw = s.spark.readStream.schema(s.events.schema).parquet(f"{s.sf}/events.parquet*")
    rec = raw.select(F.concat(F.lit("F"), "user_id").alias("decision_sha256"), F.concat(F.lit("b"), F.col("user_id") % 3).alias("body_sha256"), F.lit("mail").alias("channel"),
                     F.when(F.col("event_type") == "purchase", "sent").otherwise("pending").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    out = shared_path(s.spark, "receipts")
    R.first_receipts(rec, out, shared_path(s.spark, "receipts-state")).awaitTermination()
    return s.spark.read.parquet(out).select("decision_sha256", "body_sha256", "channel")


@query("R04_incremental_audit", """
select doc_id as project_id, cast(count(*) as bigint) as findings from (select doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) as t from documents) q where contains(t, ' of ') group by 1""".replace("\\\\", "\\"))
def _(s):
    from claimgrid.operators.predicates import lint_terms
    from claimgrid.sources.files import to_lines

    raw = s.spark.readStream.schema(s.documents.schema).parquet(f"{s.sf}/documents.parquet*")
    lines = to_lines(raw.withColumnRenamed("doc_id", K), [K])
    out = shared_path(s.spark, "audit")
    R.audit_new_projects(lines, lambda b: lint_terms(b, [("terminology", " of ", " from ", "error")]), out, shared_path(s.spark, "audit-state"), 16).awaitTermination()
    return R.current_findings(s.spark, out).groupBy(K).agg(F.count(F.lit(1)).alias("findings"))
