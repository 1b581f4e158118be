"""Grouped rules: counts, gaps, votes, uniqueness, baselines."""

from pyspark.sql import functions as F

from claimgrid.operators import aggregate as A, compare as C, converge as G, extract as X, ordered_checks as W
from claimgrid.functions.keyed import first_k, keep_first, samples
from claimgrid.plans.queries.base import VIEWS, query
from claimgrid.plans.queries.text import FIGS
from claimgrid.rules import values as V

K = "project_id"


@query("A01_severity_counts", """
select project_id, """ + ", ".join(f"cast(count(*) filter (severity = '{x}') as bigint) as \"{x}\"" for x in ("FATAL", "CRITICAL", "MAJOR", "WARNING", "INFO")) + """ from {v_findings} f group by 1""")
def _(s):
    return A.severity_counts(s.v_findings)


@query("A33_score_band", """
with c as (select project_id, path, count(*) filter (severity = 'FATAL') as f, count(*) filter (severity = 'CRITICAL') as c, count(*) filter (severity = 'MAJOR') as m from {v_findings} x group by 1, 2)
select project_id, path, cast(case when f > 0 then 30 when c >= 3 then 50 when c > 1 then 69 when c = 1 or m > 2 then 84 else 100 end as bigint) as max_score,
  case when f > 0 or c >= 5 then 'fail' when c > 1 then 'major_revision' when c = 1 or m > 2 then 'conditional' else 'pass' end as verdict from c""")
def _(s):
    d = A.score_band(A.severity_counts(s.v_findings, [K, "path"]))
    return d.select(K, "path", F.col("max_score").cast("long").alias("max_score"), "verdict")


@query("A13_fusion", """
with t as (select project_id, check_id, regexp_replace(module, '^\\d+[_\\-]', '') as target from {v_findings} f union all select project_id, check_id, path from {v_findings} g),
g as (select project_id, target, cast(count(distinct check_id) as bigint) as checks, cast(count(*) as bigint) as findings from t group by 1, 2)
select *, case when target like '%/%' then 'file' else 'module' end as target_type, case when checks >= 3 then 'HIGH' else 'MEDIUM' end as confidence, case when checks >= 3 then 'CRITICAL' else 'MAJOR' end as severity_boost from g where checks >= 2""".replace("\\\\", "\\"))
def _(s):
    return A.fusion(s.v_findings)


@query("A14_majority", """
with n as (select l_suppkey, l_linenumber, l_returnflag, count(*) as c from lineitem group by 1, 2, 3) select l_suppkey, l_linenumber, arg_min(l_returnflag, (-c, l_returnflag)) as majority from n group by 1, 2""")
def _(s):
    return G.majority(s.lineitem, ["l_suppkey", "l_linenumber"], "l_returnflag")


@query("A14_disposition_votes", """
with v as (select l_suppkey as project_id, 'MC-' || l_linenumber as code, l_returnflag as agent, min((l_linestatus, cast(l_quantity as bigint))) as m from lineitem group by 1, 2, 3),
x as (select project_id, code, agent, case when m[1] = 'F' then 'keep' else 'drop' end as disposition, case when m[2] < 2 then 'MAJOR' else 'WARNING' end as sev from v),
g as (select project_id, code, cast(count(*) as bigint) as support, count(distinct disposition) as kinds, max(case when sev = 'MAJOR' then 2 else 1 end) as sv, string_agg(agent, ',' order by agent) as have from x group by 1, 2),
mj as (select project_id, code, arg_min(disposition, (-c, disposition)) as recommended_disposition from (select project_id, code, disposition, count(*) as c from x group by 1, 2, 3) q group by 1, 2)
select g.project_id, g.code, support, case when support = 3 and kinds = 1 then 'consensus' when support >= 2 then case when kinds <= 2 then 'majority' else 'split' end else 'single' end as agreement,
  case when sv = 2 then 'MAJOR' else 'WARNING' end as recommended_severity, recommended_disposition from g join mj on mj.project_id = g.project_id and mj.code = g.code""")
def _(s):
    v = s.lineitem.groupBy(F.col("l_suppkey").alias(K), F.concat(F.lit("MC-"), "l_linenumber").alias("code"), F.col("l_returnflag").alias("agent")).agg(F.min(F.struct("l_linestatus", F.col("l_quantity").cast("long").alias("q"))).alias("m"))
    d = v.select(K, "code", "agent", F.when(F.col("m.l_linestatus") == "F", "keep").otherwise("drop").alias("disposition"), F.when(F.col("m.q") < 2, "MAJOR").otherwise("WARNING").alias("final_severity"), F.lit("INFO").alias("auto_severity"))
    return G.disposition_votes(d, ["A", "N", "R"]).drop("auto_severity", "missing_routes")


@query("A15_dimension_vote", """
with g as (select l_suppkey, l_linenumber, cast(count(*) filter (l_linestatus = 'F') as bigint) as t, cast(count(*) filter (l_linestatus = 'O') as bigint) as f from lineitem where l_returnflag <> 'N' group by 1, 2)
select l_suppkey, l_linenumber, t as true_count, f as false_count, case when f = 0 then 'consensus_true' when t = 0 then 'consensus_false' when t > f then 'majority_true' when f > t then 'majority_false' else 'split' end as agreement,
  case when t > f then true when f > t then false end as recommended from g""")
def _(s):
    v = s.lineitem.withColumn("value", F.when(F.col("l_returnflag") != "N", F.col("l_linestatus") == "F"))
    return G.dimension_vote(v, ["l_suppkey", "l_linenumber"])


@query("A17_max_severity", """
select project_id, check_id, case max(case severity when 'FATAL' then 5 when 'CRITICAL' then 4 when 'MAJOR' then 3 when 'WARNING' then 2 else 1 end) when 5 then 'FATAL' when 4 then 'CRITICAL' when 3 then 'MAJOR' when 2 then 'WARNING' else 'INFO' end as max_severity from {v_findings} f group by 1, 2""")
def _(s):
    return A.max_severity(s.v_findings, [K, "check_id"])


@query("A31_summary_rollup", "select priority, status, cast(count(*) as bigint) as n from {v_findings} f group by rollup (priority, status)")
def _(s):
    return A.summary(s.v_findings)


@query("A40_lint_summary", """
with c as (select project_id, case when severity in ('FATAL', 'CRITICAL') then 'error' when check_id = 'check_3' then 'error' else 'warning' end as s, status = 'PASS' as ok, check_id = 'check_5' as ig from {v_findings} f)
select project_id, cast(count(*) filter (not ok and s = 'error') as bigint) as errors, cast(count(*) filter (not ok and s = 'warning' and not ig) as bigint) as warnings, cast(count(*) filter (not ok and s = 'warning' and ig) as bigint) as ignored, count(*) filter (not ok and s = 'error') = 0 as passed from c group by 1""")
def _(s):
    d = s.v_findings.withColumn("severity", F.when(F.col("severity").isin("FATAL", "CRITICAL"), "error").otherwise("warning")).withColumn("passed", F.col("status") == "PASS")
    return A.lint_summary(d, ["check_5"], ["check_3"])


@query("A37_count_reconcile", """
with p as (select project_id, severity, count(distinct path) as n from (select project_id, path, min(severity) as severity from {v_findings} f group by 1, 2) q group by 1, 2), d as (select s_suppkey as project_id, 'MAJOR' as severity, cast(floor(s_acctbal / 100) as bigint) as shown from supplier)
select coalesce(p.project_id, d.project_id) as project_id, coalesce(p.severity, d.severity) as severity, cast(coalesce(n, 0) as bigint) as parsed, cast(coalesce(shown, 0) as bigint) as shown, 'count_differs' as problem from p full outer join d on p.project_id = d.project_id and p.severity = d.severity where coalesce(n, 0) <> coalesce(shown, 0)""")
def _(s):
    issues = s.v_findings.groupBy(K, F.col("path").alias("issue_id")).agg(F.min("severity").alias("severity"))
    dash = s.supplier.select(F.col("s_suppkey").alias(K), F.lit("MAJOR").alias("severity"), F.floor(F.col("s_acctbal") / 100).alias("shown"))
    return A.count_reconcile(issues, dash)


# --- numbering, gaps, order -----------------------------------------------------------------------


@query("A10_numbering_pattern", f"""
with x as (select project_id, line, section, unnest([a || '.' || b || '.' || c, cast(b as varchar)]) as figure from {FIGS} f where pr = '2'),
bad as (select *, regexp_extract(figure, '^(\\d+)', 1) as p, cast(regexp_extract(section, '^(\\d+)', 1) as bigint) - cast(regexp_extract(figure, '^(\\d+)', 1) as bigint) as o from x
  where section is not null and len(string_split(figure, '.')) >= 2 and section <> array_to_string(string_split(figure, '.')[1:2], '.')),
o as (select project_id, sum(n) as t, max(n) as top from (select project_id, o, count(*) as n from bad group by 1, 2) q group by 1), pr as (select project_id, count(*) as np, max(n) as spread from (select project_id, p, count(distinct section) as n from bad group by 1, 2) q group by 1),
s as (select o.project_id, t, (t >= 3 and top / t >= 0.8) or (np >= 3 and spread = 1) as sys from o join pr on pr.project_id = o.project_id)
select project_id, cast(null as varchar) as figure, cast(null as bigint) as line, cast(t as bigint) as mismatches, 'INFO' as severity from s where sys
union all select bad.project_id, figure, line, 1, 'MAJOR' from bad join s on s.project_id = bad.project_id where not sys""".replace("\\\\", "\\"))
def _(s):
    return A.numbering_pattern(X.figure_refs(s.v_report_lines))


@query("A11_repeated_across", f"""
select project_id, cast(b as varchar) as figure, cast(count(distinct section) as bigint) as places, min(line) as first_line, 'MAJOR' as severity from {FIGS} f where pr = '2' and section is not null group by 1, 2 having count(distinct section) > 1
union all select project_id, a || '.' || b || '.' || c, cast(count(distinct section) as bigint), min(line), 'MAJOR' from {FIGS} f where pr = '2' and section is not null group by 1, 2 having count(distinct section) > 1""")
def _(s):
    return A.repeated_across(X.figure_refs(s.v_report_lines), "figure", "section")


@query("A12_sequence_gaps", """
select l_orderkey, cast(min(l_linenumber) as bigint) as lowest, cast(max(l_linenumber) as bigint) as highest, cast(count(distinct l_linenumber) as bigint) as present, cast(max(l_linenumber) - min(l_linenumber) + 1 - count(distinct l_linenumber) as bigint) as missing,
  case when max(l_linenumber) - min(l_linenumber) + 1 - count(distinct l_linenumber) >= 3 then 'CRITICAL' else 'WARNING' end as severity from lineitem group by 1
having count(distinct l_linenumber) >= 2 and max(l_linenumber) - min(l_linenumber) + 1 > count(distinct l_linenumber)""")
def _(s):
    d = W.sequence_gaps(s.lineitem, ["l_orderkey"], "l_linenumber")
    return d.withColumn("lowest", F.col("lowest").cast("long")).withColumn("highest", F.col("highest").cast("long"))


@query("A12_gap_ranges", """
with d as (select distinct l_orderkey, l_linenumber as n from lineitem), x as (select *, lead(n) over (partition by l_orderkey order by n) as nx from d)
select l_orderkey, cast(n + 1 as bigint) as gap_start, cast(nx - 1 as bigint) as gap_end, cast(nx - n - 1 as bigint) as n from x where nx - n > 1""")
def _(s):
    return W.number_gaps(s.lineitem, ["l_orderkey"], "l_linenumber")


@query("W01_turn_ends", """
with t as (select distinct conv_id, turn from conversations) select conv_id, turn, coalesce(lead(turn) over (partition by conv_id order by turn) - 1, max(turn) over (partition by conv_id)) as turn_end from t""")
def _(s):
    from claimgrid.functions.ordered import next_row

    t = s.conversations.select("conv_id", "turn").distinct()
    m = t.groupBy("conv_id").agg(F.max("turn").alias("_m"))
    return next_row(t, ["conv_id"], "turn", F.col("turn"), "_n").join(m, "conv_id").select("conv_id", "turn", F.coalesce(F.col("_n") - 1, "_m").alias("turn_end"))


@query("W02_section_gaps", """
with h as (select project_id, line, cast(a as varchar) || '.' || b as section, cast(a as varchar) as p, b, lag(cast(a as varchar) || '.' || b) over w as prev, lag(cast(a as varchar)) over w as pp, lag(b) over w as pb from {v_vars} v where pr = '1' window w as (partition by project_id order by line))
select project_id, line, prev, section, b - pb - 1 as missing, case when b - pb - 1 >= 3 then 'CRITICAL' else 'WARNING' end as severity from h where p = pp and b - pb - 1 > 0""")
def _(s):
    return W.section_gaps(X.sections(s.v_report_lines))


@query("W05_keep_first", "select l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_partkey)) as l_partkey from lineitem group by 1, 2")
def _(s):
    d = s.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return keep_first(d, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("W06_phases", """
with c as (select conv_id as project_id, turn as ord, bool_and(length(text) > 300) as complete from conversations group by 1, 2), f as (select project_id, min(ord) filter (not complete) as f from c group by 1)
select c.project_id, ord, complete, case when complete then 'completed' when ord = f then 'in_progress' else 'blocked' end as status from c join f on f.project_id = c.project_id""")
def _(s):
    st = s.conversations.groupBy(F.col("conv_id").alias(K), F.col("turn").alias("ord")).agg(F.bool_and(F.length("text") > 300).alias("complete"))
    return W.phases(st)


@query("W06_phase_summary", """
with c as (select conv_id as project_id, turn as ord, bool_and(length(text) > 300) as complete from conversations group by 1, 2)
select project_id, bool_and(complete) as all_completed, min(ord) filter (not complete) as current_phase, cast(count(*) filter (complete) as bigint) as completed, cast(count(*) as bigint) as phases from c group by 1""")
def _(s):
    st = s.conversations.groupBy(F.col("conv_id").alias(K), F.col("turn").alias("ord")).agg(F.bool_and(F.length("text") > 300).alias("complete"))
    return W.phase_summary(st)


@query("W09_blocks", """
select project_id, line, cast(sum(case when pr = '1' then 1 else 0 end) over (partition by project_id order by line) as bigint) as block from {v_vars} v""")
def _(s):
    return W.island_ids(s.v_report_lines, [K], F.col("text").rlike(V.SECTION)).select(K, "line", F.col("block").cast("long").alias("block"))


@query("T01_severity_order", """
select project_id, check_id, severity, line, path from {v_findings} f""")
def _(s):
    return C.severity_order(s.v_findings.select(K, "check_id", "severity", "line", "path"))


@query("T02_first_samples", """
select project_id, severity, string_agg(path, ', ' order by path) as examples from (select project_id, severity, path, row_number() over (partition by project_id, severity order by path) as r from (select distinct project_id, severity, path from {v_findings} f) q) z where r <= 5 group by 1, 2""")
def _(s):
    return samples(s.v_findings, [K, "severity"], "path", 5, "examples")


@query("T03_first_match", """
select p_partkey, case when contains(p_name, 'red') then 'a' when contains(p_name, 'ring') then 'b' when contains(p_name, 'small') then 'c' else 'none' end as cls from part""")
def _(s):
    from claimgrid.functions.text import first_class

    return s.part.select("p_partkey", first_class("p_name", {"a": ["red"], "b": ["ring"], "c": ["small"]}, "none").alias("cls"))


@query("T07_top_features", """
select project_id, feature, importance from (select l_suppkey as project_id, 'f' || l_partkey as feature, max(l_extendedprice) as importance, row_number() over (partition by l_suppkey order by max(l_extendedprice) desc, 'f' || l_partkey) as r from lineitem group by 1, 2) q where r <= 10""")
def _(s):
    f = s.lineitem.groupBy(F.col("l_suppkey").alias(K), F.concat(F.lit("f"), "l_partkey").alias("feature")).agg(F.max("l_extendedprice").alias("importance"))
    return A.top_features(f, 10)


# --- tables ---------------------------------------------------------------------------------------

VIEWS["v_result_rows"] = """
select l_suppkey as project_id, case l_linenumber when 1 then '01/Diff.all.csv' when 2 then '01/Diff.up.csv' when 3 then '01/Diff.down.csv' when 4 then '02/GO.csv' when 5 then '02/KEGG.csv' when 6 then '05/feature_boruta.csv' else '05/inter_gene.csv' end as path,
  l_linenumber as ln, l_orderkey as row_no, cast(round(l_discount * 100) as bigint) as disc, l_returnflag as flag from {lineitem}"""


@query("A06_labelled_counts", """
select project_id, path, case ln when 1 then 'DEG total' when 2 then 'DEG up' when 3 then 'DEG down' when 4 then 'GO total' when 5 then 'KEGG' when 6 then 'Boruta features' else 'intersection genes' end as label, cast(count(*) as bigint) as "rows", cast(count(*) filter (ln >= 6 and flag = 'A') as bigint) as confirmed,
  cast(case when ln = 6 and count(*) filter (flag = 'A') > 0 then count(*) filter (flag = 'A') else count(*) end as bigint) as total, case when ln <= 5 then cast(count(*) filter (disc / 100.0 < 0.05) as bigint) end as significant from {v_result_rows} r group by 1, 2, ln""")
def _(s):
    r = s.v_result_rows
    p = (F.col("disc") / 100).cast("string")
    cells = F.when(F.col("ln") <= 5, F.create_map(F.lit("Gene"), F.lit("x"), F.lit("padj"), p)).otherwise(F.create_map(F.lit("Gene"), F.lit("x"), F.lit("decision"), F.when(F.col("flag") == "A", "Confirmed ").otherwise("Rejected")))
    rows = r.select(K, "path", "row_no", cells.alias("cells"))
    meta = r.select(K, "path", "ln").distinct().select(K, "path", F.when(F.col("ln") <= 5, F.array(F.lit("Gene"), F.lit("padj"))).otherwise(F.array(F.lit("Gene"), F.lit("decision"))).alias("header"))
    return A.labelled_counts(rows, meta)


@query("A07_updown_sum", """
with g as (select project_id, cast(count(*) filter (ln = 2) as bigint) as up, cast(count(*) filter (ln = 3) as bigint) as down, cast(count(*) filter (ln = 1) as bigint) as total from {v_result_rows} r group by 1)
select *, 'CRITICAL' as severity from g where up > 0 and down > 0 and total > 0 and abs(up + down - total) > 1""")
def _(s):
    c = s.v_result_rows.where("ln <= 3").groupBy(K, F.when(F.col("ln") == 1, "DEG total").when(F.col("ln") == 2, "DEG up").otherwise("DEG down").alias("label")).agg(F.count(F.lit(1)).alias("total"))
    return A.updown_sum(c)


@query("A07_updown_claims", """
with c as (select project_id, unnest([n, u]) as t from {v_vars} v where pr = '3'), u as (select project_id, unnest([n, u]) as u from {v_vars} v where pr = '3'), d as (select project_id, unnest([n, d]) as d from {v_vars} v where pr = '3')
select distinct c.project_id from c join u on u.project_id = c.project_id join d on d.project_id = c.project_id where abs(u + d - t) > 1 and abs(u + d - t) > greatest(5, floor(t * 0.02))""")
def _(s):
    return A.updown_claims(X.claims(s.v_report_lines)).select(K)


@query("A08_uniform_metric", """
select o_custkey as project_id, cast(count(*) as bigint) as models, 0.85 as auc, 'WARNING' as severity from orders where o_orderstatus = 'F' group by 1 having count(*) >= 4""".replace("0.85 as", "cast(0.85 as double) as"))
def _(s):
    m = s.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias(K), F.lit("m").alias("path"), F.col("o_orderkey").alias("model"), F.lit("0.85").alias("auc"))
    return A.uniform_metric(m)


@query("A09_monotonic", """
with g as (select project_id, case pr when '1' then 0 when '2' then 1 when '3' then 2 when '4' then 3 end as o, case pr when '1' then 'initial' when '2' then 'merged' when '3' then 'filtered' else 'final' end as st, max(n) as mx, min(n) as mn from {v_stage_lines} v where pr <> '5' and n >= 10 group by 1, 2, 3),
l as (select *, lag(st) over w as ps, lag(mx) over w as pm from g window w as (partition by project_id order by o))
select project_id, ps as stage_before, pm as count_before, st as stage_after, mn as count_after, 'CRITICAL' as severity from l where mn > pm and not (st = 'merged' and ps = 'initial')""")
def _(s):
    return A.monotonic(X.staged_counts(s.v_stage_lines.select(K, "line", "text")))


@query("A09_event_stages", """
with e as (select user_id as project_id, case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 end as o, cast(floor(value) as bigint) as n from events where event_type <> 'error'),
g as (select project_id, o, max(n) as mx, min(n) as mn from e group by 1, 2), l as (select *, lag(o) over w as po, lag(mx) over w as pm from g window w as (partition by project_id order by o))
select project_id, cast(po as bigint) as before_no, cast(o as bigint) as after_no, pm as count_before, mn as count_after from l where mn > pm and not (o = 1 and po = 0)""")
def _(s):
    st = F.when(F.col("event_type") == "view", "initial").when(F.col("event_type") == "click", "merged").when(F.col("event_type") == "signup", "filtered").when(F.col("event_type") == "purchase", "final")
    d = A.monotonic(s.events.select(F.col("user_id").alias(K), st.alias("stage"), F.floor("value").alias("n")))

    def no(c):
        return F.array_position(F.array(*[F.lit(x) for x, _ in V.COUNT_STAGES]), F.col(c)) - 1

    return d.select(K, no("stage_before").alias("before_no"), no("stage_after").alias("after_no"), "count_before", "count_after")


@query("A19_baseline_direction", """
with r as (select o_custkey as project_id, 'v' || substr(o_orderpriority, 1, 1) as variable, o_orderkey as row_no, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr, o_orderkey % 90 + 1 as a, o_orderkey % 80 + 5 as b, case when o_orderkey % 4 = 0 then 0.2 else 0.01 end as p from orders),
g as (select project_id, variable, pr, arg_min(p, row_no) as p, arg_min(a, row_no) as a, arg_min(b, row_no) as b, sum((case st when 'F' then 0 when 'O' then 1 else 3 end) * a / 100.0) as na, sum((case st when 'F' then 0 when 'O' then 1 else 3 end) * b / 100.0) as nb,
  arg_min(a, row_no) filter (st = 'O') as ya, arg_min(b, row_no) filter (st = 'O') as yb, bool_and(st = 'O') as yes_only, sum(a) as sa, sum(b) as sb from r group by 1, 2, 3),
d as (select project_id, variable, case when pr in ('1', '2') then b - a when pr in ('3', '4') then nb - na when yes_only then (sb - sa) / 100.0 else yb - ya end as d, case when pr in ('1', '2') then 'mean' when pr in ('3', '4') or yes_only then 'ordinal' else 'affirmative' end as rule from g where p < 0.05)
select project_id, variable, case when d > 0 then 'higher' else 'lower' end as direction, rule from d where abs(d) > 1e-9""")
def _(s):
    pr = F.substring("o_orderpriority", 1, 1)
    st, k = F.col("o_orderstatus"), F.col("o_orderkey")
    lv = F.when(pr.isin("1", "2"), "").when(pr.isin("3", "4"), F.when(st == "F", "0").when(st == "O", "1").otherwise(">=3")).otherwise(F.when(st == "O", "Yes").otherwise("other"))
    a, b = k % 90 + 1, k % 80 + 5

    def cell(x):
        return F.when(pr.isin("1", "2"), F.concat(x, F.lit("±2"))).otherwise(F.concat(F.lit("7("), x, F.lit("%)")))

    r = s.orders.select(F.col("o_custkey").alias(K), F.concat(F.lit("v"), pr).alias("variable"), k.alias("row_no"), lv.alias("level"), cell(a).alias("no_group"), cell(b).alias("yes_group"),
                        F.when(k % 4 == 0, "0.2").otherwise("0.01").alias("p_value"))
    return A.baseline_direction(r)


@query("A20_reference_set", """
with a as (select distinct p_brand as category, p_name as item from part), r as (select distinct p_brand as category, p_name as item from part where p_size > 25 union select 'Brand#1', 'never'),
d as (select coalesce(a.category, r.category) as category, a.item is not null as ia, r.item is not null as ir from a full outer join r on a.category = r.category and a.item = r.item)
select category, cast(count(*) filter (ir) as bigint) as expected, cast(count(*) filter (ir and ia) as bigint) as present, cast(count(*) filter (ir and not ia) as bigint) as missing, cast(count(*) filter (ia and not ir) as bigint) as extra from d group by 1""")
def _(s):
    p = s.part.select(F.col("p_brand").alias("category"), F.col("p_name").alias("item"), "p_size")
    one = s.part.groupBy().agg(F.lit("Brand#1").alias("category"), F.lit("never").alias("item"))
    return A.validate_set(p, p.where("p_size > 25").select("category", "item").unionByName(one), keys=[])


@query("A21_uniqueness", """
select l_suppkey, cast(count(l_partkey) as bigint) as records, cast(count(distinct l_partkey) as bigint) as unique_records, cast(count(l_partkey) - count(distinct l_partkey) as bigint) as duplicates from lineitem group by 1""")
def _(s):
    return A.uniqueness(s.lineitem, "l_partkey", keys=["l_suppkey"])


@query("A26_coverage_ratio", """
with a as (select distinct p_brand as project_id, p_name as item from part), c as (select distinct p_brand as project_id, p_type as module, p_name as item from part where p_size < 20), t as (select project_id, count(*) as annotated from a group by 1),
g as (select project_id, module, count(*) as covered from c group by 1, 2)
select g.project_id, module, cast(annotated as bigint) as annotated, cast(covered as bigint) as covered, cast(annotated - covered as bigint) as missing, round(covered / annotated, 6) as ratio, 'WARNING' as severity from g join t on t.project_id = g.project_id where round(covered / annotated, 6) < 0.5 and annotated - covered >= 2""")
def _(s):
    p = s.part.select(F.col("p_brand").alias(K), F.col("p_type").alias("module"), F.col("p_name").alias("item"), "p_size")
    return A.coverage_ratio(p, p.where("p_size < 20"), "item")


@query("A27_chain_reduction", """
with c as (select o_custkey as project_id, 'f' || o_orderkey as path, o_orderstatus as flow, cast(floor(o_totalprice / 1000) as bigint) as n from orders), u as (select project_id, max((n, path)) as u, count(*) as cnt from c where flow = 'F' and n > 0 group by 1)
select c.project_id, c.path, c.n as "rows", u.u[2] as upstream_path, u.u[1] as upstream_rows, round(1.0 - c.n / cast(u.u[1] as double), 6) as reduction, 'CRITICAL' as severity from c join u on u.project_id = c.project_id where flow = 'O' and n > 0 and round(1.0 - c.n / cast(u.u[1] as double), 6) >= 0.5""")
def _(s):
    c = s.orders.select(F.col("o_custkey").alias(K), F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_orderstatus").alias("flow"), F.floor(F.col("o_totalprice") / 1000).alias("rows"))
    return A.chain_reduction(c, "F", "O")


@query("A28_extra_variables", """
with u as (select distinct l_suppkey as k, 'v' || l_linenumber || l_returnflag as v from lineitem where l_quantity < 10), r as (select distinct l_suppkey as k, 'v' || l_linenumber || l_returnflag as v from lineitem where l_quantity > 49),
x as (select * from u where k in (select k from r) and not exists (select 1 from r where r.k = u.k and r.v = u.v)), n as (select k, v, row_number() over (partition by k order by v) as rn from x)
select k as project_id, cast(count(*) as bigint) as extra, string_agg(v, ', ' order by v) filter (rn <= 5) as examples, 'WARNING' as severity from n group by 1""")
def _(s):
    v = F.concat(F.lit("v"), "l_linenumber", "l_returnflag").alias("variable")
    return A.extra_variables(s.lineitem.where("l_quantity < 10").select(F.col("l_suppkey").alias(K), v), s.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias(K), v))


@query("A29_symbol_profile", """
with c as (select p_type as k, 'LINC' || p_partkey as sym, 'lncrna' as cls from part where p_size < 10 union all select p_type, 'AB-' || p_partkey, 'has_symbols' from part where p_size between 10 and 20 union all select p_type, 'TP' || p_partkey, 'standard' from part where p_size > 20),
n as (select *, row_number() over (partition by k, cls order by sym) as r from c), t as (select k, count(*) as a, count(*) filter (cls = 'standard') as s from c group by 1)
select n.k as p_type, cls, cast(count(*) as bigint) as n, string_agg(sym, ', ' order by sym) filter (r <= 5) as examples, round(100.0 * max(s) / max(a), 1)::double as standard_rate from n join t on t.k = n.k group by 1, 2""")
def _(s):
    sym = F.when(F.col("p_size") < 10, F.concat(F.lit("LINC"), "p_partkey")).when(F.col("p_size") <= 20, F.concat(F.lit("AB-"), "p_partkey")).otherwise(F.concat(F.lit("TP"), "p_partkey"))
    return A.symbol_profile(s.part.select("p_type", sym.alias("symbol")), ["p_type"])


@query("A30_parameter_index", """
with p as (select project_id, path, 'p_value_threshold' as kind, '0.0' || (1 + disc % 9) as value from {v_code_vars} v where v.kind = 'AO' union all select project_id, path, 'logFC_threshold', cast(1 + tax % 5 as varchar) from {v_code_vars} v where v.kind = 'AO')
select project_id, kind, 'code' as source, cast(count(*) as bigint) as uses, cast(count(distinct value) as bigint) as "values", cast(count(distinct path) as bigint) as files, min(value) as first_value from p group by 1, 2""")
def _(s):
    return A.parameter_index(X.parameters(s.v_code_lines))


@query("A30_identifier_index", """
with i as (select project_id, path, '25YLC' || (100 + disc % 4) || 'F' as value from {v_code_vars} v where kind = 'RO')
select i.project_id, value, cast(count(distinct path) as bigint) as files, min(path) as first_file, value is distinct from p.project_code as is_foreign from i left join {v_projects} p on p.project_id = i.project_id group by 1, 2, 5""")
def _(s):
    ids = X.extract(s.v_code_lines, V.IDENTIFIER_RULES).where("kind = 'project'")
    return A.identifier_index(ids, s.v_projects)


@query("A32_coverage_matrix", """
select l_suppkey as project_id, l_returnflag as object_class, """ + ", ".join(f"cast(count(*) filter (l_linenumber = {i}) as bigint) as {d}" for i, d in enumerate(("present", "reported", "interpreted", "structured", "sufficient"), 1)) + """ from lineitem group by 1, 2""")
def _(s):
    dims = F.element_at(F.array(*[F.lit(x) for x in ("present", "reported", "interpreted", "structured", "sufficient", "other", "other")]), F.col("l_linenumber"))
    return A.coverage_matrix(s.lineitem.select(F.col("l_suppkey").alias(K), F.col("l_returnflag").alias("object_class"), dims.alias("dimension")))


@query("A42_attribution", """
with g as (select o_custkey as project_id, o_orderpriority as item, min(o_orderkey % 3) filter (o_orderstatus = 'F') as r, min(o_orderkey % 3) filter (o_orderstatus = 'O') as s, min(o_orderkey % 3) filter (o_orderstatus = 'P') as c from orders group by 1, 2)
select project_id, item, r as report, s as result, c as code, case when r is null or s is null or c is null then 'incomplete' when r = s and s = c then 'consistent' when s = c then 'report' when r = c then 'result' when r = s then 'code' else 'all_differ' end as wrong_side from g""")
def _(s):
    src = F.when(F.col("o_orderstatus") == "F", "report").when(F.col("o_orderstatus") == "O", "result").otherwise("code")
    v = s.orders.groupBy(F.col("o_custkey").alias(K), F.col("o_orderpriority").alias("item"), src.alias("source")).agg(F.min(F.col("o_orderkey") % 3).alias("value"))
    return A.attribute(v)


@query("A43_max_vs_threshold", """
with m as (select l_suppkey as k, max(l_extendedprice) as largest from lineitem group by 1) select k as project_id, s_acctbal * 9 as threshold, largest, largest >= s_acctbal * 9 as reached from m join supplier on s_suppkey = k""")
def _(s):
    r = s.lineitem.select(F.col("l_suppkey").alias(K), F.col("l_extendedprice").cast("string").alias("pp"))
    return A.max_vs_threshold(r, s.supplier.select(F.col("s_suppkey").alias(K), (F.col("s_acctbal") * 9).alias("threshold")), "pp")


@query("A44_best_model", """
with g as (select l_suppkey as k, 'm' || l_linenumber as model, avg(l_quantity) filter (l_returnflag <> 'A') as sc from lineitem group by 1, 2) select k as project_id, arg_max(model, (sc, model)) filter (sc is not null) as best_model, round(max(sc), 6) as best_score, cast(count(*) as bigint) as combinations from g group by 1""")
def _(s):
    m = s.lineitem.select(F.col("l_suppkey").alias(K), F.concat(F.lit("m"), "l_linenumber").alias("model"), F.when(F.col("l_returnflag") == "A", "train").otherwise("valid").alias("role"), F.col("l_quantity").alias("value"))
    return A.best_model(m)
