"""Contracts over audit records derived from orders and line items."""

from functools import reduce

from pyspark.sql import functions as F

from claimgrid.operators import contracts as Q
from claimgrid.plans.queries.base import VIEWS, query
from claimgrid.rules import values as V

K = "project_id"

VIEWS["v_edges"] = """
select n_regionkey as project_id, concat('n', n_nationkey) as from_node, concat('c', c_custkey) as to_node from {customer} join {nation} on c_nationkey = n_nationkey
union all select n_regionkey, concat('c', c_custkey), concat('o', o_orderkey) from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey
union all select n_regionkey, concat('o', o_orderkey), concat('c', c_custkey) from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey where o_orderstatus = 'F'"""

VIEWS["v_nodes"] = """
select n_regionkey as project_id, concat('n', n_nationkey) as node_id, case when n_nationkey < 8 then 'raw_p' else 'fdr' end as selection_field, true as formal_selection, 'clean' as taint_status from {nation}
union all select n_regionkey, concat('c', c_custkey), case when c_mktsegment = 'HOUSEHOLD' then 'raw_p' else 'fdr' end, c_acctbal > 9000, case when c_acctbal < 0 then 'odd' else 'unknown' end from {customer} join {nation} on c_nationkey = n_nationkey
union all select n_regionkey, concat('o', o_orderkey), 'none', false, 'clean' from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey where o_orderpriority <> '5-LOW'"""


@query("G02_taint_reachability", """
with recursive e as (select distinct x.project_id, from_node, to_node from {v_edges} x join {v_nodes} n on n.project_id = x.project_id and n.node_id = x.to_node),
r(project_id, node_id, origin) as (select project_id, node_id, node_id from {v_nodes} n where selection_field = 'raw_p' and formal_selection union select r.project_id, e.to_node, r.origin from r join e on e.project_id = r.project_id and e.from_node = r.node_id)
select project_id, node_id, min(origin) as origin from r group by 1, 2""")
def _(s):
    return Q.propagate(s.v_nodes, s.v_edges)


@query("V03_statistical_flow", """
with recursive e as (select distinct x.project_id, from_node, to_node from {v_edges} x join {v_nodes} n on n.project_id = x.project_id and n.node_id = x.to_node),
r(project_id, node_id) as (select project_id, node_id from {v_nodes} n where selection_field = 'raw_p' and formal_selection union select r.project_id, e.to_node from r join e on e.project_id = r.project_id and e.from_node = r.node_id),
ends as (select project_id, from_node as n from {v_edges} a union all select project_id, to_node from {v_edges} b), err as (select project_id, n from ends where not exists (select 1 from {v_nodes} v where v.project_id = ends.project_id and v.node_id = ends.n))
select code, kind, cast(count(*) as bigint) as n from (select 'raw_p_downstream' as code, 'candidate' as kind from (select distinct * from r) x union all select 'edge_to_unknown_node', 'error' from err union all select 'taint_status_invalid', 'error' from {v_nodes} v where taint_status = 'odd') q group by 1, 2""")
def _(s):
    return Q.stat_flow(s.v_nodes, s.v_edges).groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("V01_rule_validator", """
select l_suppkey as project_id, cast(l_orderkey as varchar) as subject, code, 'error' as kind, cast(count(*) as bigint) as n from (
  select l_suppkey, l_orderkey, unnest(list_filter([case when l_returnflag not in ('A', 'N') then 'l_returnflag_invalid' end, case when not l_quantity between 2 and 48 then 'l_quantity_out_of_range' end, case when l_discount < 0.01 then 'mark_blank' end], lambda x: x is not null)) as code from lineitem) q group by 1, 2, 3
union all select project_id, cast(subject as varchar), 'l_linenumber_repeated', 'error', cast(count(*) as bigint) from (select l_suppkey as project_id, l_orderkey as subject, l_linenumber from lineitem group by 1, 2, 3 having count(*) > 1) z group by 1, 2""")
def _(s):
    d = s.lineitem.select(F.col("l_suppkey").alias(K), "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.when(F.col("l_discount") < 0.01, " ").otherwise("x").alias("mark"))
    out = Q.validate(d, [Q.one_of("l_returnflag", ["A", "N"]), Q.within("l_quantity", 2, 48), Q.filled("mark")], "l_orderkey", [K, "l_orderkey", "l_linenumber"])
    return out.groupBy(K, "subject", "code", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("V01_coercion", """
select o_orderkey, cast(case when o_orderstatus = 'P' then null else least(100, greatest(0, o_custkey - 50)) end as bigint) as score, case when o_orderstatus = 'P' then 'not_a_number' when o_custkey - 50 < 0 or o_custkey - 50 > 100 then 'clipped' end as note, case o_orderstatus when 'F' then true when 'O' then false end as flag from orders""")
def _(s):
    d = s.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((F.col("o_custkey") - 50).cast("string")).alias("raw"), F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "false").otherwise("?").alias("b"))
    score, note = Q.clip_score("raw")
    return d.select("o_orderkey", F.when(F.col("raw") != "n/a", score).alias("score"), note.alias("note"), Q.coerce_bool("b").alias("flag"))


@query("V02_dataset_scope", """
with d as (select s_suppkey as project_id, 'ds' || l as dataset_id, (s_suppkey + l) % 2 = 0 as declared, case (s_suppkey + l) % 4 when 0 then 'delivered' when 1 then 'missing' when 2 then 'unknown' else 'lost' end as src, (s_suppkey % 3) as outputs from supplier cross join (select unnest(generate_series(1, 7)) as l) g),
r as (select l_suppkey as project_id, 'ds' || l_linenumber as dataset_id, case l_returnflag when 'A' then 'active' when 'N' then 'commented' else 'unknown' end as activity, l_linestatus = 'F' and l_quantity = 1 as reachable from lineitem),
v as (select project_id, dataset_id, bool_or(activity = 'active' and reachable) as live from r group by 1, 2), j as (select d.*, coalesce(live, false) as live from d left join v on v.project_id = d.project_id and v.dataset_id = d.dataset_id)
select project_id, dataset_id as subject, 'source_status_invalid' as code, 'error' as kind, cast(1 as bigint) as n from d where src = 'lost'
union all select project_id, dataset_id, 'activity_unknown', 'candidate', cast(count(*) as bigint) from r where activity = 'unknown' group by 1, 2
union all select project_id, dataset_id, 'isolated_declaration', 'candidate', 1 from j where declared and not live and outputs = 0 union all select project_id, dataset_id, 'active_unreported', 'candidate', 1 from j where live and not declared
union all select project_id, dataset_id, 'source_unresolved', 'candidate', 1 from j where live and src in ('missing', 'unknown')""")
def _(s):
    g = s.supplier.select(F.col("s_suppkey").alias(K), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("l"))
    x = (F.col(K) + F.col("l")) % 4
    d = g.select(K, F.concat(F.lit("ds"), "l").alias("dataset_id"), ((F.col(K) + F.col("l")) % 2 == 0).alias("declared"), F.when(x == 0, "delivered").when(x == 1, "missing").when(x == 2, "unknown").otherwise("lost").alias("source_status"), (F.col(K) % 3).alias("outputs"))
    a = F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "N", "commented").otherwise("unknown")
    r = s.lineitem.select(F.col("l_suppkey").alias(K), F.concat(F.lit("ds"), "l_linenumber").alias("dataset_id"), a.alias("activity"), ((F.col("l_linestatus") == "F") & (F.col("l_quantity") == 1)).alias("reachable"))
    return Q.dataset_scope(d, r).groupBy(K, "subject", "code", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("V04_method_code", """
select o_custkey as project_id, cast(o_orderkey as varchar) as subject, 'match_status_invalid' as code, 'error' as kind from orders where o_orderpriority = '5-LOW'
union all select o_custkey, cast(o_orderkey as varchar), 'parameters_missing', 'error' from orders where o_orderstatus = 'P' union all select o_custkey, cast(o_orderkey as varchar), 'method_review', 'candidate' from orders where o_orderpriority in ('2-HIGH', '3-MEDIUM')""")
def _(s):
    p = F.col("o_orderpriority")
    st = F.when(p == "1-URGENT", "match").when(p == "2-HIGH", "mismatch").when(p == "3-MEDIUM", "unknown").when(p == "5-LOW", "so-so").otherwise("not_applicable")
    x = F.lit("x")
    return Q.method_code(s.orders.select(F.col("o_custkey").alias(K), F.col("o_orderkey").alias("analysis_id"), st.alias("match_status"), F.when(F.col("o_orderstatus") != "P", x).alias("parameters"),
                                         *[x.alias(c) for c in ("report_method", "implementation", "outputs", "differences")]))


@query("V05_ml_lineage", """
with m as (select l_suppkey as project_id, l_orderkey || '-' || l_linenumber as metric_id, l_linenumber as a, 'p' || cast(l_quantity as bigint) as pid, l_returnflag <> 'N' as pub, case l_linestatus when 'F' then 'train' else 'test' end as role from lineitem),
p as (select distinct l_suppkey as project_id, l_linenumber as a, 'p' || cast(l_quantity as bigint) as pid from lineitem where l_returnflag = 'A')
select project_id, metric_id as subject, 'metric_without_prediction' as code, 'error' as kind, cast(count(*) as bigint) as n from m where pub and not exists (select 1 from p where p.project_id = m.project_id and p.a = m.a and p.pid = m.pid) group by 1, 2
union all select project_id, metric_id, 'metric_role', 'candidate', cast(count(*) as bigint) from m where pub and role = 'train' group by 1, 2
union all select o_custkey, cast(o_orderkey as varchar), 'scope_invalid', 'error', 1 from orders where o_orderpriority = '5-LOW' union all select o_custkey, cast(o_orderkey as varchar), 'selection_leakage', 'candidate', 1 from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')
union all select project_id, pid, 'external_identity', 'candidate', cast(count(*) as bigint) from p where a = 3 group by 1, 2""")
def _(s):
    li = s.lineitem
    pid = F.concat(F.lit("p"), F.col("l_quantity").cast("long")).alias("prediction_id")
    m = li.select(F.col("l_suppkey").alias(K), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("metric_id"), F.col("l_linenumber").alias("analysis_id"), pid, (F.col("l_returnflag") != "N").alias("published"), F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("data_role"))
    p = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias(K), F.col("l_linenumber").alias("analysis_id"), pid).distinct().withColumn("data_role", F.when(F.col("analysis_id") == 3, "external").otherwise("test")).withColumn("sample_identity_hash", F.lit(None).cast("string"))
    pr = F.col("o_orderpriority")
    sel = s.orders.select(F.col("o_custkey").alias(K), F.col("o_orderkey").alias("selection_id"), F.when(pr == "1-URGENT", "pre_split").when(pr == "2-HIGH", "unknown").when(pr == "5-LOW", "odd").otherwise("fold_inner").alias("scope"), (F.col("o_orderstatus") == "F").alias("supervised"))
    return Q.ml_lineage(m, p, sel).groupBy(K, "subject", "code", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("V06_high_risk", """
with m as (select c_custkey as project_id, 'm' || c_custkey as id, case c_mktsegment when 'HOUSEHOLD' then 'molecular_docking' when 'MACHINERY' then 'virtual_knockout' else 'other' end as t from customer),
i(t, item) as (values """ + ", ".join(f"('{t}', '{i}')" for t in ("molecular_docking", "virtual_knockout") for i in V.HIGH_RISK_PACKAGES[t]) + """),
d(dim) as (values ('module_exists'), ('evidence_sufficient'), ('reproducible'), ('conclusion_not_overstated')), g as (select * from m where t <> 'other')
select project_id, id as subject, 'module_type_invalid' as code, 'error' as kind from m where t = 'other'
union all select project_id, id || '/' || dim, 'dimension_status_invalid', 'error' from g cross join d where dim = 'reproducible' union all select project_id, id || '/module_exists', 'dimension_review', 'candidate' from g
union all select project_id, id || '/' || item, 'item_without_disposition', 'error' from g join i on i.t = g.t where item not in ('ligand_list', 'structured_result_table') union all select project_id, id || '/ligand_list', 'evidence_review', 'candidate' from g where t = 'molecular_docking'
union all select project_id, id || '/structured_result_table', 'item_status_invalid', 'error' from g where t = 'virtual_knockout'""")
def _(s):
    t = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "molecular_docking").when(F.col("c_mktsegment") == "MACHINERY", "virtual_knockout").otherwise("other")
    m = s.customer.select(F.col("c_custkey").alias(K), F.concat(F.lit("m"), "c_custkey").alias("module_id"), t.alias("module_type"))
    st = F.array(*[F.struct(F.lit(a).alias("d"), F.lit(b).alias("s")) for a, b in (("module_exists", "unknown"), ("evidence_sufficient", "pass"), ("conclusion_not_overstated", "not_applicable"), ("reproducible", "odd"))])
    d = m.select(K, "module_id", F.explode(st).alias("x")).select(K, "module_id", F.col("x.d").alias("dimension"), F.col("x.s").alias("status"))
    it = F.when(F.col("module_type") == "molecular_docking", "ligand_list").otherwise("structured_result_table")
    p = m.select(K, "module_id", it.alias("item_id"), F.when(F.col("module_type") == "molecular_docking", "missing").otherwise("odd").alias("status"))
    return Q.high_risk(m, d, p)


@query("G03_pair_coverage", """
with m as (select distinct l_linestatus as project_id, l_orderkey as merge_id, l_linenumber as member from lineitem), c as (select l_linestatus as project_id, l_orderkey as merge_id, l_linenumber as x, 1 + l_partkey % 7 as y, l_returnflag <> 'R' as ok from lineitem),
p as (select c.project_id, c.merge_id, least(x, y) as x, greatest(x, y) as y, bool_and(ok) as ok from c join m a on a.project_id = c.project_id and a.merge_id = c.merge_id and a.member = c.x join m b on b.project_id = c.project_id and b.merge_id = c.merge_id and b.member = c.y where x <> y group by 1, 2, 3, 4),
n as (select project_id, merge_id, count(*) as members from m group by 1, 2), k as (select project_id, merge_id, count(*) as checked, count(*) filter (not ok) as bad from p group by 1, 2)
select n.project_id, n.merge_id, cast(members as bigint) as members, cast(coalesce(checked, 0) as bigint) as checked, cast(coalesce(bad, 0) as bigint) as incompatible, cast(members * (members - 1) / 2 as bigint) as needed from n left join k on k.project_id = n.project_id and k.merge_id = n.merge_id where coalesce(checked, 0) < members * (members - 1) / 2 or coalesce(bad, 0) > 0 or members < 2""")
def _(s):
    li = s.lineitem.select(F.col("l_linestatus").alias(K), F.col("l_orderkey").alias("merge_id"), F.col("l_linenumber").cast("long").alias("member"), "l_partkey", "l_returnflag")
    m = li.select(K, "merge_id", "member")
    c = li.select(K, "merge_id", F.col("member").alias("left_id"), (F.col("l_partkey") % 7 + 1).alias("right_id"), (F.col("l_returnflag") != "R").alias("linked"))
    return Q.pair_coverage(m, c)


VIEWS["v_dispositions"] = """
select l_suppkey as project_id, concat(l_orderkey, '-', l_linenumber) as raw_finding_id, case l_returnflag when 'A' then 'accept' when 'N' then 'merge' else 'reject' end as decision, case when l_discount < 0.01 then '' else 'why' end as reason,
  concat('C', l_partkey) as canonical_id, l_linestatus as ls from {lineitem}"""


@query("V07_arbitration", """
with d as (select * from {v_dispositions} v), f as (select project_id, raw_finding_id, min(decision) as decision from d group by 1, 2), lk as (select distinct project_id, raw_finding_id, canonical_id from d where ls = 'F'), src as (select distinct project_id, canonical_id, raw_finding_id from d where decision <> 'reject'), can as (select distinct project_id, canonical_id from d where decision = 'accept'),
lr as (select distinct project_id, raw_finding_id from lk),
e as (select project_id, 'reason_blank' as code from d where reason = '' union all select project_id, 'raw_finding_id_repeated' from d group by project_id, raw_finding_id having count(*) > 1
union all select f.project_id, 'reject_maps_to_finding' from f join lr on lr.project_id = f.project_id and lr.raw_finding_id = f.raw_finding_id where decision = 'reject'
union all select f.project_id, 'decision_maps_to_none' from f where decision <> 'reject' and not exists (select 1 from lr where lr.project_id = f.project_id and lr.raw_finding_id = f.raw_finding_id)
union all select project_id, 'maps_to_unknown_finding' from lk where not exists (select 1 from can where can.project_id = lk.project_id and can.canonical_id = lk.canonical_id)
union all select lk.project_id, 'mapping_absent_from_sources' from lk join can on can.project_id = lk.project_id and can.canonical_id = lk.canonical_id where not exists (select 1 from src where src.project_id = lk.project_id and src.canonical_id = lk.canonical_id and src.raw_finding_id = lk.raw_finding_id)
union all select s_suppkey, 'raw_count_differs' from supplier left join (select project_id, count(distinct raw_finding_id) as n from d group by 1) q on q.project_id = s_suppkey where coalesce(n, 0) <> 600
union all select s_suppkey, 'confirmed_with_unresolved' from supplier where s_suppkey % 2 = 0 and s_suppkey % 3 <> 0)
select project_id, code, cast(count(*) as bigint) as n from e group by 1, 2""")
def _(s):
    d = s.v_dispositions
    links = d.where("ls = 'F'").select(K, "raw_finding_id", "canonical_id")
    can = d.where("decision = 'accept'").select(K, "canonical_id").distinct().withColumn("severity", F.lit("MAJOR"))
    can = reduce(lambda x, f: x.withColumn(f, F.lit("x")), V.SEMANTIC_FIELDS, can)
    src = d.where("decision <> 'reject'").select(K, "canonical_id", "raw_finding_id").distinct()
    dec = s.supplier.select(F.col("s_suppkey").alias(K), F.lit(600).alias("raw_finding_count"), F.when(F.col("s_suppkey") % 2 == 0, "leader_confirmed").otherwise("draft").alias("status"), (F.col("s_suppkey") % 3).alias("unresolved_count"))
    return Q.arbitration(d.select(K, "raw_finding_id", "decision", "reason"), links, can, src, dec).groupBy(K, "code").agg(F.count(F.lit(1)).alias("n"))


@query("V07_unresolved_duplicates", """
with k as (select project_id, canonical_id, error_mechanism || '|' || repair_path as k, module from {v_canonical} c), g as (select project_id, k, min(canonical_id) as m, count(*) as n from k group by 1, 2 having count(*) > 1),
p as (select k.project_id, k.k, count(*) as d from k join g on g.project_id = k.project_id and g.k = k.k join k x on x.project_id = g.project_id and x.canonical_id = m where k.canonical_id <> m and k.module <> x.module group by 1, 2)
select g.project_id, m as group_id, cast(n as bigint) as group_size, cast(n * (n - 1) // 2 as bigint) as pairs_needed, cast(coalesce(d, 0) as bigint) as pairs_decided from g left join p on p.project_id = g.project_id and p.k = g.k where coalesce(d, 0) < n * (n - 1) // 2""")
def _(s):
    c = s.v_canonical.withColumn("refs", F.array().cast("array<struct<path:string,locator:string>>"))
    mate = s.v_canonical.groupBy(K, "error_mechanism", "repair_path").agg(F.min("canonical_id").alias("left_id"))
    ind = s.v_canonical.join(mate, [K, "error_mechanism", "repair_path"]).where("canonical_id <> left_id").select(K, "left_id", F.col("canonical_id").alias("right_id"), F.lit("module").alias("dimension"), F.lit(True).alias("own_evidence"))
    return Q.unresolved_duplicates(c, ind).drop("reason", "shared_key")


@query("V08_decision", """
with c as (select c_custkey as k, c_mktsegment as m, cast(floor(c_acctbal) as bigint) as b from customer)
select k as project_id, cast(k as varchar) as subject, 'status_not_confirmed' as code, 'error' as kind from c where m = 'HOUSEHOLD' union all select k, cast(k as varchar), 'confirmed_at_invalid', 'error' from c where m = 'MACHINERY'
union all select k, cast(k as varchar), 'score_invalid', 'error' from c where not b % 200 between 0 and 100 union all select k, cast(k as varchar), 'verdict_release_invalid', 'error' from c where m = 'FURNITURE'
union all select k, cast(k as varchar), 'count_not_severity_sum', 'error' from c where m = 'BUILDING' union all select k, cast(k as varchar), 'unresolved_left', 'error' from c where b % 3 <> 0 union all select k, 'arbitration', 'source_hash_differs', 'error' from c where b % 2 <> 0""")
def _(s):
    m, b = F.col("c_mktsegment"), F.floor("c_acctbal")
    d = s.customer.select(
        F.col("c_custkey").alias(K), F.col("c_custkey").cast("string").alias("declared_project"), F.when(m == "HOUSEHOLD", "draft").otherwise("leader_confirmed").alias("status"), F.lit("x").alias("confirmed_by"),
        F.when(m == "MACHINERY", "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+08:00").alias("confirmed_at"), (b % 200).alias("score"), F.lit(100).alias("score_scale"), F.lit("合格").alias("verdict"), F.when(m == "FURNITURE", "BLOCK").otherwise("ALLOW").alias("release_decision"),
        *[F.lit(1).alias(x) for x in V.SEVERITIES], F.when(m == "BUILDING", 4).otherwise(5).alias("canonical_finding_count"), (b % 3).alias("unresolved_count"))
    src = s.customer.select(F.col("c_custkey").alias(K), F.lit("arbitration").alias("source"), F.lit("0").alias("recorded_sha256"), (b % 2).cast("string").alias("actual_sha256"))
    return Q.decision(d, src)


@query("V11_modes", """
with r as (select l_suppkey as project_id, 'c' || l_linenumber as contract, case when l_linenumber < 3 then 'off' when l_linenumber < 6 then 'shadow' else 'enforce' end as mode, case l_returnflag when 'A' then 'error' when 'N' then 'candidate' end as kind from lineitem),
g as (select project_id, contract, mode, cast(count(*) filter (kind = 'error') as bigint) as errors, cast(count(*) filter (kind = 'candidate') as bigint) as candidates from r where mode <> 'off' group by 1, 2, 3) select *, errors > 0 as would_block, errors > 0 and mode = 'enforce' as blocking from g""")
def _(s):
    n = F.col("l_linenumber")
    r = s.lineitem.select(F.col("l_suppkey").alias(K), F.concat(F.lit("c"), n).alias("contract"), F.when(n < 3, "off").when(n < 6, "shadow").otherwise("enforce").alias("mode"), F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "N", "candidate").alias("kind"))
    return Q.apply_mode(r)


@query("V12_slices", """
with m as (select o_custkey as project_id, o_orderkey as id, o_orderstatus as agent, substr(o_orderpriority, 1, 1) as pr from orders)
select project_id, id as slice_id, agent, case pr when '1' then 'slice_missing' when '2' then case when agent <> 'F' then 'wrong_owner' end when '3' then 'not_completed' when '4' then 'findings_missing' end as problem from m where pr in ('1', '3', '4') or (pr = '2' and agent <> 'F')""")
def _(s):
    o = s.orders.select(F.col("o_custkey").alias(K), F.col("o_orderkey").alias("slice_id"), F.col("o_orderstatus").alias("agent"), F.substring("o_orderpriority", 1, 1).alias("pr"))
    r = o.where("pr <> '1'").select(K, "slice_id", F.when(F.col("pr") == "2", "F").otherwise(F.col("agent")).alias("agent"), F.when(F.col("pr") == "3", "running").otherwise("completed").alias("status"), (F.col("pr") != "4").alias("has_findings"), F.lit("s").alias("summary"))
    return Q.slices(o.drop("pr"), r)


@query("V13_policy_binding", "select c_custkey as project_id, c_mktsegment as policy_version, case when c_acctbal < 0 then 'old' else 'abc' end as policy_hash, case when c_mktsegment <> 'BUILDING' then 'version' else 'hash' end as differs from customer where c_mktsegment <> 'BUILDING' or c_acctbal < 0")
def _(s):
    m = s.customer.select(F.col("c_custkey").alias(K), F.col("c_mktsegment").alias("policy_version"), F.when(F.col("c_acctbal") < 0, "old").otherwise("abc").alias("policy_hash"))
    return Q.policy_binding(m, "BUILDING", "abc")


@query("V14_required_items", """
with p as (select c_custkey as project_id from customer), f as (select distinct o_custkey as project_id, case o_orderstatus when 'F' then 'final.md' when 'O' then 'lint.json' else 'x' end as item from orders), m as (select distinct o_custkey as project_id, substr(o_orderpriority, 1, 1) as pr from orders)
select project_id, 'file' as kind, item from (select project_id, unnest(['final.md', 'lint.json']) as item from p) n where not exists (select 1 from f where f.project_id = n.project_id and f.item = n.item)
union all select project_id, 'section', '结论' from p where not exists (select 1 from m where m.project_id = p.project_id and pr = '1')
union all select project_id, 'code_risk', '代码不可复现' from p where project_id % 2 = 0 and not exists (select 1 from m where m.project_id = p.project_id and pr = '2')""")
def _(s):
    p = s.customer.select(F.col("c_custkey").alias(K))
    f = s.orders.select(F.col("o_custkey").alias(K), F.when(F.col("o_orderstatus") == "F", "final.md").when(F.col("o_orderstatus") == "O", "lint.json").otherwise("x").alias("path"))
    pr = F.substring("o_orderpriority", 1, 1)
    lines = s.orders.select(F.col("o_custkey").alias(K), F.when(pr == "1", "# 结论 x").when(pr == "2", "风险：代码不可复现。").otherwise("y").alias("text"))
    return Q.required_items(p, f, lines, ["final.md", "lint.json"], ["结论"], p.withColumn("code", F.col(K) % 2))


@query("V15_readiness", """
with g as (select l_suppkey as project_id, l_orderkey as k, bool_and(l_quantity > 5) filter (l_returnflag = 'A') as a, bool_and(l_quantity > 5) filter (l_returnflag = 'N') as n, bool_and(l_quantity > 5) filter (l_returnflag = 'R') as r from lineitem group by 1, 2)
select k as project_id, array_to_string(list_filter([case when not coalesce(bool_and(a), false) then 'A' end, case when not coalesce(bool_and(n), false) then 'N' end, case when not coalesce(bool_and(r), false) then 'R' end], lambda x: x is not null), ',') as failed,
  coalesce(bool_and(a), false) and coalesce(bool_and(n), false) and coalesce(bool_and(r), false) as ready from g group by 1""")
def _(s):
    g = s.lineitem.select(F.col("l_orderkey").alias(K), F.col("l_returnflag").alias("gate"), (F.col("l_quantity") > 5).alias("passed"))
    return Q.readiness(g, ["A", "N", "R"])


@query("R03_receipt_actions", """
with r as (select o_custkey as project_id, arg_max(case o_orderpriority when '1-URGENT' then 'sent' when '2-HIGH' then 'pending' when '3-MEDIUM' then 'failed' when '4-NOT SPECIFIED' then 'weird' else 'sent' end, o_orderkey) as st, arg_max(o_orderstatus, o_orderkey) as dec, arg_max(o_orderkey % 2, o_orderkey) as body from orders group by 1)
select c_custkey as project_id, case when st is null then 'send' when st = 'weird' then 'block_invalid_status' when st = 'sent' and dec = 'F' and body = 0 then 'skip_sent' when dec <> 'F' then 'block_other_decision' when st = 'pending' then 'block_unknown_state' when st = 'sent' then 'block_other_body' else 'send' end as action from customer left join r on r.project_id = c_custkey""")
def _(s):
    req = s.customer.select(F.col("c_custkey").alias(K), F.lit("F").alias("decision_sha256"), F.lit("0").alias("body_sha256"), F.lit("mail").alias("channel"))
    p = F.col("o_orderpriority")
    st = F.when(p == "2-HIGH", "pending").when(p == "3-MEDIUM", "failed").when(p == "4-NOT SPECIFIED", "weird").otherwise("sent")
    rec = s.orders.select(F.col("o_custkey").alias(K), F.col("o_orderkey").alias("seq"), st.alias("status"), F.col("o_orderstatus").alias("decision_sha256"), (F.col("o_orderkey") % 2).cast("string").alias("body_sha256"), F.lit("mail").alias("channel"))
    return Q.receipt_action(req, rec).select(K, "action")
