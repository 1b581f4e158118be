"""Linkage and clusters of route findings."""

from pyspark.sql import functions as F

from claimgrid.operators import converge as G
from claimgrid.plans.queries.base import VIEWS, query

K = "project_id"
ROUTES = ["A", "B", "C"]

# Route findings: one row per order; project = customer, route by order number.
VIEWS["v_route_findings"] = """
select o_custkey as project_id, case o_orderkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end as agent, o_orderkey as pos, concat('f', o_orderkey) as id,
  case o_orderstatus when 'F' then 'FATAL' when 'O' then 'MAJOR' else 'INFO' end as severity, concat('d', substr(o_orderpriority, 1, 1)) as dimension,
  case substr(o_orderpriority, 1, 1) when '1' then concat('Section 1.', 1 + o_orderkey % 4) when '2' then concat('1.', 1 + o_orderkey % 4, '.', 1 + o_orderkey % 2) when '3' then '' when '4' then concat('Figure part ', o_orderkey % 2) else 'figure part' end as location,
  concat('wrong ', o_orderstatus, ' value ', o_orderkey % 5) as description, case when o_orderpriority = '3-MEDIUM' then concat('r', o_orderkey % 2) else '' end as rule, 'table' as source_type, concat('t', o_orderkey % 6) as source_path,
  concat('l', o_orderkey % 2) as locator, o_orderstatus as quote_or_value, case when o_orderstatus = 'P' then '' else 'seen' end as evidence, case when o_totalprice > 480000 then 'figure_identity' else '' end as protected_category,
  case when o_totalprice < 100000 then concat('m', o_orderkey % 2) else '' end as module from {orders}"""

P = r"""(select project_id, agent, case agent when 'A' then 0 when 'B' then 1 else 2 end * 1099511627776 + pos as ord, id, lower(location) as loc, dimension as dim, rule, string_split(lower(description), ' ') as tok, protected_category as cat, module as sem,
  dimension || rule || source_path || locator || quote_or_value as fkey, regexp_extract_all(lower(location), '\d+(?:\.\d+)*') as secs from {v_route_findings} v)"""

LINKS = P.join(["""(with p as (select *, case when len(secs) > 0 then list_last(list_sort(list_transform(secs, lambda s: {'n': length(s), 's': s}))).s end as best from """, """ x),
j as (select a.project_id, a.id as left_id, b.id as right_id, a.fkey = b.fkey as same_key, a.dim as ad, b.dim as bd, a.rule as ar, b.rule as br, a.loc as al, b.loc as bl, a.best, b.secs, a.secs as asecs, a.tok as ta, b.tok as tb
  from p a join p b on a.project_id = b.project_id and a.agent <> b.agent and a.ord < b.ord and a.cat = b.cat and not (a.sem <> '' and b.sem <> '' and a.sem <> b.sem)),
s as (select *, round(case when al = '' or bl = '' then 0 when al = bl then 0.4 when best is not null and len(secs) > 0 then coalesce(list_filter(list_transform(secs, lambda s: case when s = best then 0.4 when starts_with(best, s || '.') or starts_with(s, best || '.') then 0.25 end), lambda z: z is not null)[1], 0)
  when contains(al, bl) or contains(bl, al) then 0.2 else 0 end + case when ad = bd then 0.2 else 0 end + case when ar <> '' and ar = br then 0.2 else 0 end
  + 0.2 * len(list_intersect(ta, tb)) / cast(len(list_distinct(list_concat(ta, tb))) as double), 9) as score from j)
select project_id, left_id, right_id, cast(score as double) as score from s where same_key or score >= 0.4)"""])


@query("J25_link_pairs", f"select * from {LINKS} l")
def _(s):
    d = G.link_pairs(G.prepare(s.v_route_findings, ROUTES))
    # each row that has the place of an end is an end
    d = d.withColumn("_n", F.explode(F.array_repeat(F.lit(0), (F.col("left_times") * F.col("right_times")).cast("int"))))
    name = lambda side: F.concat(F.lit("f"), G.position(f"{side}_ord", f"{side}_agent", ROUTES))
    return d.select(K, name("left").alias("left_id"), name("right").alias("right_id"), F.round("score", 9).alias("score"))


def _cluster_sql() -> str:
    """The clusters step by step: rank pairs under each key, then a recursive walk through the units of each project in
    order, each taking its first free finding."""
    keep = "case when min({0}) = max({0}) and count({0}) = count(*) then min({0}) end as {0}"

    def merged(n: int, pairs: str) -> str:
        return (f"u{n + 1} as materialized (select u.project_id, coalesce(p.uid, u.uid) as uid, list_sort(flatten(list(agents))) as agents, list_sort(flatten(list(members))) as members, "
                f"{', '.join(keep.format(k) for k in ('k1', 'k3', 'k4'))} from u{n} u left join {pairs} p on p.project_id = u.project_id and p.joins = u.uid group by 1, 2)")

    steps, n = [], 0
    for key in ("k1", "k3", "k4"):
        for s in ROUTES[1:]:
            rank = f"row_number() over (partition by project_id, {key} order by uid) as n from u{n} where {key} is not null and"
            steps += [f"lack{n} as materialized (select project_id, {key} as k, uid, {rank} not list_contains(agents, '{s}'))",
                      f"sing{n} as materialized (select project_id, {key} as k, uid as joins, {rank} len(agents) = 1 and list_contains(agents, '{s}'))",
                      f"pair{n} as materialized (select a.project_id, a.uid, b.joins from lack{n} a join sing{n} b using (project_id, k, n))", merged(n, f"pair{n}")]
            n += 1
        if key == "k1":
            steps += [f"closed as materialized (select project_id, uid, members, 'exact' as match_mode from u{n} where len(agents) > 1)", f"u{n + 1} as materialized (select * from u{n} where len(agents) = 1)"]
            n += 1
    for s in ROUTES[1:]:
        steps += [f"""cand{n} as materialized (select l.project_id, l.uid, v, row_number() over (partition by l.project_id order by l.uid) as i from (select c.project_id, c.uid, list(c.v order by c.v) as v from (
    select u.project_id, u.uid, e.v from (select project_id, uid, members, unnest(members) as m from u{n} where not list_contains(agents, '{s}')) u join ends e on e.project_id = u.project_id and e.m = u.m and e.agent = '{s}'
    join (select project_id, uid from u{n} where len(agents) = 1 and list_contains(agents, '{s}')) x on x.project_id = u.project_id and x.uid = e.v
    group by u.project_id, u.uid, u.members, e.v having count(*) = len(u.members)) c group by 1, 2) l)""",
                  f"""walk{n} as (select project_id, cast(0 as bigint) as i, cast([] as bigint[]) as taken, cast(null as bigint) as uid, cast(null as bigint) as joins from cand{n} where i = 1
    union all select w.project_id, c.i, case when f.v is null then w.taken else list_append(w.taken, f.v) end, c.uid, f.v from walk{n} w join cand{n} c on c.project_id = w.project_id and c.i = w.i + 1,
    lateral (select list_filter(c.v, lambda x: not list_contains(w.taken, x))[1] as v) f)""",
                  f"pair{n} as materialized (select project_id, uid, joins from walk{n} where joins is not null)", merged(n, f"pair{n}")]
        n += 1
    return f"""
with recursive items as materialized (select * from {P} y),
ends as materialized (select l.project_id, a.ord as m, b.ord as v, b.agent from {LINKS} l join items a on a.id = l.left_id join items b on b.id = l.right_id
    union all select l.project_id, b.ord, a.ord, a.agent from {LINKS} l join items a on a.id = l.left_id join items b on b.id = l.right_id),
u0 as materialized (select project_id, ord as uid, [agent] as agents, [ord] as members, fkey || '|' || cat || '|' || sem as k1, case when loc <> '' then loc || '|' || cat || '|' || sem end as k3,
    case when rule <> '' then dim || '|' || rule || '|' || cat || '|' || sem end as k4 from items),
{', '.join(steps)}
select c.project_id, c.uid as cluster_id, i.agent, i.ord % 1099511627776 as pos, match_mode from (select project_id, uid, match_mode, unnest(members) as m from
    (select * from closed union all select project_id, uid, members, case when len(members) > 1 then 'similarity' else 'single' end from u{n}) z) c join items i on i.ord = c.m"""


@query("G01_clusters", _cluster_sql())
def _(s):
    return G.cluster_findings(s.v_route_findings, ROUTES).select(K, "cluster_id", "agent", "pos", "match_mode")


@query("G01_cluster_invariants", """
select cast(count(*) as bigint) as findings, cast(0 as bigint) as routes_twice, cast(0 as bigint) as findings_twice from orders""")
def _(s):
    """Every finding is in one cluster and no cluster holds a route twice."""
    m = G.cluster_findings(s.v_route_findings, ROUTES).withColumn("_side", F.explode(F.array(F.lit("route"), F.lit("finding"))))
    # both sides meet in one aggregation, so that clusters are made once: a group is a route of a cluster, or a finding
    route, found = F.col("_side") == "route", F.col("_side") == "finding"
    per = m.groupBy("_side", K, "agent", F.when(route, F.col("cluster_id")).otherwise(F.col("pos")).alias("_at"), F.when(found, F.col("raw_finding_id")).alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum(F.when(route, F.col("n"))).alias("findings"), F.count_if(route & (F.col("n") > 1)).alias("routes_twice"), F.count_if(found & (F.col("n") > 1)).alias("findings_twice"))


VIEWS["v_members"] = """
select l_suppkey as project_id, l_orderkey as cluster_id, l_returnflag as agent, case l_linestatus when 'F' then 'MAJOR' else 'WARNING' end as severity, 'p' as source_path, 'l' as locator, 'q' as quote_or_value,
  case when l_discount < 0.02 then '' else 'e' end as evidence from {lineitem}"""

CLASSES = """(select project_id, cluster_id, cast(count(distinct agent) as bigint) as agents, cast(count(distinct severity) as bigint) as severities,
  case when count(distinct agent) = 3 and count(distinct severity) <= 1 then 'consensus' when count(distinct agent) >= 2 then 'majority' else 'single' end as cluster_class, cast(3 as bigint) as routes_total from {v_members} m group by 1, 2)"""


@query("A16_cluster_classes", f"select * from {CLASSES} c")
def _(s):
    return G.classify_clusters(s.v_members, 3)


@query("A16_convergence_metrics", f"""
select project_id, cast(count(*) as bigint) as clusters, round(100.0 * count(*) filter (cluster_class = 'consensus') / count(*), 1)::double as consensus_rate, round(100.0 * count(*) filter (cluster_class = 'majority') / count(*), 1)::double as majority_rate,
  round(100.0 * count(*) filter (cluster_class = 'single') / count(*), 1)::double as single_rate, 0.0::double as divergent_rate, round(100.0 * count(*) filter (cluster_class = 'consensus') / count(*), 1) >= 95 as converged from {CLASSES} c group by 1""")
def _(s):
    return G.convergence_metrics(G.classify_clusters(s.v_members, 3))


@query("A18_arbitration_queue", f"""
with m as (select project_id, cluster_id, case when bool_or(severity = 'MAJOR') then 'MAJOR' else 'WARNING' end as severity, bool_and(evidence <> '') as evidence_complete from {{v_members}} m group by 1, 2)
select c.project_id, c.cluster_id, cluster_class, agents, severity, evidence_complete, cast(case cluster_class when 'single' then 2 when 'consensus' then 3 else 4 end as bigint) as queue_rank from {CLASSES} c join m on m.project_id = c.project_id and m.cluster_id = c.cluster_id""")
def _(s):
    return G.arbitration_queue(s.v_members, 3).withColumn("queue_rank", F.col("queue_rank").cast("long"))
