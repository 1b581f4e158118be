"""File inventories, modules, visual assets."""

from pyspark.sql import functions as F

from claimgrid.functions import text as T
from claimgrid.operators import aggregate as A, extract as X, similarity as S
from claimgrid.plans.queries.base import VIEWS, query
from claimgrid.rules import values as V

K = "project_id"


@query("A03_module_profile", """
select project_id, module, cast(count(*) as bigint) as total, cast(count(*) filter (ext in ('.R', '.py')) as bigint) as code, cast(count(*) filter (ext in ('.csv', '.tsv', '.txt', '.rds')) as bigint) as data,
  cast(count(*) filter (ext in ('.png', '.jpg', '.svg')) as bigint) as images, cast(count(*) filter (ext = '.pdf') as bigint) as pdf, cast(count(*) filter (ext = '.rds') as bigint) as "binary",
  cast(count(*) filter (ext in ('.csv', '.tsv') and size > 100) as bigint) as tables from {v_files} f group by 1, 2""")
def _(s):
    return A.module_profile(s.v_files)


@query("A04_figure_data_ratio", """
with f as (select *, regexp_extract(path, '_(\\d+)\\.', 1) as unit from {v_files} v), p as (select project_id, module || '/' || unit as module, cast(count(*) filter (ext in ('.png', '.jpg', '.svg', '.pdf')) as bigint) as visual, cast(count(*) filter (ext in ('.csv', '.tsv') and size > 100) as bigint) as tables,
  count(*) filter (ext = '.rds') as bin from f group by 1, 2),
w as (select *, regexp_matches(module, '(?i)deg|enrich|ml|machine|immune') as wants from p)
select project_id, module, visual, tables, 'figures_without_table' as problem, 'WARNING' as severity from w where visual >= 5 and tables = 0 and wants
union all select project_id, module, visual, tables, 'no_data_files', 'INFO' from w where visual >= 5 and tables = 0 and not wants and bin = 0
union all select project_id, module, visual, tables, 'tables_without_figure', 'INFO' from w where tables > 20 and visual = 0""".replace("\\\\", "\\"))
def _(s):
    unit = s.v_files.withColumn("module", F.concat_ws("/", "module", F.regexp_extract("path", r"_(\d+)\.", 1)))
    return A.figure_data_ratio(A.module_profile(unit))


@query("A05_delivery_gaps", """
with u as (select project_id, module || '/' || regexp_extract(path, '_(\\d+)\\.', 1) as module, count(*) filter (ext in ('.R', '.py')) as code, count(*) filter (ext in ('.csv', '.tsv', '.txt', '.rds')) as data from {v_files} v group by 1, 2)
select project_id, module, 'no_data' as problem, 'WARNING' as severity from u where code > 0 and data = 0 union all select project_id, '', 'no_code', 'WARNING' from u group by 1 having sum(code) = 0""".replace("\\\\", "\\"))
def _(s):
    unit = s.v_files.withColumn("module", F.concat_ws("/", "module", F.regexp_extract("path", r"_(\d+)\.", 1)))
    return A.delivery_gaps(A.module_profile(unit))


@query("A22_required_components", """
with r(m, kind, component, severity, p) as (values ('nomo', 'nomo', 'nomogram', 'WARNING', 'nomo'), ('nomo', 'nomo', 'calibration', 'WARNING', 'calibration'), ('nomo', 'nomo', 'decision_curve', 'WARNING', 'dca'), ('nomo', 'nomo', 'roc', 'WARNING', 'roc'),
  ('machine', 'machine', 'train_metrics', 'WARNING', 'train.*metric|metric.*train|performance'), ('machine', 'machine', 'test_metrics', 'CRITICAL', 'test.*metric|metric.*test|performance'))
select project_id, module, kind, component, severity from {v_files} f join r on contains(lower(module), m) group by 1, 2, 3, 4, 5 having not bool_or(regexp_matches(lower(regexp_extract(path, '([^/]+)$', 1)), p))""")
def _(s):
    return A.required_components(s.v_files)


@query("A22_figures_without_values", """
select project_id, regexp_extract(path, '_(\\d+)\\.', 1) as module, 'WARNING' as severity from {v_files} f group by 1, 2 having bool_or(path like '%volcano%' and ext in ('.pdf', '.png')) and not bool_or(path like '%volcano%' and ext = '.csv')""".replace("\\\\", "\\"))
def _(s):
    return A.figures_without_values(s.v_files.withColumn("module", F.regexp_extract("path", r"_(\d+)\.", 1)), "volcano")


@query("A23_evidence_packages", """
with f as (select project_id, module || '#' || regexp_extract(path, '_(\\d+)\\.', 1) as module, lower(regexp_extract(path, '([^/]+)$', 1)) as name, module as m from {v_files} v),
r(m, kind, item, p, severity) as (values ('03_Docking', 'dock', 'score_table', '(score|affinity|energy|vina|dock).*\\.(csv|tsv|txt|xlsx|xls|log|pdbqt|sdf)$', 'CRITICAL'), ('03_Docking', 'dock', 'box_record', 'box|center|cavity|pocket|grid', 'CRITICAL'),
  ('04_MD', 'md', 'raw_series', '\\.(xvg|csv|dat|xtc|trr|edr|gro|log)$', 'CRITICAL'), ('05_Machine_shap', 'shap', 'value_table', '\\.(csv|tsv|txt|xlsx|xls)$', 'WARNING'))
select project_id, module, kind, item, r.severity, cast(count(*) filter (regexp_matches(name, '\\.(png|jpg|jpeg|tif|tiff|pdf)$')) as bigint) as figures from f join r on f.m = r.m group by 1, 2, 3, 4, 5
having not bool_or(regexp_matches(name, p)) and bool_or(regexp_matches(name, '\\.(png|jpg|jpeg|tif|tiff|pdf)$'))""".replace("\\\\", "\\"))
def _(s):
    return A.evidence_packages(s.v_files.withColumn("module", F.concat_ws("#", "module", F.regexp_extract("path", r"_(\d+)\.", 1))))


@query("A24_filtered_only", """
with f as (select project_id, module || '#' || regexp_extract(path, '_(\\d+)\\.', 1) as module, lower(regexp_extract(path, '([^/]+)$', 1)) as name from {v_files} v where module = '06_Immune' and ext in ('.csv', '.tsv', '.txt'))
select project_id, module, cast(count(*) as bigint) as tables, 'CRITICAL' as severity from f group by 1, 2 having bool_and(name like '%final%' or name like '%sel%' or name like '%filter%') and not bool_or(regexp_matches(name, 'raw|all|total|original|full|complete|summary'))""".replace("\\\\", "\\"))
def _(s):
    return A.filtered_only(s.v_files.withColumn("module", F.concat_ws("#", "module", F.regexp_extract("path", r"_(\d+)\.", 1))))


@query("A25_format_pairs", """
select project_id, substr(path, 1, length(path) - 4) as stem, 'WARNING' as severity from {v_files} f where ext in ('.png', '.pdf') group by 1, 2 having not bool_or(ext = '.pdf')""")
def _(s):
    return A.format_pairs(s.v_files)


@query("A35_project_type", """
select c_custkey as project_id, case c_mktsegment when 'HOUSEHOLD' then '癌症' when 'MACHINERY' then '心血管' when 'FURNITURE' then '神经' else 'unknown' end as project_type from customer""")
def _(s):
    n = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Lung TUMOR and brain").when(F.col("c_mktsegment") == "MACHINERY", "heart study").when(F.col("c_mktsegment") == "FURNITURE", "Neural x").otherwise(F.col("c_name"))
    return A.project_type(s.customer.select(F.col("c_custkey").alias(K), n.alias("name")))


@query("A35_project_type_by_text", """
with h as (select distinct project_id, case pr when '1' then 'Brain' when '2' then 'Heart' when '3' then 'neuron' end as w from {v_vars} v where pr in ('1', '2', '3')),
g as (select project_id, case w when 'Heart' then '心血管' else '神经' end as t, count(*) / 4.0 as share from h group by 1, 2)
select project_id, arg_min(t, (-share, t)) as project_type, cast(max(share) as double) as share from g group by 1""")
def _(s):
    t = F.when(F.col("pr") == "1", "the Brain").when(F.col("pr") == "2", "a Heart").when(F.col("pr") == "3", "one neuron").otherwise("x")
    return A.project_type_by_text(s.v_vars.select(K, "line", t.alias("text")))


@query("A35_disease_code", """
select c_custkey as project_id, case c_mktsegment when 'HOUSEHOLD' then 'NSCLC' when 'MACHINERY' then 'HCC' when 'FURNITURE' then 'COAD' end as expected from customer""")
def _(s):
    n = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "lung nsclc OV").when(F.col("c_mktsegment") == "MACHINERY", "肝细胞癌与肝癌").when(F.col("c_mktsegment") == "FURNITURE", "结直肠癌").otherwise("x")
    return A.disease_code(s.customer.select(F.col("c_custkey").alias(K), n.alias("name")))


@query("A36_layout", """
with d as (select o_custkey as project_id, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr from orders)
select project_id, case when bool_or(st = 'F' and pr = '1') then 'segmented' when bool_or(st = 'O' and pr = '2') then 'mixed' else 'flat' end as layout from d group by 1""")
def _(s):
    pr = F.substring("o_orderpriority", 1, 1)
    d = F.when((F.col("o_orderstatus") == "F") & (pr == "1"), "结果文件").when((F.col("o_orderstatus") == "O") & (pr == "2"), "附件").otherwise("misc")
    return A.layout(s.orders.select(F.col("o_custkey").alias(K), d.alias("dir")))


@query("A39_roots", """
with p as (select project_id, cast(count(*) filter (ext in ('.R', '.py')) as bigint) as code, module from {v_files} f group by 1, 3)
select project_id, case when count(*) >= 3 then '.' end as result_root, case when max(code) > 0 then arg_max(module, (code, module)) end as code_root from p group by 1""")
def _(s):
    return A.roots(s.v_files)


@query("A41_case_conflicts", """
with r as (select project_id, case disc % 2 when 0 then '/Data/part' else '/data/part' end || disc % 5 as p from {v_code_vars} v where kind = 'NO')
select project_id, lower(p) as folded, cast(count(distinct p) as bigint) as spellings, min(p) as one, max(p) as other from r group by 1, 2 having count(distinct p) > 1""")
def _(s):
    r = s.v_code_vars.where("kind = 'NO'").select(K, F.concat(F.when(F.col("disc") % 2 == 0, "/Data/part").otherwise("/data/part"), F.col("disc") % 5).alias("ref_path"))
    return A.case_conflicts(r)


@query("T05_largest_files", """
select project_id, path, size, ext, module from (select *, row_number() over (partition by project_id order by size desc, path) as r from {v_files} f where ext in ('.png', '.jpg', '.svg')) q where r <= 5""")
def _(s):
    return A.largest_files(s.v_files, 5)


@query("T06_shallowest_dir", """
select project_id, arg_min(d, (n, d)) as dir, cast(min(n) as bigint) as depth from (select l_suppkey as project_id, case l_returnflag when 'A' then 'a/b/docking_' || l_linenumber when 'N' then 'Dock_' || l_linenumber || '/dock' else 'x/y' end as d, case l_returnflag when 'A' then 3 else 2 end as n from lineitem) q where lower(regexp_extract(d, '([^/]+)$', 1)) like '%dock%' group by 1""")
def _(s):
    d = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("a/b/docking_"), "l_linenumber")).when(F.col("l_returnflag") == "N", F.concat(F.lit("Dock_"), "l_linenumber", F.lit("/dock"))).otherwise("x/y")
    return A.shallowest_dir(s.lineitem.select(F.col("l_suppkey").alias(K), d.alias("dir")), ["dock"]).withColumn("depth", F.col("depth").cast("long"))


VIEWS["v_assets"] = """
select o_custkey as project_id, concat('a', o_orderkey) as asset_id, case o_orderstatus when 'P' then 'files' else 'report' end as origin, concat('fig/', o_orderkey % 200, case when o_orderpriority < '3' then '.png' else '.ai' end) as relative_path,
  case when o_orderpriority < '3' then 'supported' else 'unsupported' end as format_status, concat('h', o_orderkey % 50) as source_sha256, cast(floor(o_totalprice / 100) as bigint) as size,
  case o_orderstatus when 'F' then 'roc' when 'O' then 'bar_chart' else 'cover_decoration' end as asset_type, o_orderstatus = 'F' as high_risk, o_orderpriority as pr from {orders}"""


@query("J22_derivatives", """
with c as (select project_id, origin, regexp_replace(relative_path, '\\.[^.]+$', '') as stem, arg_min(source_sha256, (asset_id, source_sha256)) as sha, min(asset_id) as id from {v_assets} a where format_status = 'supported' group by 1, 2, 3)
select a.project_id, a.asset_id, c.id as derivative_asset_id, a.source_sha256, c.sha as derivative_sha256 from {v_assets} a join c on c.project_id = a.project_id and c.origin = a.origin and c.stem = regexp_replace(a.relative_path, '\\.[^.]+$', '') where a.format_status <> 'supported'""".replace("\\\\", "\\"))
def _(s):
    return S.derivatives(s.v_assets)


RECORDED = """(select project_id, case pr when '1-URGENT' then asset_id || 'x' else asset_id end as asset_id, case pr when '2-HIGH' then 'old' else source_sha256 end as source_sha256,
  case pr when '3-MEDIUM' then 'unsupported' when '5-LOW' then 'skipped' else 'reviewed' end as outcome, case when asset_type = 'roc' then '' else 'ok' end as reason, pr <> '4-NOT SPECIFIED' as review_complete, high_risk as flagged, asset_type = 'roc' as derivative_ok from {v_assets} a)"""


def recorded(s):
    a, pr = s.v_assets, F.col("pr")
    return a.select(
        K, F.when(pr == "1-URGENT", F.concat("asset_id", F.lit("x"))).otherwise(F.col("asset_id")).alias("asset_id"), F.when(pr == "2-HIGH", "old").otherwise(F.col("source_sha256")).alias("source_sha256"),
        F.when(pr == "3-MEDIUM", "unsupported").when(pr == "5-LOW", "skipped").otherwise("reviewed").alias("outcome"), F.when(F.col("asset_type") == "roc", "").otherwise("ok").alias("reason"),
        (pr != "4-NOT SPECIFIED").alias("review_complete"), F.col("high_risk").alias("flagged"), (F.col("asset_type") == "roc").alias("derivative_ok"), F.lit(False).alias("alternative_ok"), F.lit(False).alias("waived"))


@query("J23_conservation", f"""
select coalesce(a.project_id, r.project_id) as project_id, coalesce(a.asset_id, r.asset_id) as asset_id, case when r.asset_id is null then 'missing' when a.asset_id is null then 'extra' when a.source_sha256 <> r.source_sha256 then 'stale' else 'conserved' end as status
from {{v_assets}} a full outer join {RECORDED} r on a.project_id = r.project_id and a.asset_id = r.asset_id""")
def _(s):
    return S.conservation(s.v_assets, recorded(s))


@query("V09_visual_closure", f"""
with i as (select coalesce(a.project_id, r.project_id) as project_id, coalesce(a.asset_id, r.asset_id) as subject, case when r.asset_id is null then 'inventory_missing' when a.asset_id is null then 'inventory_extra' when a.source_sha256 <> r.source_sha256 then 'inventory_stale' end as code
  from {{v_assets}} a full outer join {RECORDED} r on a.project_id = r.project_id and a.asset_id = r.asset_id),
j as (select a.project_id, a.asset_id as subject, format_status = 'supported' as sup, r.outcome as o, r.reason, r.review_complete as rc, a.high_risk as hr, r.flagged, r.derivative_ok as dk, a.asset_type as t from {{v_assets}} a join {RECORDED} r on a.project_id = r.project_id and a.asset_id = r.asset_id)
select project_id, subject, code, 'error' as kind from i where code is not null
union all select project_id, subject, 'review_evidence', 'error' from j where sup and o = 'reviewed' and not rc
union all select project_id, subject, 'skip_reason', 'error' from j where sup and o = 'skipped' and reason = ''
union all select project_id, subject, 'strict_skip', 'error' from j where sup and o = 'skipped' and t <> 'cover_decoration'
union all select project_id, subject, 'high_risk_skip', 'error' from j where sup and o = 'skipped' and (hr or flagged)
union all select project_id, subject, 'supported_outcome', 'error' from j where sup and o not in ('reviewed', 'skipped')
union all select project_id, subject, 'unsupported_outcome', 'error' from j where not sup and o <> 'unsupported'
union all select project_id, subject, 'unsupported_reason', 'error' from j where not sup and reason = ''
union all select project_id, subject, 'high_risk_derivative', 'error' from j where not sup and hr and not dk
union all select project_id, subject, 'strict_unsupported', 'error' from j where not sup and not hr and not dk""")
def _(s):
    from claimgrid.operators.contracts import visual_closure

    return visual_closure(s.v_assets, recorded(s))


@query("V09_visual_counts", f"""
select project_id, cast(count(*) as bigint) as asset_total, cast(count(*) filter (o = 'reviewed') as bigint) as reviewed, cast(count(*) filter (o = 'skipped') as bigint) as skipped, cast(count(*) filter (o = 'unsupported') as bigint) as unsupported,
  cast(count(*) filter (o is null) as bigint) as unaccounted, count(*) filter (o is null) = 0 as conserved
from (select a.project_id, r.outcome as o from {{v_assets}} a left join {RECORDED} r on a.project_id = r.project_id and a.asset_id = r.asset_id) q group by 1""")
def _(s):
    from claimgrid.operators.contracts import visual_counts

    return visual_counts(s.v_assets, recorded(s))


def flagged(s):
    f = F.array_compact(F.array(F.when(F.col("pr") == "1-URGENT", "duplicate_image"), F.when(F.col("size") > 3000, "project_id_mismatch")))
    return s.v_assets.withColumn("flags", f)


@query("A34_prefilter_summary", """
select project_id, cast(count(*) as bigint) as assets, cast(count(*) filter (pr = '1-URGENT' or size > 3000) as bigint) as flagged, cast(count(*) filter (pr = '1-URGENT') as bigint) as duplicate_image, cast(count(*) filter (size > 3000) as bigint) as project_id_mismatch from {v_assets} a group by 1""")
def _(s):
    return A.prefilter_summary(flagged(s), ["duplicate_image", "project_id_mismatch"])


@query("A34_review_worklist", """
select project_id, asset_id, case when asset_type = 'cover_decoration' then 'cover' when size < 2000 then 'very_small' when pr <> '1-URGENT' and size <= 3000 and asset_type <> 'roc' then 'low_risk' else '' end as skip_reason from {v_assets} a""")
def _(s):
    return A.review_worklist(flagged(s), "standard").select(K, "asset_id", "skip_reason")


@query("J21_nearest_caption", """
with l as (select project_id, line, pr, a, b from {v_vars} v), m as (select project_id, line from l where pr = '1'), c as (select project_id, line, 'Fig ' || a || '.' || b as figure_id from l where pr = '2'),
j as (select m.project_id, m.line, c.line as cl, c.figure_id, abs(c.line - m.line) as d from m join c on c.project_id = m.project_id and c.line between m.line - 2 and m.line + 3)
select project_id, line, 'image_1.png' as file, arg_min(figure_id, (d, cl)) as figure_id, arg_min(cl, (d, cl)) as caption_line from j group by 1, 2""")
def _(s):
    t = F.when(F.col("pr") == "1", "[IMAGE: image_1.png]").when(F.col("pr") == "2", F.concat(F.lit("x Fig "), "a", F.lit("."), "b", F.lit(" y"))).otherwise("z")
    lines = s.v_vars.select(K, "line", t.alias("text"))
    m = lines.where(F.col("text").rlike(V.IMAGE_MARKER)).select(K, "line", F.lit("image_1.png").alias("file"))
    return S.nearest_caption(m, S.captions(lines)).drop("caption")


@query("S10_degraded_summary", """
with p as (select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')), t as (select l_suppkey as k, 't' || l_linenumber as item, cast(count(*) as varchar) as value from lineitem group by 1, 2)
select k as project_id, 'table' as kind, item, value, 'INFO' as severity from t where k in (select c_custkey from p)
union all select project_id, 'logFC_threshold', path, cast(1 + tax % 5 as varchar), 'INFO' from {v_code_vars} v where v.kind = 'AO' and project_id in (select c_custkey from p)
union all select project_id, 'p_value_threshold', path, '0.0' || (1 + disc % 9), 'INFO' from {v_code_vars} v where v.kind = 'AO' and project_id in (select c_custkey from p)""")
def _(s):
    lines = s.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias(K))
    meta = s.lineitem.groupBy(F.col("l_suppkey").alias(K), F.concat(F.lit("t"), "l_linenumber").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    return A.degraded_summary(s.v_projects, lines, meta, X.parameters(s.v_code_lines))
