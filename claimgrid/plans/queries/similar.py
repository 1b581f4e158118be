"""Duplicates, nested models, revisions, links and bindings."""

from pyspark.sql import functions as F

from claimgrid.functions import text as T
from claimgrid.functions.numbers import gradient_hash, hamming
from claimgrid.operators import compare as C, extract as X, similarity as S
from claimgrid.plans.queries.base import VIEWS, query
from claimgrid.plans.queries.text import LINT, doc_lines

K = "project_id"

HASH = "(select vec_id, label, list_sum([case when embedding[i] < embedding[i + 1] then (1::bigint << (i - 1)::int) else 0 end for i in range(1, 64)])::bigint as fp from embeddings)"


@query("F11_gradient_hash", f"select vec_id, fp as fingerprint from {HASH} h")
def _(s):
    return s.embeddings.select("vec_id", gradient_hash("embedding").alias("fingerprint"))


@query("F11_hamming_neighbours", f"""
select a.vec_id, cast(bit_count(xor(a.fp, b.fp)) as bigint) as distance from {HASH} a join {HASH} b on b.vec_id = a.vec_id + 1""")
def _(s):
    e = s.embeddings.select("vec_id", gradient_hash("embedding").alias("fp"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fp").alias("other"))
    return e.join(n, "vec_id").select("vec_id", hamming("fp", "other").cast("long").alias("distance"))


# Fingerprints of 62 bits: one pattern per customer by two multiplicative steps, a bit or two off per order, so that
# copies and near copies occur among the orders of a customer.
VIEWS["v_fingerprints"] = """
select o_custkey % 11 as project_id, concat('a', lpad(cast(o_orderkey as varchar(12)), 12, '0')) as asset,
  ((o_custkey + 7) * 48271 % 2147483647) * 1073741824 + ((o_custkey + 7) * 48271 % 2147483647 * 40692 % 1073741789) + cast(power(2, o_orderkey % 5 * 9) as bigint) as fp from {orders}"""


@query("J19_near_duplicates", """
with d as (select project_id, fp, min(asset) as asset, cast(count(*) as bigint) as copies from {v_fingerprints} f group by 1, 2)
select a.project_id, a.asset as asset_a, b.asset as asset_b, a.copies as copies_a, b.copies as copies_b, cast(bit_count(xor(a.fp, b.fp)) as bigint) as distance, 'WARNING' as severity from d a join d b on a.project_id = b.project_id and a.asset < b.asset and bit_count(xor(a.fp, b.fp)) <= 5""")
def _(s):
    d = S.near_duplicates(s.v_fingerprints.withColumnRenamed("fp", "fingerprint"))
    return d.withColumn("distance", F.col("distance").cast("long"))


@query("J19_near_duplicate_vectors", f"""
with d as (select label as project_id, fp, min(vec_id) as asset, cast(count(*) as bigint) as copies from {HASH} h group by 1, 2)
select a.project_id, a.asset as asset_a, b.asset as asset_b, a.copies as copies_a, b.copies as copies_b, cast(bit_count(xor(a.fp, b.fp)) as bigint) as distance from d a join d b on a.project_id = b.project_id and a.asset < b.asset and bit_count(xor(a.fp, b.fp)) <= 5""")
def _(s):
    e = s.embeddings.select(F.col("label").alias(K), F.col("vec_id").alias("asset"), gradient_hash("embedding").alias("fingerprint"))
    return S.near_duplicates(e).drop("severity").withColumn("distance", F.col("distance").cast("long"))


@query("J19_same_fingerprint", "select project_id, fp as fingerprint, min(asset) as first_asset, cast(count(*) as bigint) as copies, 'CRITICAL' as severity from {v_fingerprints} f group by 1, 2 having count(*) > 1")
def _(s):
    return S.same_fingerprint(s.v_fingerprints.withColumnRenamed("fp", "fingerprint"))


@query("J20_exact_duplicates", """
with g as (select source, sha256(text) as h, min(doc_id) as f, count(*) as n from documents group by 1, 2 having count(*) > 1)
select d.source as project_id, d.doc_id as duplicate, g.f as first_holder, cast(n as bigint) as copies, 'CRITICAL' as severity from documents d join g on g.source = d.source and g.h = sha256(d.text) where d.doc_id > g.f""")
def _(s):
    d = s.documents.select(F.col("source").alias(K), "doc_id", F.sha2("text", 256).alias("hash"))
    return S.exact_duplicates(d, name="doc_id")


MODELS = """(select project_id, path, line, 'fit' || q as model, case when disc < 3 then ['age', 'bmi'] when disc < 6 then ['age', 'bmi', 'sex'] when disc < 9 then ['age', 'grade', 'stage'] else ['age'] end as ps from {v_code_vars} v where kind = 'NF')"""
SETS = f"(select project_id, path, ps, min((line, model)) as m, len(ps) as sz from {MODELS} x group by 1, 2, 3)"


@query("J18_nested_models", f"""
select a.project_id, a.path, a.m[2] as model_small, a.m[1] as line_small, b.m[2] as model_large, b.m[1] as line_large, array_to_string(list_sort(list_filter(b.ps, lambda p: not list_contains(a.ps, p))), ',') as missing, 'CRITICAL' as severity
from {SETS} a join {SETS} b on a.project_id = b.project_id and a.path = b.path and b.sz > a.sz and list_has_all(b.ps, a.ps)""")
def _(s):
    return S.nested_models(X.models(s.v_code_lines))


@query("J18_differing_models", f"""
with s as (select * from {SETS} x where sz >= 3), n as (select project_id, path, count(*) as n from s group by 1, 2)
select s.project_id, s.path, s.m[2] as model, s.m[1] as line, cast(sz as bigint) as size, cast(n - 1 as bigint) as differs_from, 'WARNING' as severity from s join n on n.project_id = s.project_id and n.path = s.path where n > 1""")
def _(s):
    return S.differing_models(X.models(s.v_code_lines)).withColumn("size", F.col("size").cast("long"))


@query("J36_history_hints", r"""
with w as (select doc_id, lang, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '[\t\n\x0b\x0c\r \x{85}\p{Zs}\x{2028}\x{2029}]+', ' ', 'g'))), ' '), lambda x: length(x) > 0)) as t from documents), b as (select item_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '[\t\n\x0b\x0c\r \x{85}\p{Zs}\x{2028}\x{2029}]+', ' ', 'g'))), ' '), lambda x: length(x) > 0)) as t from benchmark),
u as (select doc_id, unnest(t) as w from w), ub as (select item_id, unnest(t) as w from b),
p as (select distinct ub.item_id as a, u.doc_id as b from ub join u on u.w = ub.w),
sc as (select a as finding_id, p.b as past_id, round(len(list_intersect(x.t, y.t)) / cast(len(list_distinct(list_concat(x.t, y.t))) as double), 6) as score from p join b x on x.item_id = a join w y on y.doc_id = p.b)
select finding_id, past_id, score from (select *, row_number() over (partition by finding_id order by score desc, past_id) as rn from sc where score >= 0.1) q where rn <= 3""")
def _(s):
    past = s.documents.select(F.col("doc_id").alias("finding_id"), F.lit("text").alias("category"), F.col("text").alias("description"))
    now = s.benchmark.select(F.col("item_id").alias("finding_id"), F.lit("text").alias("category"), F.col("text").alias("description"))
    return S.history_hints(now, past)


# --- revisions ------------------------------------------------------------------------------------


@query("U01_union_findings", """
select check_id, severity, cast(count(*) as bigint) as n from {v_findings} f group by 1, 2 union all select 'order', 'INFO', cast(count(*) as bigint) from orders""")
def _(s):
    o = s.orders.select(F.lit("order").alias("check_id"), F.lit("INFO").alias("severity"), F.col("o_custkey").alias(K))
    return C.union_findings([s.v_findings, o]).groupBy("check_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("U02_snapshot_diff", """
with o as (select doc_id, sha256(text) as h from documents where lang <> 'de'), n as (select doc_id, sha256(case when source = (select min(source) from documents) then text || 'x' else text end) as h from documents where lang <> 'fr')
select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.h is null then 'added' when n.h is null then 'removed' when o.h <> n.h then 'changed' else 'unchanged' end as status from o full outer join n on o.doc_id = n.doc_id""")
def _(s):
    d = s.documents
    first = d.groupBy().agg(F.min("source").alias("_s"))
    old = d.where("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.where("lang <> 'fr'").join(F.broadcast(first)).select("doc_id", F.sha2(F.when(F.col("source") == F.col("_s"), F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return C.snapshot_diff(old, new, ["doc_id"], "h")


@query("U03_item_diff", """
with o as (select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'F'), n as (select distinct l_suppkey, l_partkey from lineitem where l_linestatus = 'O')
select *, 'added' as change from (select * from n except select * from o) a union all select *, 'removed' from (select * from o except select * from n) b""")
def _(s):
    return C.item_diff(s.lineitem.where("l_linestatus = 'F'"), s.lineitem.where("l_linestatus = 'O'"), ["l_suppkey", "l_partkey"])


@query("U04_intersection", """
with a as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A'), b as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R')
select l_suppkey, cast(count(*) as bigint) as shared from (select * from a intersect select * from b) q group by 1""")
def _(s):
    li = s.lineitem
    return C.intersection_size(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_suppkey"], "l_partkey")


@query("U07_intersection_vs_claim", """
with a as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A'), b as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'N'), n as (select l_suppkey, count(*) as c from (select * from a intersect select * from b) q group by 1)
select s_suppkey as l_suppkey, cast(floor(s_acctbal / 100) as bigint) as claimed, cast(coalesce(c, 0) as bigint) as shared, coalesce(c, 0) = floor(s_acctbal / 100) as agrees from supplier left join n on l_suppkey = s_suppkey""")
def _(s):
    li = s.lineitem
    claims = s.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.floor(F.col("s_acctbal") / 100).alias("claimed"))
    return C.intersection_vs_claim(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), ["l_suppkey"], "l_partkey", claims)


@query("U05_coverage", """
select doc_id, 'missing' as problem from documents where doc_id not in (select doc_id from labels) union all select distinct doc_id, 'unexpected' from labels where doc_id not in (select doc_id from documents)""")
def _(s):
    return C.coverage(s.documents, s.labels, ["doc_id"])


@query("U06_merge_members", "select distinct 'type' as kind, p_type as member from part union select distinct 'brand', p_brand from part")
def _(s):
    p = s.part
    return C.merge_members([p.select(F.lit("type").alias("kind"), F.col("p_type").alias("member")), p.select(F.lit("brand").alias("kind"), F.col("p_brand").alias("member"))], ["kind", "member"])


# --- integrity and links --------------------------------------------------------------------------


@query("J27_orphans", "select l_orderkey, l_partkey, cast(count(*) as bigint) as n from lineitem where l_partkey not in (select p_partkey from part where p_size > 3) group by 1, 2")
def _(s):
    o = C.orphans(s.lineitem.withColumnRenamed("l_partkey", "p_partkey"), s.part.where("p_size > 3"), ["p_partkey"])
    return o.groupBy("l_orderkey", F.col("p_partkey").alias("l_partkey")).agg(F.count(F.lit(1)).alias("n"))


@query("J29_broken_links", """
with l as (select project_id, line, unnest(['#part-' || (line - project_id % 3), '01_DEGs/score_final_' || (1 + project_id % 50) || '.csv:12']) as target from {v_md_lines} v where pr = '3'),
h as (select project_id, 'part-' || line as slug from {v_md_lines} v where pr = '1')
select l.project_id, line, target, 'anchor' as problem, 'warning' as severity from l where target like '#%' and not exists (select 1 from h where h.project_id = l.project_id and '#' || h.slug = target)
union all select l.project_id, line, target, 'path', 'error' from l where target not like '#%' and not exists (select 1 from {v_files} f where f.project_id = l.project_id and f.path || ':12' = target)""")
def _(s):
    return C.broken_links(X.links(s.v_md_lines), X.headings(s.v_md_lines), s.v_files)


VIEWS["v_canonical"] = """
select o_custkey as project_id, concat('C-', lpad(cast(o_orderkey as varchar(9)), 9, '0')) as canonical_id, o_orderkey as ok, case o_orderpriority when '1-URGENT' then 'FATAL' when '2-HIGH' then 'CRITICAL' when '3-MEDIUM' then 'MAJOR' when '5-LOW' then 'LOW' else 'INFO' end as severity,
  concat('mech ', o_orderstatus) as error_mechanism, concat('fix ', substr(o_orderpriority, 1, 1)) as repair_path, concat('m', o_orderkey % 3) as module, concat('claim ', o_orderkey % 4) as claim, case when o_orderkey % 10 = 0 then '' else 'obj' end as evidence_object, o_orderstatus as st from {orders}"""


@query("J26_duplicate_candidates", """
with k as (select project_id, canonical_id, 'same_root_and_repair' as reason, error_mechanism || '|' || repair_path as k from {v_canonical} c union all select project_id, canonical_id, 'shared_evidence', 'L' || (ok % 5) from {v_canonical} c),
g as (select project_id, reason, k, min(canonical_id) as m, count(*) as n from k group by 1, 2, 3 having count(*) > 1)
select k.project_id, m as left_id, canonical_id as right_id, k.reason, cast(n as bigint) as group_size from k join g on g.project_id = k.project_id and g.reason = k.reason and g.k = k.k where canonical_id <> m""")
def _(s):
    c = s.v_canonical.withColumn("refs", F.array(F.struct(F.lit("A\\Report_Text.txt").alias("path"), F.concat(F.lit(" l"), F.col("ok") % 5).alias("locator"))))
    return C.duplicate_candidates(c)


@query("J28_match_rows_issues", """
with r as (select o_custkey as project_id, 'r' || o_orderkey as row_id, case when o_orderstatus = 'F' then 'i' || (o_orderkey - o_orderkey % 2) else '' end as issue_id, 'ref' || (o_orderkey % 7) as ref, case when o_orderstatus = 'P' then 'topic ' || (o_orderkey % 9) || ' detail' else 'none' || o_orderkey end as title, o_orderstatus as st from orders where o_orderpriority < '3'),
i as (select o_custkey as project_id, 'i' || o_orderkey as issue_id, 'ref' || (o_orderkey % 7) as ref, 'Topic ' || (o_orderkey % 9) as title from orders where o_orderpriority > '3'),
a as (select r.project_id, row_id, i.issue_id from r join i on i.project_id = r.project_id and i.issue_id = r.issue_id),
m as (select * from a union select r.project_id, row_id, i.issue_id from r join i on i.project_id = r.project_id and (i.ref = r.ref or contains(r.title, lower(i.title))) where not exists (select 1 from a where a.project_id = r.project_id and a.row_id = r.row_id))
select 'match' as part, project_id, row_id as x, issue_id as y from m union all select 'row', project_id, row_id, null from r where not exists (select 1 from m where m.project_id = r.project_id and m.row_id = r.row_id)
union all select 'issue', project_id, issue_id, null from i where not exists (select 1 from m where m.project_id = i.project_id and m.issue_id = i.issue_id)""")
def _(s):
    o, k, st = s.orders, F.col("o_orderkey"), F.col("o_orderstatus")
    r = o.where("o_orderpriority < '3'").select(
        F.col("o_custkey").alias(K), F.concat(F.lit("r"), k).alias("row_id"), F.when(st == "F", F.concat(F.lit("i"), k - k % 2)).otherwise("").alias("issue_id"), F.array(F.concat(F.lit("ref"), k % 7)).alias("refs"),
        F.when(st == "P", F.concat(F.lit("topic "), k % 9, F.lit(" detail"))).otherwise(F.concat(F.lit("none"), k)).alias("title"))
    i = o.where("o_orderpriority > '3'").select(F.col("o_custkey").alias(K), F.concat(F.lit("i"), k).alias("issue_id"), F.array(F.concat(F.lit("ref"), k % 7)).alias("refs"), F.concat(F.lit("Topic "), k % 9).alias("title"))
    m, a, b = C.match_rows_issues(r, i)
    none = F.lit(None).cast("string").alias("y")
    return m.select(F.lit("match").alias("part"), K, F.col("row_id").alias("x"), F.col("issue_id").alias("y")).unionByName(a.select(F.lit("row").alias("part"), K, F.col("row_id").alias("x"), none)).unionByName(
        b.select(F.lit("issue").alias("part"), K, F.col("issue_id").alias("x"), none))


@query("J35_suggested_actions", """
with c as (select case l_linenumber when 1 then 'markdown:placeholder:' when 2 then 'terminology:' when 3 then 'section:' when 4 then 'markdown:h1_count:' else 'other:' end || l_partkey as check_id, l_returnflag as severity, l_linestatus as message, l_linenumber as n from lineitem)
select check_id, min((severity, message))[1] as severity, min((severity, message))[2] as message, case min(n) when 1 then 'remove_placeholder' when 2 then 'use_standard_term' when 3 then 'add_required_section' when 4 then 'keep_one_h1' else 'complete_content' end as action, min(n) <= 2 as autofix_safe from c group by 1""")
def _(s):
    pre = F.when(F.col("l_linenumber") == 1, "markdown:placeholder:").when(F.col("l_linenumber") == 2, "terminology:").when(F.col("l_linenumber") == 3, "section:").when(F.col("l_linenumber") == 4, "markdown:h1_count:").otherwise("other:")
    return C.suggest(s.lineitem.select(F.concat(pre, "l_partkey").alias("check_id"), F.col("l_returnflag").alias("severity"), F.col("l_linestatus").alias("message")))


@query("F24_autofix_rows", r"""
select project_id, line, 'terminology:forbidden:' as check_id, md5(text) as original, md5(replace(text, ' of ', ' from ')) as replacement
from (select doc_id as project_id, unnest(generate_series(1, len(ls))) as line, unnest(ls) as text from (select doc_id, string_split_regex(text, '\r\n|\r|\n') as ls from documents) q) d where contains(text, ' of ')""")
def _(s):
    from claimgrid.operators.predicates import lint_terms

    lines = doc_lines(s)
    f = lint_terms(lines, [x for x in LINT if x[0] == "terminology"]).select(K, "line", F.lit("terminology:forbidden:").alias("check_id"), "term")
    d = C.autofix_rows(lines, f, {" of ": " from "})
    return d.select(K, "line", "check_id", F.md5("original").alias("original"), F.md5("replacement").alias("replacement"))


@query("J31_report_binding", """
with o as (select o_custkey as project_id, o_orderkey as k, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr from orders),
dup as (select 'report_id_repeated' as e), src as (select * from o)
select project_id, 'source_not_retained' as error, 'raw' || k as subject from o where st = 'P'
union all select project_id, 'canonical_without_crosswalk', 'C' || k from o where st <> 'P' and pr = '1'
union all select project_id, 'field_not_concrete', 'key' || k || '/evidence' from o where st <> 'P' and pr = '2'
union all select project_id, 'locator_not_target', 'key' || k from o where st <> 'P' and pr = '3'
union all select project_id, 'report_row_missing', 'F-' || k from o where st = 'O' and pr = '4'
union all select project_id, 'severity_differs', 'F-' || k from o where st <> 'P' and pr = '5'
union all select project_id, 'report_row_unbound', 'F-' || k from o where (st = 'P' or pr = '1') and not (st = 'O' and pr = '4')
union all select project_id, 'rejected_key_in_report', 'key' || k from o where st = 'P' and pr <> '1'""")
def _(s):
    o = s.orders.select(F.col("o_custkey").alias(K), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("pr"))
    cat = lambda p: F.concat(F.lit(p), "k")
    rep = o.where("not (st = 'O' and pr = '4')").select(K, cat("F-").alias("report_id"), F.when(F.col("pr") == "5", "INFO").otherwise("MAJOR").alias("severity"), F.lit("d").alias("description"), F.lit("l").alias("location"), F.lit("e").alias("evidence"), F.lit("r").alias("repair"))
    cw = o.where("pr <> '1'").select(K, cat("key").alias("key"), cat("F-").alias("report_id"), F.when(F.col("pr") == "3", "F-0x").otherwise(cat("f-")).alias("locator"), F.lit("p").alias("problem"), F.lit("l").alias("location"),
                                     F.when(F.col("pr") == "2", "见 F-12 详情").otherwise("e").alias("evidence"), F.lit("r").alias("repair"))
    can = o.select(K, cat("C").alias("canonical_id"), F.lit("MAJOR").alias("severity"))
    src = o.select(K, cat("C").alias("canonical_id"), cat("raw").alias("raw_finding_id"))
    disp = o.select(K, cat("raw").alias("raw_finding_id"), cat("key").alias("finding_key"), F.when(F.col("st") == "P", "reject").otherwise("accept").alias("decision"))
    return C.report_binding(rep, cw, can, src, disp)


@query("J31_report_counts", """
with r as (select l_suppkey as project_id, case when l_discount < 0.05 then 'MAJOR' else 'INFO' end as severity, count(distinct l_partkey) as n from (select l_suppkey, l_partkey, min(l_discount) as l_discount from lineitem group by 1, 2) q group by 1, 2), d as (select s_suppkey as project_id, 'MAJOR' as severity, cast(floor(s_acctbal / 90) as bigint) as n from supplier)
select coalesce(r.project_id, d.project_id) as project_id, coalesce(r.severity, d.severity) as severity, cast(coalesce(r.n, 0) as bigint) as in_report, cast(coalesce(d.n, 0) as bigint) as in_decision from r full outer join d on d.project_id = r.project_id and d.severity = r.severity where coalesce(r.n, 0) <> coalesce(d.n, 0)""")
def _(s):
    q = s.lineitem.groupBy(F.col("l_suppkey").alias(K), F.col("l_partkey").alias("report_id")).agg(F.min("l_discount").alias("x"))
    rep = q.select(K, "report_id", F.when(F.col("x") < 0.05, "major").otherwise("info").alias("severity"))
    dec = s.supplier.select(F.col("s_suppkey").alias(K), F.lit("MAJOR").alias("severity"), F.floor(F.col("s_acctbal") / 90).alias("in_decision"))
    return C.report_counts_match(rep, dec)
