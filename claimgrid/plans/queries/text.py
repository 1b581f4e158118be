"""Extraction and row predicates."""

from pyspark.sql import functions as F

from claimgrid.functions import text as T
from claimgrid.functions.keys import finding_key, map_hash, raw_finding_id, severity_rank
from claimgrid.functions.numbers import bonferroni, correlation_band, first_number, gradient_hash, level_score, number, p_significant, percent_in_parens, range_size, range_total, ref_ranges, statistic_reading
from claimgrid.operators import extract as X, ordered_checks as W, predicates as P, reconcile as J
from claimgrid.plans.queries.base import VIEWS, query
from claimgrid.rules import values as V
from claimgrid.sources.files import to_lines

K = "project_id"


def doc_lines(s):
    return to_lines(s.documents.withColumnRenamed("doc_id", K), [K])


DOC_LINES = r"(select doc_id as project_id, unnest(generate_series(1, len(ls))) as line, unnest(ls) as text from (select doc_id, string_split_regex(text, '\r\n|\r|\n') as ls from documents) q)"


@query("S02_text_lines", f"select project_id, line, cast(length(text) as bigint) as n_chars, md5(text) as digest from {DOC_LINES} d")
def _(s):
    return doc_lines(s).select(K, "line", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("X20_sentences", r"""
select doc_id, cast(count(*) as bigint) as sentences, cast(sum(length(p)) as bigint) as letters, max(md5(p)) as digest
from (select doc_id, trim(unnest(string_split_regex(text, '[。；;!！?？\n]+'))) as p from documents) q where length(p) > 0 group by doc_id""")
def _(s):
    d = X.sentences(s.documents.select("doc_id", "text"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("letters"), F.max(F.md5("sentence")).alias("digest"))


@query("F01_normalised_text", r"""
select doc_id, md5(trim(regexp_replace(text, '[\t\n\x0b\x0c\r \x{85}\p{Zs}\x{2028}\x{2029}]+', ' ', 'g'))) as digest from documents""")
def _(s):
    return s.documents.select("doc_id", F.md5(T.norm_text("text")).alias("digest"))


@query("F02_finding_key", """
select l_orderkey, l_linenumber, l_partkey, 'fk:' || substr(sha1(concat_ws('||', l_returnflag, l_linestatus, 'table', 'dir/f' || l_partkey, cast(l_linenumber as varchar), cast(l_suppkey as varchar))), 1, 16) as finding_key from lineitem""")
def _(s):
    d = s.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("dimension"), F.concat(F.lit(" "), "l_linestatus").alias("rule"),
                          F.lit("table").alias("source_type"), F.concat(F.lit("DIR\\F"), "l_partkey").alias("source_path"), F.col("l_linenumber").alias("locator"), F.col("l_suppkey").alias("quote_or_value"))
    for c in ("severity", "location", "description", "evidence"):
        d = d.withColumn(c, F.lit(None).cast("string"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", finding_key().alias("finding_key"))


@query("F03_raw_finding_id", """
select o_orderkey, 'rf:' || substr(sha256(o_orderstatus || chr(31) || o_orderkey || chr(31) || 'code' || chr(31) || '' || chr(31) || o_custkey || chr(31) || o_orderpriority), 1, 20) as raw_finding_id from orders""")
def _(s):
    d = s.orders.select("o_orderkey", F.col("o_orderstatus").alias("agent"), F.col("o_orderkey").alias("id"), F.lit("code").alias("source_type"),
                        F.lit(None).cast("string").alias("source_path"), F.col("o_custkey").alias("locator"), F.col("o_orderpriority").alias("quote_or_value"))
    return d.select("o_orderkey", raw_finding_id().alias("raw_finding_id"))


@query("F04_numbers_in_text", """
select o_orderkey, cast(o_custkey as double) / 100 as lenient, cast(o_custkey as double) as first_num, cast(round(o_totalprice / 10000, 1) as double) as pct,
  case when o_orderstatus = 'F' then true when o_orderstatus = 'O' then (o_custkey % 100) / 100.0 < 0.05 else false end as significant,
  case o_orderstatus when 'F' then 0.0 when 'O' then 1.0 else cast(o_custkey as double) end as score from orders""")
def _(s):
    o = s.orders.select("o_orderkey", "o_orderstatus", F.concat(F.lit(" "), (F.col("o_custkey") / 100).cast("string"), F.lit(" ")).alias("num"),
                        F.concat("o_custkey", F.lit("±10 ("), F.round(F.col("o_totalprice") / 10000, 1).cast("string"), F.lit("%)")).alias("cell"),
                        F.when(F.col("o_orderstatus") == "F", "<0.001").when(F.col("o_orderstatus") == "O", ((F.col("o_custkey") % 100) / 100).cast("string")).otherwise("NA").alias("p"),
                        F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "O", "yes").otherwise(F.concat(F.lit(">="), "o_custkey")).alias("level"))
    return o.select("o_orderkey", number("num").alias("lenient"), first_number("cell").alias("first_num"), percent_in_parens("cell").alias("pct"),
                    p_significant("p").alias("significant"), level_score("level").alias("score"))


@query("F07_reference_ranges", """
select o_orderkey, cast(o_custkey % 7 + 2 as bigint) as refs, cast((o_custkey % 7 + 1) * (o_custkey % 7 + 2) / 2 + 40 as bigint) as total from orders""")
def _(s):
    refs = ref_ranges(F.concat(F.lit("1-"), F.col("o_custkey") % 7 + 1, F.lit(" , 40，x")))
    return s.orders.select("o_orderkey", range_size(refs).cast("long").alias("refs"), range_total(refs).cast("long").alias("total"))


@query("F08_dotted_ids", """
select project_id, line, case when x = y then 'equal' when starts_with(x, y || '.') or starts_with(y, x || '.') then 'prefix'
  when len(string_split(x, '.')) = len(string_split(y, '.')) and len(string_split(x, '.')) > 1 and regexp_replace(x, '\\.?[^.]*$', '') = regexp_replace(y, '\\.?[^.]*$', '') then 'sibling' else 'other' end as relation
from (select project_id, line, a || '.' || b as x, case when st = 'F' then a || '.' || b || '.' || c when st = 'O' then a || '.' || c else cast(b as varchar) end as y from {v_vars} v) q""".replace("\\\\", "\\"))
def _(s):
    d = s.v_vars.select(K, "line", F.concat_ws(".", F.col("a").cast("string"), F.col("b").cast("string")).alias("x"),
                        F.when(F.col("st") == "F", F.concat_ws(".", F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string")))
                        .when(F.col("st") == "O", F.concat_ws(".", F.col("a").cast("string"), F.col("c").cast("string"))).otherwise(F.col("b").cast("string")).alias("y"))
    return d.select(K, "line", T.id_relation("x", "y").alias("relation"))


@query("F09_token_jaccard", r"""
with w as (select item_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '[\t\n\x0b\x0c\r \x{85}\p{Zs}\x{2028}\x{2029}]+', ' ', 'g'))), ' '), lambda x: length(x) > 0)) as t from benchmark)
select a.item_id as item_a, b.item_id as item_b, round(len(list_intersect(a.t, b.t)) / cast(len(list_distinct(list_concat(a.t, b.t))) as double), 6) as score
from w a join w b on b.item_id = a.item_id + 1""")
def _(s):
    a = s.benchmark.select(F.col("item_id").alias("item_a"), F.col("text").alias("ta"))
    b = s.benchmark.select((F.col("item_id") - 1).alias("item_a"), F.col("item_id").alias("item_b"), F.col("text").alias("tb"))
    return a.join(b, "item_a").select("item_a", "item_b", F.round(T.token_jaccard("ta", "tb"), 6).alias("score"))


@query("F10_heading_slug", r"""
select page_id, trim(regexp_replace(regexp_replace(lower(trim(url)), '[^\p{L}\p{N}\p{M}_\s\-]', '', 'g'), '\s+', '-', 'g'), '-') as slug from pages""")
def _(s):
    return s.pages.select("page_id", T.heading_slug("url").alias("slug"))


@query("F12_path_parts", r"""
select project_id, path, regexp_extract(path, '([^/]+)$', 1) as name, lower(ext) as suffix, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]+$', '') as stem,
  regexp_replace(module, '^\d+[_\-]', '') as label, cast(2 as bigint) as depth from {v_files} f""")
def _(s):
    return s.v_files.select(K, "path", T.path_name("path").alias("name"), T.path_suffix("path").alias("suffix"), T.path_stem("path").alias("stem"),
                            T.module_label("module").alias("label"), T.path_depth("path").cast("long").alias("depth"))


@query("F16_severity_rank", """
select project_id, severity, cast(case severity when 'FATAL' then 5 when 'CRITICAL' then 4 when 'MAJOR' then 3 when 'WARNING' then 2 else 1 end as bigint) as rank, cast(count(*) as bigint) as n
from {v_findings} f group by all""")
def _(s):
    return s.v_findings.groupBy(K, "severity", severity_rank("severity").cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("F18_symbol_class", """
select p_partkey, case substr(p_brand, 7) when '1' then 'protein_complex' when '2' then 'mitochondrial' when '3' then 'hla' when '4' then 'immunoglobulin' when '5' then 'lncrna'
  when '6' then 'lowercase' when '7' then 'has_symbols' when '8' then 'has_space' else 'standard' end as cls from part""")
def _(s):
    b, k = F.substring("p_brand", 7, 9), F.col("p_partkey").cast("string")
    sym = F.when(b == "1", F.concat(F.lit("CD3-Z_"), k)).when(b == "2", F.concat(F.lit("MT-ND"), k)).when(b == "3", F.concat(F.lit("HLA-A"), k)).when(b == "4", F.concat(F.lit("IGHV"), k))
    sym = sym.when(b == "5", F.concat(F.lit("LINC"), k)).when(b == "6", F.concat(F.lit("tp"), k)).when(b == "7", F.concat(F.lit("AB-C"), k)).when(b == "8", F.concat(F.lit("AB "), k))
    return s.part.select("p_partkey", T.symbol_class(sym.otherwise(F.concat(F.lit("LINCARE"), k))).alias("cls"))


@query("F19_species_marker", """
select project_id, path, case when tax < 3 then 'mouse' when tax < 6 then 'human' else 'unknown' end as species, cast(count(*) as bigint) as n
from (select project_id, path, 'sets/' || case when tax < 3 then 'mouse' when tax < 6 then 'human' else 'custom' end || '_v' || ln || '.gmt' as f, min(tax) as tax from {v_code_vars} v
  where kind = 'RO' group by 1, 2, 3) q group by all""")
def _(s):
    return X.resource_files(s.v_code_lines).groupBy(K, "path", "species").agg(F.count(F.lit(1)).alias("n"))


@query("F20_asset_type", """
select project_id, path, case when module like '%DEGs' and path like '%volcano%' then 'volcano' when path like '%volcano%' then 'volcano'
  when module = '03_Docking' then 'forest_or_docking' else 'other' end as kind from {v_files} f where path like '%volcano%'""")
def _(s):
    d = s.v_files.where(F.col("path").contains("volcano"))
    return d.select(K, "path", T.asset_type("path").alias("kind"))


@query("F23_statistic_rules", """
select o_orderkey, case o_orderstatus when 'F' then case when o_custkey % 100 / 100.0 < 0.05 then 'pass' else 'fail' end when 'O' then case when o_custkey % 100 / 100.0 > 0.05 then 'pass' else 'fail' end else 'unknown' end as reading,
  case when o_custkey % 100 / 100.0 > 0.8 then 'strong' when o_custkey % 100 / 100.0 > 0.5 then 'moderate' when o_custkey % 100 / 100.0 > 0.3 then 'weak' else 'negligible' end as band,
  round(least(o_custkey % 100 / 100.0 * 20, 1.0), 6)::double as adjusted from orders""")
def _(s):
    v = (F.col("o_custkey") % 100) / 100
    d = s.orders.select("o_orderkey", v.alias("v"), F.when(F.col("o_orderstatus") == "F", "DEG").when(F.col("o_orderstatus") == "O", "HEIDI").otherwise("none").alias("t"))
    return d.select("o_orderkey", statistic_reading("t", "v").alias("reading"), correlation_band("v").alias("band"), F.round(bonferroni("v", F.lit(20)), 6).alias("adjusted"))


@query("F24_term_replacement", """
select doc_id, md5(replace(replace(text, 'the', 'THE'), ' of ', ' from ')) as digest from documents""")
def _(s):
    return s.documents.select("doc_id", F.md5(T.replace_terms("text", {"the": "THE", " of ": " from "})).alias("digest"))


@query("F25_first_filled", "select o_orderkey, case when o_orderstatus = 'F' then o_orderstatus else o_orderpriority end as owner from orders")
def _(s):
    o = s.orders
    return o.select("o_orderkey", T.first_filled(F.lit("  "), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")), "o_orderpriority").alias("owner"))


@query("S08_content_hash", "select doc_id, sha256(text) as digest from documents")
def _(s):
    return s.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("S08_json_hash", """
select p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","type":"' || p_type || '"}') as digest from part""")
def _(s):
    m = F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    return s.part.select("p_partkey", map_hash(m).alias("digest"))


# --- extraction from derived report lines ---------------------------------------------------------


@query("X01_number_extraction", """
with c as (select 'total_count' as kind, n as v, * from {v_vars} a where pr = '3' union all select 'gene_count', n, * from {v_vars} b where pr = '3'
  union all select 'upregulated', u, * from {v_vars} c where pr = '3' union all select 'downregulated', d, * from {v_vars} e where pr = '3')
select project_id, line, kind, cast(v as varchar) as value from c
union all select project_id, line, 'auc_value', '0.9' || (c + 4) from {v_vars} v where pr = '5'
union all select project_id, line, 'p_value', '0.0' || a from {v_vars} v where pr = '5'
union all select project_id, line, 'fdr_value', '0.' || b from {v_vars} v where pr = '5'
union all select project_id, line, 'log2fc_threshold', cast(b as varchar) from {v_vars} v where pr = '5'""")
def _(s):
    return X.numbers(s.v_report_lines).select(K, "line", "kind", "value")


@query("X02_typed_claims", """
select distinct project_id, label, v as claimed from (
  select project_id, 'DEG total' as label, unnest([n, u]) as v from {v_vars} a where pr = '3'
  union all select project_id, 'DEG up', unnest([n, u]) from {v_vars} b where pr = '3' union all select project_id, 'DEG down', unnest([n, d]) from {v_vars} c where pr = '3') q""")
def _(s):
    return X.claims(s.v_report_lines)


@query("X03_sections", """
with h as (select project_id, line, a || '.' || b as section, 'Title ' || case st when 'F' then 'WGCNA' when 'O' then 'PPI' else 'LASSO' end as title from {v_vars} v where pr = '1'),
t as (select project_id, max(line) as total from {v_vars} v group by 1)
select h.project_id, section, title, line, coalesce(lead(line) over (partition by h.project_id order by line) - 1, total) as line_end from h join t on t.project_id = h.project_id""")
def _(s):
    return X.sections(s.v_report_lines)


FIGS = """(select v.*, last_value(case when pr = '1' then a || '.' || b end ignore nulls) over (partition by project_id order by line rows between unbounded preceding and current row) as section from {v_vars} v)"""


@query("X04_figure_refs", f"""
select project_id, line, section, figure, coalesce(section is not null and len(string_split(figure, '.')) >= 2 and section <> array_to_string(string_split(figure, '.')[1:2], '.'), false) as mismatch
from (select project_id, line, section, unnest([a || '.' || b || '.' || c, cast(b as varchar)]) as figure from {FIGS} f where pr = '2') q""")
def _(s):
    return X.figure_refs(s.v_report_lines)


@query("X04_table_refs", f"select project_id, line, section, a || '.' || c as table_no from {FIGS} f where pr = '2'")
def _(s):
    return X.table_refs(s.v_report_lines)


@query("J04_as_of_section", f"select project_id, line, section from {FIGS} f where pr in ('2', '3', '4', '5') and section is not null")
def _(s):
    body = s.v_report_lines.where(~F.col("text").rlike(V.SECTION)).select(K, "line")
    return J.with_section(body, X.sections(s.v_report_lines)).where("section is not null")


@query("J04_last_user_turn", """
select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as last_user_turn
from (select conv_id, turn, min(role) as role from conversations group by 1, 2) c""")
def _(s):
    from claimgrid.functions.ordered import last_known

    c = s.conversations.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return last_known(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user_turn").drop("role")


@query("X06_symbols", """
select project_id, symbol, min(line) as first_line, cast(count(*) as bigint) as mentions from (
  select project_id, line, 'TP' || (50 + a) as symbol from {v_vars} v where pr = '4' union all select project_id, line, 'GSE' || (10000 + n) from {v_vars} v where pr = '4') q group by 1, 2""")
def _(s):
    return X.symbols(s.v_report_lines)


@query("X07_resource_refs", """
select project_id, line, 'STRING' as resource, b as ref from {v_vars} v where pr = '4' union all select project_id, line, 'GeneCards', null from {v_vars} v where pr = '4'""")
def _(s):
    return X.resource_refs(s.v_report_lines)


@query("X08_asset_markers", """
with c as (select conv_id, turn, min(text) as text from conversations group by 1, 2)
select project_id, line, file, context_before, context_after from (
  select conv_id as project_id, turn as line, 'image_' || turn || '.png' as file, substr(trim(coalesce(lag(role) over w, '')), 1, 100) as context_before, substr(trim(coalesce(lead(role) over w, '')), 1, 100) as context_after
  from (select conv_id, turn, 'x [IMAGE: image_' || turn || '.png] ' || min(role) as role from conversations group by 1, 2) q window w as (partition by conv_id order by turn)) z""")
def _(s):
    c = s.conversations.groupBy(F.col("conv_id").alias(K), F.col("turn").alias("line")).agg(F.min("role").alias("role"))
    return X.asset_markers(c.select(K, "line", F.concat(F.lit("x [IMAGE: image_"), "line", F.lit(".png] "), "role").alias("text")))


@query("X09_identifiers", """
select distinct project_id, kind, value from (select project_id, 'dataset' as kind, 'GSE' || (10000 + n) as value from {v_vars} v where pr = '4'
  union all select project_id, 'project', '25YLC' || (100 + a) || 'F' from {v_vars} v where pr = '4') q""")
def _(s):
    return X.identifiers(s.v_report_lines)


@query("X10_packages", """
select distinct project_id, path, package from (select project_id, path, 'dplyr' as package from {v_code_vars} v where kind = 'AF'
  union all select project_id, path, case ln when 1 then 'limma' when 2 then 'glmnet' when 3 then 'stats' when 4 then 'WGCNA' when 5 then 'Seurat' else 'ggplot2' end from {v_code_vars} v where kind = 'AF') q where package <> 'stats'""")
def _(s):
    return X.packages(s.v_code_lines)


@query("X11_parameters", """
select project_id, path, line, kind, value, 'code' as source from (
  select project_id, path, line, 'p_value_threshold' as kind, '0.0' || (1 + disc % 9) as value, kind as k from {v_code_vars} v where v.kind = 'AO'
  union all select project_id, path, line, 'logFC_threshold', cast(1 + tax % 5 as varchar), kind from {v_code_vars} v where v.kind = 'AO') q""")
def _(s):
    return X.parameters(s.v_code_lines)


@query("X12_io_refs", """
select project_id, path, line, '/data/run' || ln || '/part' || disc || '/in.csv' as ref_path, 'input' as direction from {v_code_vars} v where kind = 'NO'
union all select project_id, path, line, 'out/r' || q || '.rds', 'input' from {v_code_vars} v where kind = 'NO'""")
def _(s):
    return X.io_refs(s.v_code_lines)


@query("X13_models", """
select project_id, path, line, 'fit' || q as model, 'glm' as "function", 'y' as response,
  case when disc < 3 then 'age,bmi' when disc < 6 then 'age,bmi,sex' when disc < 9 then 'age,grade,stage' else 'age' end as predictors from {v_code_vars} v where kind = 'NF'""")
def _(s):
    return X.models(s.v_code_lines).withColumn("predictors", F.concat_ws(",", "predictors"))


@query("X14_symbol_vectors", """
select distinct l_suppkey as project_id, 'f' || l_linenumber as path, 'core_genes' as vector, unnest(['TP' || cast(l_quantity as bigint), 'BRCA1']) as member from lineitem""")
def _(s):
    code = s.lineitem.select(F.col("l_suppkey").alias(K), F.concat(F.lit("f"), "l_linenumber").alias("path"),
                             F.concat(F.lit('x <- c("ZZ1",\n "ZZ2")\ncore_genes <- c("TP'), F.col("l_quantity").cast("long"), F.lit('",\n "BRCA1")')).alias("text"))
    return X.symbol_vectors(code, ["core_genes"])


@query("X15_thresholds", """
select project_id, 'report' as source, label, value, cast(count(*) as bigint) as n from (
  select project_id, 'p-value threshold' as label, cast('0.0' || a as double) as value from {v_vars} v where pr = '5' union all select project_id, 'logFC threshold', cast(b as double) from {v_vars} v where pr = '5') q group by all
union all select project_id, 'code', label, value, cast(count(*) as bigint) from (
  select project_id, 'p-value threshold' as label, cast('0.0' || (1 + disc % 9) as double) as value from {v_code_vars} v where kind = 'AO' union all select project_id, 'logFC threshold', cast(1 + tax % 5 as double) from {v_code_vars} v where kind = 'AO') q group by all""")
def _(s):
    r = X.thresholds(s.v_report_lines, V.REPORT_THRESHOLDS).select(K, F.lit("report").alias("source"), "label", "value")
    c = X.thresholds(s.v_code_lines, V.CODE_THRESHOLDS).select(K, F.lit("code").alias("source"), "label", "value")
    return r.unionByName(c).groupBy(K, "source", "label", "value").agg(F.count(F.lit(1)).alias("n"))


@query("X16_plot_filter_thresholds", """
select project_id, path, line, cast(1 + disc % 3 as double) as plot_effect, cast(1 + tax % 3 as double) as filter_effect from {v_code_vars} v where kind = 'RF'""")
def _(s):
    code = s.v_code_lines.where(F.col("text").contains("geom_vline"))
    t = X.plot_filter_thresholds(code.withColumn("path", F.concat_ws("#", "path", "line")))
    return t.select(K, F.split("path", "#")[0].alias("path"), F.split("path", "#")[1].cast("long").alias("line"), "plot_effect", "filter_effect")


VIEWS["v_stage_lines"] = """
select o_custkey as project_id, o_orderkey + 1 as line, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr, cast(floor(o_totalprice / 10) as bigint) as n,
  concat(case substr(o_orderpriority, 1, 1) when '1' then 'raw data' when '2' then 'after merge' when '3' then 'filter step' when '4' then 'final set' else 'other' end, ' had ', cast(floor(o_totalprice / 10) as bigint), ' cells') as text
from {orders}"""


@query("X17_staged_counts", """
select project_id, line, case pr when '1' then 'initial' when '2' then 'merged' when '3' then 'filtered' when '4' then 'final' else 'unknown' end as stage, n from {v_stage_lines} v where n >= 10""")
def _(s):
    return X.staged_counts(s.v_stage_lines.select(K, "line", "text"))


VIEWS["v_cited_texts"] = """
select o_orderkey as project_id, o_custkey as ck, o_orderstatus as st, concat('We used STRING db [', 1 + o_custkey % 4, '] and GeneCards here. ', case when o_orderstatus = 'P' then 'OMIM was used' else 'done' end, chr(10), '参考文献', chr(10), 'string paper', chr(10), 'genecards suite', chr(10),
  case when o_orderstatus = 'F' then concat('公司介绍 ', o_orderpriority) else 'omim catalog' end) as text from {orders}"""


@query("X18_split_references", """
select project_id, cast(unnest(case when st = 'F' then [1, 2] else [1, 2, 3] end) as bigint) as ref, unnest(case when st = 'F' then ['string paper', 'genecards suite'] else ['string paper', 'genecards suite', 'omim catalog'] end) as reference from {v_cited_texts} v""")
def _(s):
    return X.split_references(s.v_cited_texts)[1]


@query("X19_trim_tail", "select project_id, cast(case when st = 'F' then strpos(text, '公司介绍') - 1 else length(text) end as bigint) as kept from {v_cited_texts} v")
def _(s):
    return X.trim_tail(s.v_cited_texts.select(K, "text")).select(K, F.length("text").cast("long").alias("kept"))


@query("X22_citations", """
select project_id, 'STRING' as resource, cast(1 + ck % 4 as bigint) as ref from {v_cited_texts} v""")
def _(s):
    body, _ = X.split_references(s.v_cited_texts.select(K, "text"))
    return X.citations(body).select(K, "resource", "ref")


@query("J11_citation_check", """
select project_id, 'STRING' as resource, cast(1 + ck % 4 as bigint) as ref, 'out_of_range' as problem, 'CRITICAL' as severity from {v_cited_texts} v where 1 + ck % 4 > case when st = 'F' then 2 else 3 end
union all select project_id, 'STRING', cast(1 + ck % 4 as bigint), 'mismatch', 'CRITICAL' from {v_cited_texts} v where 1 + ck % 4 between 2 and case when st = 'F' then 2 else 3 end
union all select project_id, 'GeneCards', null, 'no_citation', 'MAJOR' from {v_cited_texts} v union all select project_id, 'OMIM', null, 'no_citation', 'MAJOR' from {v_cited_texts} v where st = 'P'""")
def _(s):
    body, refs = X.split_references(s.v_cited_texts.select(K, "text"))
    named = X.resource_refs(body.select(K, F.lit(1).alias("line"), F.col("body").alias("text"))).select(K, "resource")
    return J.citation_check(X.citations(body), refs, named).select(K, "resource", "ref", "problem", "severity")


@query("X21_pair_claims", """
select distinct a.project_id, 'TP' || (50 + a.a) as entity, case a.st when 'F' then 'T cell' when 'O' then 'NK cell' else 'B cell' end as partner
from {v_vars} a join {v_vars} b on a.project_id = b.project_id and abs(a.line - b.line) <= 2 and b.pr = '1'""")
def _(s):
    v = s.v_vars
    part = F.when(F.col("st") == "F", "T cell").when(F.col("st") == "O", "NK cell").otherwise("B cell")
    text = F.concat(F.when(F.col("pr") == "1", "Mantel test ").otherwise(""), F.lit("TP"), F.col("a") + 50, F.lit("与"), part, F.lit("呈显著相关"))
    return X.pair_claims(v.select(K, "line", text.alias("text")))


VIEWS["v_tables_text"] = """
select o_custkey as project_id, o_orderkey * 4 + i as line, case i when 0 then concat('note ', o_orderkey) when 1 then '| ID | Severity | Count |' when 2 then '|---|:--:|---|' else concat('| F-', o_orderkey, ' | ', o_orderpriority, ' | ', o_custkey, ' |') end as text
from (select *, 0 as i from {orders} as o0 union all select *, 1 as i from {orders} as o1 union all select *, 2 as i from {orders} as o2 union all select *, 3 as i from {orders} as o3) as x"""


@query("X23_pipe_tables", "select o_custkey as project_id, 'F-' || o_orderkey as id, o_orderpriority as severity, cast(o_custkey as varchar) as n from orders")
def _(s):
    rows = X.pipe_tables(s.v_tables_text)
    return rows.select(K, X.table_value("", "编号", "id").alias("id"), X.table_value("", "severity").alias("severity"), X.table_value("", "count").alias("n"))


VIEWS["v_md_lines"] = """
select o_custkey as project_id, o_orderkey as line, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr, case substr(o_orderpriority, 1, 1)
  when '1' then concat(case o_orderstatus when 'F' then '# ' when 'O' then '## ' else '#### ' end, 'Part ', o_orderkey)
  when '2' then concat('- item ', o_orderpriority) when '3' then concat('see [x](#part-', o_orderkey - o_custkey % 3, ') and [y](01_DEGs/score_final_', 1 + o_custkey % 50, '.csv:12)')
  when '4' then concat('审核结论：', o_orderstatus) else '' end as text from {orders}"""


@query("X24_bullets", "select project_id, line, 'item 2-HIGH' as item from {v_md_lines} v where pr = '2'")
def _(s):
    return X.bullets(s.v_md_lines)


@query("X25_verdict", "select project_id, arg_min(st, line) as verdict from {v_md_lines} v where pr = '4' group by 1")
def _(s):
    return X.verdict(s.v_md_lines)


@query("X26_headings", "select project_id, line, cast(case st when 'F' then 1 when 'O' then 2 else 4 end as bigint) as level, 'Part ' || line as title from {v_md_lines} v where pr = '1'")
def _(s):
    return X.headings(s.v_md_lines).withColumn("level", F.col("level").cast("long"))


@query("X26_html_links", r"""
select page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) as target from pages""")
def _(s):
    return X.html_links(s.pages)


@query("W07_heading_checks", """
with b as (select *, case when pr = '1' then case st when 'F' then 1 when 'O' then 2 else 4 end end as level from {v_md_lines} v where text <> ''),
h as (select project_id, line, level, 'Part ' || line as title, lead(coalesce(level, 0)) over (partition by project_id order by line) as nxt from b),
k as (select *, lag(level) over (partition by project_id order by line) as prev from h where level is not null)
select project_id, line, title, 'heading_jump' as problem from k where level - prev > 1
union all select project_id, line, title, 'empty_section' from k where prev is not null and (nxt is null or (nxt > 0 and nxt <= level))""")
def _(s):
    return W.heading_checks(s.v_md_lines).select(K, "line", "title", "problem")


VIEWS["v_issue_lines"] = """
select o_custkey as project_id, o_orderkey * 4 + i as line, o_orderkey as ok, o_orderstatus as st, case i
  when 0 then concat('### P01-', o_orderkey, ' [', case o_orderstatus when 'F' then 'FATAL' when 'O' then 'MAJOR' else 'WARNING' end, '] title ', o_orderpriority)
  when 1 then case when o_orderstatus = 'P' then 'plain text' else concat('#### 具体错误 1：wrong ', o_orderkey) end
  when 2 then concat('- **证据**：', case when o_orderstatus = 'F' then '' else 'value ' end, case when o_orderstatus = 'F' then '' else cast(o_custkey as varchar(20)) end) else '- **原报告位置**：report.docx > 图 3' end as text
from (select *, 0 as i from {orders} as o0 union all select *, 1 as i from {orders} as o1 union all select *, 2 as i from {orders} as o2 union all select *, 3 as i from {orders} as o3) as x"""


@query("X27_issue_blocks", """
select o_custkey as project_id, 'P01-' || o_orderkey as issue_id, case o_orderstatus when 'F' then 'FATAL' when 'O' then 'MAJOR' else 'WARNING' end as severity, 'title ' || o_orderpriority as title,
  cast(4 as bigint) as block_lines, cast(case when o_orderstatus = 'P' then 0 else 3 end as bigint) as child_lines from orders""")
def _(s):
    b = X.issue_blocks(s.v_issue_lines.select(K, "line", "text"))
    return b.groupBy(K, "issue_id", "severity", "title").agg(F.count(F.lit(1)).alias("block_lines"), F.count_if(F.col("child_no").isNotNull()).alias("child_lines"))


@query("A38_report_depth", """
with n as (select o_custkey as project_id, count(*) as n from orders group by 1)
select project_id, 'core_issue_limit' as "check", '' as issue_id, '' as label from n where n > 5
union all select o_custkey, 'child_errors', 'P01-' || o_orderkey, '' from orders where o_orderstatus = 'P'
union all select o_custkey, 'child_field', 'P01-' || o_orderkey || '.1', '证据' from orders where o_orderstatus = 'F'""")
def _(s):
    from claimgrid.operators.aggregate import depth_checks

    return depth_checks(X.issue_blocks(s.v_issue_lines.select(K, "line", "text")), ["证据", "原报告位置"])


@query("X28_resource_files", """
select distinct project_id, path, 'sets/' || case when tax < 3 then 'mouse' when tax < 6 then 'human' else 'custom' end || '_v' || ln || '.gmt' as ref from {v_code_vars} v where kind = 'RO'""")
def _(s):
    return X.resource_files(s.v_code_lines).select(K, "path", "ref")


@query("X05_resolve_column", """
select o_custkey as project_id, 'f' || o_orderkey as path, case o_orderstatus when 'F' then 'Symbol' when 'O' then 'name' end as "column", case o_orderstatus when 'F' then 'name' when 'O' then 'content' end as found_by from orders""")
def _(s):
    o = s.orders.select(F.col("o_custkey").alias(K), F.concat(F.lit("f"), "o_orderkey").alias("path"), "o_orderstatus")
    meta = o.select(K, "path", F.when(F.col("o_orderstatus") == "F", F.array(F.lit("x"), F.lit("Symbol"))).otherwise(F.array(F.lit("name"), F.lit("v"))).alias("header"))
    rows = o.select(K, "path", F.create_map(F.lit("name"), F.when(F.col("o_orderstatus") == "O", "TP53").otherwise("12"), F.lit("v"), F.lit("1")).alias("cells"))
    return X.resolve_column(meta, rows, V.SYMBOL_COLUMNS)


# --- predicates -----------------------------------------------------------------------------------

VIEWS["v_zh_lines"] = """
select o_custkey as project_id, o_orderkey as line, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr,
  concat(case o_orderstatus when 'F' then '' when 'O' then '免' else '免疫浸润 ' end, '疫浸润 ', case substr(o_orderpriority, 1, 1) when '1' then '折线图' when '2' then '线图' when '3' then '局势细胞' when '4' then '胞凋亡' else '分子对结 tp' end) as text from {orders}"""


@query("P01_missing_characters", """
select project_id, line, '疫浸润' as wrong, '免疫浸润' as correct, 'MAJOR' as severity from {v_zh_lines} v where st = 'F'
union all select project_id, line, '线图', '列线图', 'MAJOR' from {v_zh_lines} v where pr = '2' union all select project_id, line, '胞凋亡', '细胞凋亡', 'MAJOR' from {v_zh_lines} v where pr = '4'""")
def _(s):
    return P.missing_chars(s.v_zh_lines)


@query("P02_wrong_words", """
select project_id, line, '局势细胞' as wrong, '巨噬细胞' as correct, 'MAJOR' as severity from {v_zh_lines} v where pr = '3' union all select project_id, line, '分子对结', '分子对接', 'MAJOR' from {v_zh_lines} v where pr = '5'""")
def _(s):
    return P.wrong_words(s.v_zh_lines)


@query("P03_text_anomalies", """
select project_id, line, '局势细胞' as found, '巨噬细胞' as correct, 'CRITICAL' as severity from {v_zh_lines} v where pr = '3'
union all select project_id, line, '胞凋亡', '细胞凋亡', 'WARNING' from {v_zh_lines} v where pr = '4' union all select project_id, line, substr(text, 1, 6), '?', 'WARNING' from {v_zh_lines} v where st = 'F'""")
def _(s):
    return P.text_anomalies(s.v_zh_lines)


VIEWS["v_projects"] = """
select c_custkey as project_id, c_name as name, concat('25YLC', 100 + c_custkey % 4, 'F') as project_code, case c_mktsegment when 'HOUSEHOLD' then '肾结石' when 'MACHINERY' then '心血管' when 'FURNITURE' then '代谢' when 'BUILDING' then '免疫' else 'IBD' end as project_type,
  case c_mktsegment when 'HOUSEHOLD' then 'LIHC' when 'MACHINERY' then 'LUAD' when 'FURNITURE' then 'COAD' else null end as expected, case c_mktsegment when 'HOUSEHOLD' then 'human' when 'MACHINERY' then 'mouse' else 'unknown' end as species from {customer}"""

VIEWS["v_term_lines"] = """
select o_custkey as project_id, o_orderkey as line, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr, concat(case o_orderstatus when 'P' then '# ' else '' end, case substr(o_orderpriority, 1, 1) when '1' then 'tumor vs normal' when '2' then 'Cancer, Tumor LUAD' when '3' then 'HCC and NSCLC read.table READ' when '4' then 'doi: 10 tumor' else 'heartless kidney' end) as text from {orders}"""


@query("P04_forbidden_terms", """
with w(project_type, w, severity) as (values ('肾结石','tumor','FATAL'),('肾结石','normal','FATAL'),('肾结石','cancer','FATAL'),('心血管','tumor','FATAL'),('心血管','normal','FATAL'),('心血管','cancer','FATAL'),('代谢','tumor','FATAL'),('代谢','kidney','SERIOUS'),('免疫','tumor','FATAL'),('IBD','tumor','FATAL'),('IBD','cancer','FATAL')),
l as (select project_id, line, case pr when '1' then ['tumor', 'normal'] when '2' then ['Cancer', 'Tumor'] when '5' then ['kidney'] else [] end as ts from {v_term_lines} v where st <> 'P' and pr <> '4'),
t as (select project_id, line, unnest(ts) as term from l)
select t.project_id, t.line, p.project_type, t.term, w.severity from t join {v_projects} p on p.project_id = t.project_id join w on w.project_type = p.project_type and w.w = lower(t.term)""")
def _(s):
    return P.forbidden_terms(s.v_term_lines, s.v_projects)


@query("P05_foreign_codes", """
with l as (select project_id, line, unnest(case pr when '2' then ['LUAD'] when '3' then ['HCC', 'NSCLC'] else [] end) as code from {v_term_lines} v)
select l.project_id, line, code, 'FATAL' as severity from l join {v_projects} p on p.project_id = l.project_id
where expected is not null and not (expected = 'LIHC' and code = 'HCC') and not (expected = 'LUAD' and code in ('LUAD', 'NSCLC'))""")
def _(s):
    return P.foreign_codes(s.v_term_lines.select(K, "line", "text"), s.v_projects)


@query("P06_foreign_ids", """
select v.project_id, line, '25YLC' || (100 + a) || 'F' as found, project_code, 'FATAL' as severity from {v_vars} v join {v_projects} p on p.project_id = v.project_id where pr = '4' and project_code <> '25YLC' || (100 + a) || 'F'""")
def _(s):
    return P.foreign_ids(s.v_report_lines, s.v_projects)


@query("P07_template_residue", """
with w as (select project_id, line, case pr when '1' then 'Tumor' when '2' then 'Cancer' when '4' then 'Tumor' end as keyword, case when pr = '2' then ['Tumor'] else [] end as more, false as ctx from {v_term_lines} v),
x as (select project_id, line, keyword from w where keyword is not null union all select project_id, line, unnest(more) from w)
select project_id, 'tumour' as grp, keyword, cast(count(*) as bigint) as body_lines, cast(count(*) as bigint) as all_lines, min(line) as first_line, 'CRITICAL' as severity from x group by 1, 2, 3""")
def _(s):
    empty = X.sections(s.v_term_lines.select(K, "line", F.lit("x").alias("text")))
    return P.template_residue(s.v_term_lines.select(K, "line", "text"), s.v_projects, empty)


@query("P08_statistic_anomalies", """
select project_id, 'auc_near_one' as kind, cast(count(*) as bigint) as n, 'INFO' as severity from {v_vars} v where pr = '5' group by 1""")
def _(s):
    return P.stat_anomalies(s.v_report_lines)


@query("P09_small_validation", """
select distinct o_custkey as project_id, cast(o_orderkey % 9 as bigint) as n, 'WARNING' as severity from orders where o_orderkey % 9 <= 5""")
def _(s):
    return P.small_validation(s.orders.select(F.col("o_custkey").alias(K), F.concat(F.lit("validation set of cohort n = "), F.col("o_orderkey") % 9).alias("text")))


@query("P10_sum_identities", """
select project_id, line, 'up_down' as kind, 'CRITICAL' as severity, n as total, u as part_a, d as part_b from {v_vars} v where pr = '3' and n <> u + d
union all
select a.project_id, a.line, 'up_down', 'CRITICAL', b.n, b.u, b.d from (select project_id, line, pr, lead(line) over (partition by project_id order by line) as nl from {v_vars} v) a
join {v_vars} b on b.project_id = a.project_id and b.line = a.nl where a.pr <> '3' and b.pr = '3' and b.n <> b.u + b.d""")
def _(s):
    return P.sum_identities(s.v_report_lines)


@query("P11_inline_contradiction", """
select o_custkey as project_id, o_orderkey as line, cast(o_orderkey % 1000 + 10 as bigint) as n_before, cast(floor(o_totalprice / 500) as bigint) as n_after, 'CRITICAL' as severity from orders where cast(floor(o_totalprice / 500) as bigint) > o_orderkey % 1000 + 10""")
def _(s):
    t = F.concat(F.lit("raw "), F.col("o_orderkey") % 1000 + 10, F.lit(" cells\nthen retain "), F.floor(F.col("o_totalprice") / 500).cast("long"), F.lit(" cells"))
    return P.inline_contradiction(s.orders.select(F.col("o_custkey").alias(K), F.col("o_orderkey").alias("line"), t.alias("text")))


@query("P12_absolute_paths", """
select project_id, '/data/run' || ln || '/part' || disc as prefix, cast(count(distinct path) as bigint) as files, 'INFO' as severity from {v_code_vars} v where kind = 'NO' group by 1, 2""")
def _(s):
    return P.absolute_paths(X.io_refs(s.v_code_lines))


@query("P13_file_health", """
with f as (select * from {v_files} v where ext in ('.png', '.pdf', '.jpg', '.svg'))
select project_id, path, 'empty' as problem, '' as detail, 'CRITICAL' as severity from f where size = 0
union all select project_id, path, 'small_pdf', '', 'WARNING' from f where size > 0 and ext = '.pdf' and size < 500
union all select project_id, path, 'small_image', '', 'WARNING' from f where size > 0 and ext in ('.png', '.jpg') and size < 1024
union all select project_id, path, 'typo', 'volcanol->volcano', 'WARNING' from f where path like '%volcanol%'""")
def _(s):
    return P.file_health(s.v_files)


@query("P14_missing_parameter", """
select o_orderkey as project_id, 'lasso' as method, 'WARNING' as severity from orders where o_orderstatus = 'F'""")
def _(s):
    t = F.when(F.col("o_orderstatus") == "F", "LASSO was used, the minimum follows").when(F.col("o_orderstatus") == "O", "lasso with lambda.min").otherwise("ridge")
    return P.missing_parameter(s.orders.select(F.col("o_orderkey").alias(K), t.alias("text")))


VIEWS["v_metrics"] = """
select o_custkey as project_id, 'm.csv' as path, concat('model', o_orderkey) as model, o_orderstatus as st, case o_orderstatus when 'F' then '1.0' when 'O' then '0.92' else '0.7' end as auc, concat('0.', 1 + cast(floor(o_totalprice) as bigint) % 9) as accuracy from {orders}"""


@query("P15_metric_anomalies", """
select project_id, path, model, 'perfect_auc' as problem, 'WARNING' as severity from {v_metrics} m where st = 'F'
union all select project_id, path, model, 'auc_accuracy_gap', 'WARNING' from {v_metrics} m where st in ('F', 'O') and cast(accuracy as double) < 0.4""")
def _(s):
    return P.metric_anomalies(s.v_metrics)


LINT = [("markdown:placeholder", "the", "", "warning"), ("terminology", " of ", " from ", "error"), ("forbidden", "license", "", "warning")]


@query("P16_lint_terms", f"""
with r(c, t, r, sv) as (values ('markdown:placeholder', 'the', '', 'warning'), ('terminology', ' of ', ' from ', 'error'), ('forbidden', 'license', '', 'warning'))
select project_id, line, c as "check", t as term, r as replacement, sv as severity from {DOC_LINES} d join r on contains(d.text, r.t)""")
def _(s):
    return P.lint_terms(doc_lines(s), LINT)


@query("P17_evidence_complete", "select o_orderkey, o_orderstatus <> 'P' and o_orderpriority <> '5-LOW' as complete from orders")
def _(s):
    o = s.orders.select("o_orderkey", F.col("o_orderstatus").alias("source_path"), F.lit("x").alias("locator"), F.when(F.col("o_orderstatus") != "P", "q").alias("quote_or_value"),
                        F.when(F.col("o_orderpriority") == "5-LOW", " 　 ").otherwise("e").alias("evidence"))
    return o.select("o_orderkey", P.evidence_complete().alias("complete"))


VIEWS["v_meta"] = """
select o_custkey as project_id, concat('01_DEG/t', o_orderkey, '_baseline.csv') as path, o_orderstatus as st, cast(o_orderkey % 6 as bigint) as row_count from {orders}"""


def meta(s):
    h = F.when(F.col("st") == "F", F.array(F.lit("Gene"), F.lit("logFC"))).when(F.col("st") == "O", F.array(F.lit("Gene"), F.lit("P_value"))).otherwise(F.array(F.lit("Gene"), F.lit("S1")))
    return s.v_meta.select(K, "path", h.alias("header"), F.col("row_count").alias("rows"))


@query("P18_table_type", """
select project_id, cast(count(*) as bigint) as tables, min(path) as sample, 'MAJOR' as severity from {v_meta} m group by 1 having not bool_or(st = 'F')""")
def _(s):
    return P.table_type(meta(s))


@query("P19_baseline_shape", """
select project_id, path, 'no_p_column' as problem, 'WARNING' as severity from {v_meta} m where st <> 'O' union all select project_id, path, 'few_rows', 'WARNING' from {v_meta} m where row_count < 3""")
def _(s):
    return P.baseline_shape(meta(s))


@query("P20_cover_assets", """
with l as (select conv_id as project_id, turn as line, min(role) as role from conversations group by 1, 2),
e as (select project_id, max(line) + 3 as e from l where line <= 30 and role = 'user' group by 1)
select l.project_id, l.line, 'f' as file, coalesce(l.line <= e.e, false) as is_cover from l left join e on e.project_id = l.project_id""")
def _(s):
    c = s.conversations.groupBy(F.col("conv_id").alias(K), F.col("turn").alias("line")).agg(F.min("role").alias("role"))
    lines = c.select(K, "line", F.when(F.col("role") == "user", "项目编号 x").otherwise("y").alias("text"))
    return P.cover_assets(lines, c.select(K, "line", F.lit("f").alias("file")))


@query("P21_foreign_in_assets", """
select o_custkey as project_id, 'a' || o_orderkey as asset_id, '25YLC' || (100 + o_orderkey % 4) as found, 'CRITICAL' as severity from orders where '25YLC' || (100 + o_orderkey % 4) <> '25YLC' || (100 + o_custkey % 4)""")
def _(s):
    a = s.orders.select(F.col("o_custkey").alias(K), F.concat(F.lit("a"), "o_orderkey").alias("asset_id"), F.concat(F.lit("scan 25YLC"), F.col("o_orderkey") % 4 + 100, F.lit(" panel")).alias("text"))
    p = s.customer.select(F.col("c_custkey").alias(K), F.concat(F.lit("25YLC"), F.col("c_custkey") % 4 + 100).alias("project_code"))
    return P.foreign_in_assets(a, p)


@query("W03_two_line_context", f"""
select project_id, line, md5(concat_ws(' ', text, lead(text) over (partition by project_id order by line))) as digest from {DOC_LINES} d""")
def _(s):
    return W.two_line_context(doc_lines(s)).select(K, "line", F.md5("context").alias("digest"))


@query("W04_neighbour_lines", """
select project_id, line, cast(count(*) over w as bigint) as lines, md5(string_agg(text, chr(10)) over w) as digest from {v_report_lines} v
window w as (partition by project_id order by line range between 2 preceding and 2 following)""")
def _(s):
    from claimgrid.functions.ordered import neighbours

    n = neighbours(s.v_report_lines, [K], "line", "text", 2, 2, "ctx")
    return n.select(K, "line", F.size("ctx").cast("long").alias("lines"), F.md5(F.array_join("ctx", "\n")).alias("digest"))
