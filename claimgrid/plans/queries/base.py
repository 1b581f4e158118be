"""Registration of queries, and audit tables derived from the driver tables.

The derived tables are plain SQL that Spark and the oracle engine both understand. Spark operators see
only the derived columns (such as a line of report text); the oracle SQL may use the numbers the text
was made from, so that it checks the extraction instead of repeating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimgrid.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}


def view_sql(name: str, tables: dict[str, str]) -> str:
    refs = dict(tables)
    for v in VIEWS:
        if "{" + v + "}" in VIEWS[name]:
            refs[v] = "(" + view_sql(v, tables) + ")"
    return VIEWS[name].format(**refs)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.sql(view_sql(name, {t: f"parquet.`{sf}/{t}.parquet`" for t in TABLES}))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Source:
    """``s.orders`` is a driver table, ``s.v_report_lines`` a derived one."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf, name)
        if name in TABLES:
            return table(self.spark, self.sf, name)
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register ``fn(source) -> DataFrame`` under ``name`` with its oracle SQL (none: rows are checked only)."""

    def register(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf: fn(Source(tune(spark), sf))
        if sql is not None:
            plain = {t: t for t in TABLES}
            refs = {v: "(" + view_sql(v, plain) + ")" for v in VIEWS if "{" + v + "}" in sql}
            out = sql
            for k, v in refs.items():
                out = out.replace("{" + k + "}", v)
            ORACLES[name] = out.strip()
        return fn

    return register


# Numbers that the report lines are made of: one row per order; project = customer, line = order number + 1.
VIEWS["v_vars"] = """
select o_custkey as project_id, o_orderkey + 1 as line, o_orderstatus as st, substr(o_orderpriority, 1, 1) as pr,
  cast(1 + cast(floor(o_totalprice) as bigint) % 4 as bigint) as a,
  cast(1 + cast(floor(o_totalprice / 10) as bigint) % 5 as bigint) as b,
  cast(1 + cast(floor(o_totalprice / 100) as bigint) % 4 as bigint) as c,
  cast(100 + cast(floor(o_totalprice / 7) as bigint) % 400 as bigint) as n,
  cast(40 + cast(floor(o_totalprice / 3) as bigint) % 160 as bigint) as u,
  cast(50 + cast(floor(o_totalprice / 11) as bigint) % 200 as bigint) as d,
  cast(floor(o_totalprice) as bigint) as amt
from {orders}"""

# Report text by order priority: heading, figure reference, counts, identifiers, thresholds.
VIEWS["v_report_lines"] = """
select project_id, line, case pr
  when '1' then concat(a, '.', b, ' Title ', case st when 'F' then 'WGCNA' when 'O' then 'PPI' else 'LASSO' end)
  when '2' then concat('  see Fig ', a, '.', b, '.', c, ' and Table ', a, '.', c, ' or Figure ', b)
  when '3' then concat('共', n, '个差异基因，上调', u, '个，下调', d, '个')
  when '4' then concat('data GSE', 10000 + n, ' project 25YLC', 100 + a, 'F via STRING [', b, '] gene TP', 50 + a, ' and GeneCards')
  else concat('P < 0.0', a, ' with log2FC > ', b, ', AUC = 0.9', c + 4, ' and FDR < 0.', b) end as text
from {v_vars} as v"""

# Code lines: one row per line item; project = supplier, script = line number.
VIEWS["v_code_vars"] = """
select l_suppkey as project_id, concat('scripts/s', l_linenumber, '.R') as path, l_orderkey as line, concat(l_returnflag, l_linestatus) as kind,
  l_linenumber as ln, cast(l_quantity as bigint) as q, l_partkey as pk, cast(round(l_discount * 100) as bigint) as disc, cast(round(l_tax * 100) as bigint) as tax
from {lineitem}"""

VIEWS["v_code_lines"] = """
select project_id, path, 'R' as lang, line, case kind
  when 'AF' then concat('library(', case ln when 1 then 'limma' when 2 then 'glmnet' when 3 then 'stats' when 4 then 'WGCNA' when 5 then 'Seurat' else 'ggplot2' end, '); x <- dplyr::filter(d)')
  when 'AO' then concat('p_cutoff <- 0.0', 1 + disc % 9, '; logfc_cutoff <- ', 1 + tax % 5)
  when 'NF' then concat('fit', q, ' <- glm(y ~ ', case when disc < 3 then 'age + bmi' when disc < 6 then 'age + bmi + sex' when disc < 9 then 'age + grade + stage' else 'age' end, ', data = d)')
  when 'NO' then concat('d <- read.csv("/data/run', ln, '/part', disc, '/in.csv"); saveRDS("out/r', q, '.rds")')
  when 'RF' then concat('geom_vline(xintercept = c(-', 1 + disc % 3, ', ', 1 + disc % 3, ')); logFC_main_cutoff <- ', 1 + tax % 3)
  else concat('ids: GSE', 10000 + q, ' 25YLC', 100 + disc % 4, 'F; set "sets/', case when tax < 3 then 'mouse' when tax < 6 then 'human' else 'custom' end, '_v', ln, '.gmt"') end as text
from {v_code_vars} as v"""

# Delivered files: one row per distinct path; project = supplier, module = line number.
VIEWS["v_files"] = """
select project_id, module, concat(module, '/', stem, ext) as path, max(size) as size, ext from (
  select l_suppkey as project_id,
    case l_linenumber when 1 then '01_DEGs' when 2 then '02_Enrichment' when 3 then '03_Docking' when 4 then '04_MD' when 5 then '05_Machine_shap' when 6 then '06_Immune' else '07_Nomogram' end as module,
    concat(case l_returnflag when 'A' then 'score_final' when 'N' then 'volcanol_plot' else 'uni_logistic_result' end, '_', cast(l_quantity as bigint)) as stem,
    case cast(round(l_discount * 100) as bigint) when 0 then '.csv' when 1 then '.png' when 2 then '.pdf' when 3 then '.R' when 4 then '.rds' when 5 then '.xvg' when 6 then '.tsv' when 7 then '.jpg' when 8 then '.py' when 9 then '.svg' else '.txt' end as ext,
    case when l_tax < 0.005 then 0 else cast(floor(l_extendedprice / 40) as bigint) end as size
  from {lineitem}) as f
group by project_id, module, stem, ext"""

# Findings: one row per line item; project = supplier.
VIEWS["v_findings"] = """
select l_suppkey as project_id, concat('check_', l_linenumber) as check_id, case when l_linenumber <= 3 then 'P0' else 'P1' end as priority,
  case when l_discount < 0.005 then 'FATAL' when l_discount < 0.025 then 'CRITICAL' when l_discount < 0.055 then 'MAJOR' when l_discount < 0.085 then 'WARNING' else 'INFO' end as severity,
  concat(lpad(cast(cast(l_quantity as bigint) as varchar(10)), 2, '0'), '_module') as module, concat('dir/f', l_partkey, '.csv') as path, l_orderkey as line,
  case l_returnflag when 'A' then 'FAIL' when 'N' then 'PASS' else 'ERROR' end as status
from {lineitem}"""
