"""The registered checks run together on the standard tables."""

from pyspark.sql import functions as F

from claimgrid.plans import checks  # noqa: F401 - registers the checks
from claimgrid.plans.queries import files, grouped, reconcile, similar, text  # noqa: F401 - their SQL is used below
from claimgrid.plans.queries.base import ORACLES, query
from claimgrid.plans.registry import Tables, run

#: Checks whose operator has a query over the same tables, with that query.
SAME_TABLES = {
    "figure_numbering": "A10_numbering_pattern", "section_gaps": "W02_section_gaps", "foreign_project_id": "P06_foreign_ids", "statistic_anomalies": "P08_statistic_anomalies", "sum_identity": "P10_sum_identities",
    "script_thresholds": "J09_script_thresholds", "absolute_paths": "P12_absolute_paths", "nested_models": "J18_nested_models", "differing_models": "J18_differing_models",
    "file_health": "P13_file_health", "preferred_format": "A25_format_pairs", "required_components": "A22_required_components",
}


@query("registry_findings", " union all ".join(
    f"select cast(q.project_id as varchar) as project_id, '{check}' as check_id, q.severity, cast(count(*) as bigint) as n from ({ORACLES[name]}) q group by 1, 3" for check, name in SAME_TABLES.items()))
def _(s):
    tables = Tables(s.spark, {"report_lines": s.v_report_lines, "code_lines": s.v_code_lines, "files": s.v_files, "projects": s.v_projects})
    return run(tables, checks=list(SAME_TABLES)).groupBy("project_id", "check_id", "severity").agg(F.count(F.lit(1)).alias("n"))
