"""The registered checks: operators bound to the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimgrid.operators import aggregate as A, extract as X, ordered_checks as W, predicates as P, reconcile as J, similarity as S
from claimgrid.plans.registry import Tables, check
from claimgrid.rules import values as V


@check("figure_numbering", "P1", {"report_lines"})
def figure_numbering(t: Tables) -> DataFrame:
    return A.numbering_pattern(X.figure_refs(t["report_lines"])).withColumn("actual", F.col("figure"))


@check("section_gaps", "P1", {"report_lines"})
def section_gaps(t: Tables) -> DataFrame:
    return W.section_gaps(X.sections(t["report_lines"])).withColumn("actual", F.concat_ws(" -> ", "prev", "section"))


@check("text_anomalies", "P1", {"report_lines"})
def text_anomalies(t: Tables) -> DataFrame:
    return P.text_anomalies(t["report_lines"]).select("*", F.col("found").alias("actual"))


@check("missing_characters", "P1", {"report_lines"})
def missing_characters(t: Tables) -> DataFrame:
    return P.missing_chars(t["report_lines"]).select("*", F.col("wrong").alias("actual"))


@check("wrong_words", "P1", {"report_lines"})
def wrong_words(t: Tables) -> DataFrame:
    return P.wrong_words(t["report_lines"]).select("*", F.col("wrong").alias("actual"))


@check("foreign_project_id", "P0", {"report_lines", "projects"})
def foreign_project_id(t: Tables) -> DataFrame:
    return P.foreign_ids(t["report_lines"], t["projects"]).select("*", F.col("found").alias("actual"))


@check("forbidden_terms", "P0", {"code_lines", "projects"})
def forbidden_terms(t: Tables) -> DataFrame:
    return P.forbidden_terms(t["code_lines"], t["projects"]).select("*", F.col("term").alias("actual"))


@check("sum_identity", "P1", {"report_lines"})
def sum_identity(t: Tables) -> DataFrame:
    return P.sum_identities(t["report_lines"]).withColumn("claimed", F.col("total"))


@check("statistic_anomalies", "P1", {"report_lines"})
def statistic_anomalies(t: Tables) -> DataFrame:
    return P.stat_anomalies(t["report_lines"]).select("*", F.col("kind").alias("category"))


@check("modules_not_delivered", "P1", {"report_lines", "dirs"})
def modules_not_delivered(t: Tables) -> DataFrame:
    return J.claimed_not_delivered(X.sections(t["report_lines"]), t["dirs"]).select("*", F.col("keyword").alias("claimed"))


@check("modules_not_reported", "P1", {"report_lines", "files"})
def modules_not_reported(t: Tables) -> DataFrame:
    return J.delivered_not_claimed(t["files"], t["report_lines"])


@check("method_without_package", "P1", {"report_lines", "code_lines"})
def method_without_package(t: Tables) -> DataFrame:
    return J.method_without_package(t["report_lines"], X.packages(t["code_lines"])).select("*", F.col("method").alias("claimed"))


@check("count_reconciliation", "P1", {"report_lines", "table_rows", "table_meta"})
def count_reconciliation(t: Tables) -> DataFrame:
    counts = A.labelled_counts(t["table_rows"], t["table_meta"])
    d = J.crossref(X.claims(t["report_lines"]), counts).where("severity is not null")
    return d.select("*", F.col("closest_claim").cast("string").alias("claimed"), F.col("total").cast("string").alias("actual"))


@check("threshold_mismatch", "P1", {"report_lines", "code_lines"})
def threshold_mismatch(t: Tables) -> DataFrame:
    return J.threshold_mismatch(X.thresholds(t["report_lines"], V.REPORT_THRESHOLDS), X.thresholds(t["code_lines"], V.CODE_THRESHOLDS))


@check("nested_models", "P1", {"code_lines"})
def nested_models(t: Tables) -> DataFrame:
    return S.nested_models(X.models(t["code_lines"])).select("*", F.col("missing").alias("actual"))


@check("file_health", "P1", {"files"})
def file_health(t: Tables) -> DataFrame:
    return P.file_health(t["files"]).select("*", F.col("problem").alias("category"))


@check("figure_data_ratio", "P1", {"files"})
def figure_data_ratio(t: Tables) -> DataFrame:
    return A.figure_data_ratio(A.module_profile(t["files"])).select("*", F.col("problem").alias("category"))


@check("delivery_gaps", "P1", {"files"})
def delivery_gaps(t: Tables) -> DataFrame:
    return A.delivery_gaps(A.module_profile(t["files"])).select("*", F.col("problem").alias("category"))


@check("preferred_format", "P1", {"files"})
def preferred_format(t: Tables) -> DataFrame:
    return A.format_pairs(t["files"]).select("*", F.col("stem").alias("path"))


# --- project, template and text -------------------------------------------------------------------


@check("foreign_disease_code", "P0", {"report_lines", "projects"})
def foreign_disease_code(t: Tables) -> DataFrame:
    return P.foreign_codes(t["report_lines"], t["projects"]).select("*", F.col("code").alias("actual"))


@check("template_residue", "P0", {"report_lines", "projects"})
def template_residue(t: Tables) -> DataFrame:
    d = P.template_residue(t["report_lines"], t["projects"], X.sections(t["report_lines"]))
    return d.select("*", F.col("keyword").alias("actual"), F.col("grp").alias("category"), F.col("first_line").alias("line"))


@check("heading_structure", "P1", {"report_lines"})
def heading_structure(t: Tables) -> DataFrame:
    return W.heading_checks(t["report_lines"]).select("*", F.col("problem").alias("category"), F.col("title").alias("actual"))


@check("small_validation", "P1", {"report_lines"})
def small_validation(t: Tables) -> DataFrame:
    return P.small_validation(t["report_lines"]).select("*", F.col("n").cast("string").alias("actual"))


@check("missing_in_range", "P1", {"report_lines"})
def missing_in_range(t: Tables) -> DataFrame:
    return J.missing_in_range(t["report_lines"])


@check("paths_not_delivered", "P1", {"report_lines", "files"})
def paths_not_delivered(t: Tables) -> DataFrame:
    return J.missing_paths(J.path_claims(t["report_lines"]), t["files"]).select("*", F.col("claimed_path").alias("claimed"))


# --- methods, data sets and code ------------------------------------------------------------------


@check("methods_not_delivered", "P1", {"report_lines", "dirs"})
def methods_not_delivered(t: Tables) -> DataFrame:
    return J.methods_not_delivered(t["report_lines"], t["dirs"]).select("*", F.col("method").alias("claimed"))


@check("reported_modules_missing", "P1", {"report_lines", "dirs"})
def reported_modules_missing(t: Tables) -> DataFrame:
    return J.reported_modules_missing(t["report_lines"], t["dirs"]).select("*", F.col("module").alias("claimed"))


@check("method_without_code", "P1", {"report_lines", "code_lines"})
def method_without_code(t: Tables) -> DataFrame:
    return J.method_without_code(t["report_lines"], t["code_lines"]).select("*", F.col("method").alias("claimed"))


@check("dataset_presence", "P1", {"report_lines", "code_lines", "dirs"})
def dataset_presence(t: Tables) -> DataFrame:
    def ids(d: DataFrame) -> DataFrame:
        return X.identifiers(d).where("kind = 'dataset'").select("project_id", F.col("value").alias("dataset"))

    folders = t["dirs"].select("project_id", F.lit(0).cast("long").alias("line"), F.col("dir").alias("text"))
    d = J.dataset_presence(ids(t["report_lines"]), ids(folders), ids(t["code_lines"])).where("severity is not null")
    return d.select("*", F.col("status").alias("category"), F.col("dataset").alias("actual"))


@check("script_thresholds", "P1", {"code_lines"})
def script_thresholds(t: Tables) -> DataFrame:
    return J.script_threshold_mismatch(X.thresholds(t["code_lines"], V.CODE_THRESHOLDS)).select("*", F.col("label").alias("category"))


@check("absolute_paths", "P1", {"code_lines"})
def absolute_paths(t: Tables) -> DataFrame:
    return P.absolute_paths(X.io_refs(t["code_lines"])).select("*", F.col("prefix").alias("actual"))


@check("differing_models", "P1", {"code_lines"})
def differing_models(t: Tables) -> DataFrame:
    return S.differing_models(X.models(t["code_lines"])).select("*", F.col("model").alias("actual"))


# --- deliveries and assets ------------------------------------------------------------------------


@check("required_components", "P1", {"files"})
def required_components(t: Tables) -> DataFrame:
    return A.required_components(t["files"]).select("*", F.col("kind").alias("category"), F.col("component").alias("claimed"))


@check("figures_without_values", "P1", {"files"})
def figures_without_values(t: Tables) -> DataFrame:
    return A.figures_without_values(t["files"])


@check("evidence_packages", "P1", {"files"})
def evidence_packages(t: Tables) -> DataFrame:
    return A.evidence_packages(t["files"]).select("*", F.col("kind").alias("category"), F.col("item").alias("claimed"))


@check("filtered_only", "P1", {"files"})
def filtered_only(t: Tables) -> DataFrame:
    return A.filtered_only(t["files"])


@check("duplicate_assets", "P1", {"asset_hashes"})
def duplicate_assets(t: Tables) -> DataFrame:
    return S.exact_duplicates(t["asset_hashes"]).select("*", F.col("duplicate").alias("path"), F.col("first_holder").alias("actual"))


@check("small_images", "P1", {"png_sizes"})
def small_images(t: Tables) -> DataFrame:
    d = t["png_sizes"].where("too_small").withColumn("severity", F.lit("WARNING"))
    return d.select("*", F.concat_ws("x", "width", "height").alias("actual"))
