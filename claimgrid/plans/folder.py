"""From a root folder of deliveries to findings and verdicts.

Every project is a folder below the root. The standard tables are built from file metadata, report text, code and
delimited tables; all registered checks run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import claimgrid.plans.checks  # noqa: F401 - registers the checks
from claimgrid.operators import aggregate as A
from claimgrid.plans.registry import Tables, gate, run
from claimgrid.rules import values as V
from claimgrid.session import cut
from claimgrid.sources import files as S

K = S.K
REPORT_NAME = r"(?i)(report|报告)[^/]*\.(md|txt)$"
REPORT_EXTS = [".md", ".txt"]
TABLE_EXTS = [".csv", ".tsv"]


def report_lines(spark: SparkSession, root: str, name: str = REPORT_NAME) -> DataFrame:
    """Lines of the report of each project: project_id, line, text, path, file_line.

    Reports are the text files whose name matches. Where a project has several, they are read in the order of their
    paths and ``line`` runs through all of them; ``path`` and ``file_line`` locate the line in its file."""
    contents = S.scan_contents(spark, root, REPORT_EXTS).where(F.col("path").rlike(name))
    lines = S.scan_lines(contents, [K, "path"]).withColumnRenamed("line", "file_line")
    sizes = lines.groupBy(K, "path").agg(F.max("file_line").alias("_n"))
    before = Window.partitionBy(K).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row for each report file
    starts = sizes.select(K, "path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(starts, [K, "path"]).select(K, (F.col("_before") + F.col("file_line")).alias("line"), "text", "path", "file_line")


def project_table(files: DataFrame) -> DataFrame:
    """project_id, name, project_code, project_type, expected from the names of the project folders."""
    named = files.select(K).distinct().withColumn("name", F.col(K))
    code = F.regexp_extract("name", V.PROJECT_CODE, 1)
    return named.withColumn("project_code", F.when(code != "", code)).join(A.project_type(named), K).join(A.disease_code(named), K)


def load_tables(spark: SparkSession, root: str, report_name: str = REPORT_NAME) -> Tables:
    """The standard tables of all projects below ``root``.

    Report lines and code lines are read by many checks and are written once; inventories come from metadata. Every
    table may be empty; checks on it then find nothing."""
    files = S.scan_files(spark, root)
    dirs = S.scan_dirs(files)
    lines = cut(report_lines(spark, root, report_name))
    code = cut(S.to_lines(S.scan_code(spark, root), [K, "path", "lang"]))
    texts = S.scan_contents(spark, root, TABLE_EXTS).withColumn("text", S.decode_text())
    images = S.scan_contents(spark, root, V.IMAGE_EXTS)
    return Tables(spark, {
        "files": files, "dirs": dirs, "projects": project_table(files), "report_lines": lines.select(K, "line", "text"), "report_positions": lines.select(K, "line", "path", "file_line"),
        "code_lines": code, "table_rows": S.parse_tables(texts), "table_meta": S.table_meta(texts), "asset_hashes": S.fingerprint(images), "png_sizes": S.probe_png(images)})


def located(findings: DataFrame, positions: DataFrame) -> DataFrame:
    """Findings on report lines with the file and the line in it; all others as they are."""
    spot = positions.select(K, "line", F.col("path").alias("_path"), F.col("file_line").alias("_line"))
    asks = F.col("path").isNull() & F.col("line").isNotNull()
    d = findings.withColumn("_ask", F.when(asks, F.col("line"))).join(spot.withColumnRenamed("line", "_ask"), [K, "_ask"], "left")
    return d.select(*[F.coalesce("_path", "path").alias(c) if c == "path" else F.coalesce("_line", "line").alias(c) if c == "line" else F.col(c) for c in findings.columns])


def audit(spark: SparkSession, root: str, priorities: tuple[str, ...] = ("P0", "P1"), report_name: str = REPORT_NAME, checks: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts): all findings (of the named checks, if given) of all projects below ``root``, and one verdict for each project, also for those
    without a finding."""
    tables = load_tables(spark, root, report_name)
    findings = cut(located(run(tables, priorities, checks), tables["report_positions"]))
    verdicts = gate(findings)
    clean = tables["projects"].select(K).join(verdicts.select(K), K, "left_anti")
    counted = [c for c in verdicts.columns if c not in (K, "passed")]
    none = clean.select(K, *[F.lit(0).cast(verdicts.schema[c].dataType).alias(c) for c in counted], F.lit(True).alias("passed"))
    return findings, verdicts.unionByName(none.select(*verdicts.columns))
